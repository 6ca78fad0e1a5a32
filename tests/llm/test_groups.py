import random

from pyspark.sql import functions as F

from cinelake.llm._common import fresh, marked, marks, release, shared_dir, staged
from cinelake.llm._groups import components, units


def test_components_of_random_graphs_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7), (7, 7)]
    label = {n: n for e in edges for n in e}
    for a, b in edges:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        for n in label:
            if label[n] == old:
                label[n] = new
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.root for r in got} == {n: label[n] for n in linked} and len(got) == len(linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_pair_of_a_group_meets_once(spark):
    rows = spark.createDataFrame([(g, f"{g}-{i}", 10) for g, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)], "g long, node string, size int")
    met = {}
    for r in units(rows, "g", "node", "size", 60).collect():
        met.setdefault(r.unit, []).append((r.side, r.node, r.g))
    pairs = []
    for members in met.values():
        assert len({g for _, _, g in members}) == 1 and len(members) < 40
        left, right = [n for s, n, _ in members if s != 2], [n for s, n, _ in members if s == 2]
        pairs += [tuple(sorted((a, b))) for a in left for b in right] if right else [tuple(sorted((a, b))) for i, a in enumerate(left) for b in left[:i] if members[0][0] == 0]
    want = [tuple(sorted((f"{g}-{i}", f"{g}-{j}"))) for g, n in ((1, 40), (2, 3), (3, 1)) for i in range(n) for j in range(i)]
    assert sorted(pairs) == sorted(want)


def test_marks_never_miss(spark):
    keys = [0, 1, -1, 2**62, -(2**63), 32768, 32769, 8388608, *range(5000, 9000, 7)]
    bitmap = marks(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 16)
    import numpy as np

    assert marked(bitmap, np.array(keys, np.int64)).all()
    assert marked(bitmap, np.arange(20000, 22000)).sum() < 100
    assert not marks(spark.createDataFrame([], "k long"), "k").any()


def test_staging(spark):
    df = staged(spark.range(5), "some")
    assert df.count() == 5 and "cinelake-" in df.inputFiles()[0] and shared_dir(spark).split(":")[-1] in df.inputFiles()[0]
    assert fresh(spark.range(1).withColumn("ROW", F.lit(1)), "row", "row", "id") == ["row_", "row__", "id_"]
    assert spark.sparkContext.getConf().get("spark.checkpoint.dir")
    release(spark)
