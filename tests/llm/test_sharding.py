import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cinelake.llm import sharding
from cinelake.llm.sharding import Range, Ranges, add_shard, assign, plan


def least_capacity(sizes, shards):
    """Smallest capacity for ordered sizes, by trying every sum of a stretch."""

    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})
    return next(c for c in sums if fits(c))


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_the_smallest(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)  # so that ranges must be split
    sizes = {rng.randrange(-(2**63), 2**63): rng.choice([17, 40, 500, rng.randint(16, 3000)]) for _ in range(60)}
    if seed == 3:
        sizes[next(iter(sizes))] = 60_000
    groups = spark.createDataFrame(list(sizes.items()), "h long, size long")
    capacity, cuts = plan(groups, 7)
    ordered = [sizes[h] for h in sorted(sizes)]
    assert capacity == least_capacity(ordered, 7)
    loads = defaultdict(int)
    for h, s in sizes.items():
        loads[sum(h >= c for c in cuts)] += s
    assert max(loads.values()) <= capacity and max(loads) < 7


def test_even_cuts_use_the_slack():
    at = Ranges([Range(i, 64, 1, s) for i, s in enumerate([100, 10, 10, 10, 10])], 100, 3)
    assert at.least() == 100
    cuts = at.even_cuts(100)
    assert cuts == [1, 3]


def test_rows_of_the_contract(spark):
    rng = random.Random(1)
    texts = [None, "", "héllo", *("t" * rng.randint(0, 900) + str(rng.randint(0, 40)) for _ in range(200))] + ["hot text"] * 150
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    df = df.union(df.filter("doc_id = 3"))
    rows = assign(df, 8).collect()
    assert len(rows) == len(texts) + 1
    slots, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        by_text[raw].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(8))


def test_empty_table_and_the_general_form(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert assign(df.limit(0)).count() == 0
    assert add_shard(df, 3).select(F.max("shard")).first()[0] <= 2
