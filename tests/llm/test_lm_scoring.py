import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from cinelake.llm.lm_scoring import count_pairs, score, train, with_target

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, chosen, least=5):
    words = {i: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in docs}
    pair, word = (Counter(), Counter()), (Counter(), Counter())
    for i, w in words.items():
        for m in (0, 1)[: 1 + (i in chosen)]:
            for h, x in zip(["", *w], [*w, ""], strict=True) if w else ():
                pair[m][h, x] += 1
                word[m][x] += 1
    known = {x for x, n in word[0].items() if n >= least or x == ""}
    rare = [sum(n for x, n in word[m].items() if x not in known) for m in (0, 1)]
    total = [sum(word[m].values()) for m in (0, 1)]
    c = lambda m, x: word[m][x] if x in known else rare[m]
    p1 = lambda m, x: (c(m, x) + 1) / (total[m] + len(known) + 1)

    def loss(m, h, x):
        n = pair[m][h, x] if pair[0][h, x] >= least else 0
        return -math.log((n + 100 * p1(m, x)) / (c(m, h) + 100))

    out = {}
    for i, w in words.items():
        steps = list(zip(["", *w], [*w, ""], strict=True)) if w else []
        out[i] = (len(w), sum(loss(1, h, x) - loss(0, h, x) for h, x in steps) / len(steps) if steps else None)
    return out


def case(spark):
    rng = random.Random(8)
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    docs = [(i, " ".join(rng.choices(a if i % 3 == 0 else b, k=rng.randint(1, 60)))) for i in range(90)]
    docs += [(200, None), (201, ""), (202, "?!"), (203, "unseen words only"), (204, "A1 a2, A3")]
    chosen = {i for i in range(0, 60, 3)}
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, weight string").repartition(3)
    return docs, chosen, df, spark.createDataFrame([(i,) for i in [*chosen, 0, 999]], "doc_id long")


def close(rows, want):
    got = {r.doc_id: (r.n_tokens, r.ce_difference) for r in rows.collect()}
    assert got.keys() == want.keys()
    for i, (n, x) in want.items():
        assert got[i][0] == n
        assert got[i][1] is None if x is None else abs(got[i][1] - x) < 1e-9


def test_scores_equal_brute_force_both_ways(spark):
    docs, chosen, df, ids = case(spark)
    model = train(with_target(df, ids))
    want = brute(docs, chosen)
    close(score(df, model), want)
    close(score(df, model, most=0), want)
    held_out = [want[i][1] for i in range(60, 90)]
    assert max(held_out[::3]) < 0 < min(x for k, x in enumerate(held_out) if k % 3)


def test_least_count_is_a_parameter(spark):
    """With 1 all words and pairs are in the model; columns with names in use pass."""
    docs, chosen, df, ids = case(spark)
    marked = with_target(df.withColumns({"maybe": F.lit(1), "chosen_id": F.lit(2)}), ids)
    assert marked.columns == [*df.columns, "maybe", "chosen_id", "target"]
    for least in (1, 12):
        model = train(marked, min_count=least)
        close(score(marked, model), brute(docs, chosen, least))
        close(score(marked, model, most=0), brute(docs, chosen, least))


def test_repeated_rows_and_empty_tables(spark):
    _, _, df, ids = case(spark)
    twice = df.union(df.filter("doc_id < 5"))
    model = train(with_target(twice, ids))
    assert score(twice, model).count() == twice.count() == score(twice, model, most=0).count()
    empty = train(with_target(df.limit(0), ids))
    assert score(df.limit(0), empty).count() == 0
    assert score(df, empty).count() == df.count()


def test_model_grows_with_its_input(spark):
    """At 24 million tokens a word and a pair of 5 occurrences are still known."""
    filler = spark.range(60).selectExpr("id as doc_id", "repeat('x ', 400000) as text", "false as target")
    rare = spark.createDataFrame([(100 + i, "seldom seen", True) for i in range(5)], "doc_id long, text string, target boolean")
    model = train(filler.unionByName(rare).repartition(8))
    assert model.rows == 4 + 6  # x, seldom, seen and the edge; three pairs of either text


def test_partial_counts_come_in_slices(spark):
    """A task's counts leave in several batches, each pair once, as brute force has them."""
    docs = type("Docs", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, run, _: run})()
    rng = random.Random(5)
    texts = [" ".join(map(str, rng.choices(range(3000), k=20_000))) for _ in range(4)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True, False] * 3)], names=["text", "t"])
    out = list(count_pairs(docs, "text", "target")(iter([batch])))
    rows = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    pairs, words, chosen = Counter(), Counter(), Counter()
    for i, t in enumerate(texts[:4]):
        w = t.split()
        words.update([*w, ""])
        pairs.update(zip(["", *w], [*w, ""], strict=True))
        chosen.update([*w, ""] if i % 2 == 0 else [])
    assert len({r[:2] for r in rows}) == len(rows) == len(words) + len(pairs)
    alone = [r for r in rows if r[1] is None]
    assert sorted(r[2] for r in alone) == sorted(words.values()) and sorted(r[2] for r in rows if r[1] is not None) == sorted(pairs.values())
    assert sorted(r[3] for r in alone) == sorted(chosen[w] for w in words)
    assert max(b.num_rows for b in out) < len(pairs) / 4
