import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cinelake.llm import suffix_dedup
from cinelake.llm.suffix_dedup import column_repeats, cut_repeats


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(r) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def case():
    rng = random.Random(6)
    text = lambda n, of="abcdefgh é中": "".join(rng.choices(of, k=n))
    shared = [text(n) for n in (120, 190, 200, 201, 330, 700, 1500)]
    out = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "d" * 900, "xy" * 400, text(100) * 5]
    for _ in range(60):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.choice([0, 0, rng.randint(0, len(s) // 2)])
            parts += [s[a : a + rng.choice([len(s), len(s), rng.randint(1, len(s))])], text(rng.randint(0, 40))]
        out.append("".join(parts))
    return [*out, out[-1], out[-2]]


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cut_repeats(df).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    return want


def test_equals_brute_force(spark):
    want = check(spark, case())
    assert sum(x[1] > 0 for x in want) > 30


def test_small_constructions_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRINGS", 5)
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    check(spark, case())


def test_hot_grams_are_decided_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3)
    monkeypatch.setattr(suffix_dedup, "STRINGS", 5)
    check(spark, case())
    monkeypatch.setattr(suffix_dedup, "BLOCK", 0)
    check(spark, case())


def test_a_common_passage_that_is_too_short_removes_nothing(spark):
    # more contents around one gram than a construction holds, no 200 bytes alike
    passage = hashlib.sha512(b"p").hexdigest() + hashlib.sha512(b"q").hexdigest()[:22]
    own = F.concat(F.sha2(F.concat(F.lit("a"), "id"), 512), F.sha2(F.concat(F.lit("b"), "id"), 512))
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(own, F.lit(passage), F.sha2(F.concat(F.lit("c"), "id"), 512), F.sha2(F.concat(F.lit("d"), "id"), 512)).alias("text"))
    assert len(passage) == 150 and suffix_dedup.BLOCK < 30_000
    assert cut_repeats(df).agg(F.sum("n_removed")).first()[0] == 0
    # fifty bytes more make it one in each
    long = df.withColumn("text", F.concat(F.substring("text", 1, 256), F.lit(passage[:50]), F.substring("text", 257, 1000)))
    got = cut_repeats(long).agg(F.min("n_removed"), F.max("n_removed"), F.min("n_spans")).first()
    assert 200 <= got[0] and got[1] <= 220 and got[2] == 1  # and by chance some characters next to it


def test_repeated_rows_kept_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "q" * 50 + "é" * 150), (1, "q" * 50 + "é" * 150), (2, "other")], "doc_id long, text string")
    rows = {r.doc_id: r for r in cut_repeats(df, keep_bytes=True).collect()}
    assert rows[1].n_removed == 350 and bytes(rows[1].kept) == b"" and bytes(rows[2].kept) == b"other"
    assert cut_repeats(df.limit(0)).count() == 0


def test_column_construction_equals_comparing_all():
    rng = random.Random(9)
    strings, anchors = [], []
    for _ in range(80):
        left = rng.randint(0, 6)
        strings.append(bytes(rng.choices(b"ab", k=left)) + b"X" + bytes(rng.choices(b"ab", k=rng.randint(0, 7))))
        anchors.append(left)
    offsets = np.cumsum([0, *map(len, strings)])
    got = column_repeats(np.frombuffer(b"".join(strings), np.uint8), offsets, np.array(anchors), 5)
    for i, (s, a) in enumerate(zip(strings, anchors, strict=True)):
        for d in range(got.shape[1]):
            w = s[a - d : a - d + 5] if d <= a else b""
            alike = len(w) == 5 and any(j != i and b >= d and t[b - d : b - d + 5] == w for j, (t, b) in enumerate(zip(strings, anchors, strict=True)))
            assert got[i, d] == alike
