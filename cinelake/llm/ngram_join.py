"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts become sets of hashed five-word shingles. Equal sets are one class from the
start, so copies are never paired. MinHash bands of the distinct sets bring sets
that may be similar into one component (band buckets are linked as stars, not as
pairs). Members of a component meet in units of bounded size. There, MinHash
values are compared in rounds; after each round a pair is dropped if the
posterior probability that its similarity reaches the threshold, from the
matches so far under a uniform prior, is below the tolerance. What is left is
verified exactly on the sets. Links are counted where they are found and leave a
task as counts and spanning trees, never as all pairs.

Bands: 24 of 4 values. A pair at the threshold of 0.8 shares none with
probability 3e-6, a closer pair with less; the tolerance is 1e-9.

Defined results: words are runs of letters and digits of any script, A-Z folded;
a text of fewer than five words is one shingle; a null text or one without words
is alone, without links. Repeated rows are copies like any others. A class is
named by its least document id. An empty table gives no rows. Very long texts
make large sets: a unit holds one pair of blocks of ``BUDGET`` shingles, or of
one text if that is longer.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_view, chunks, lean, marked, marks, staged, text_key
from ._groups import Forest, components, each_unit, merge_labels, units
from ._words import ALNUM, FOLD, U, hash_spans, mix, rows_of, spans, windows

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
ROUND = 16
TOLERANCE = 1e-9
#: Shingles in a block of a unit: 2.4 MB of hashes.
BUDGET = 300_000

SKETCH = "doc_key long, doc_id long, set_id binary, n int, bands array<long>"
SETS = "doc_key long, set_id binary, shingles binary"
LINKS = "set_id binary, root binary, blocks int, links long"

_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    s, e = spans(data, offsets, ALNUM)
    h = hash_spans(data, s, e, FOLD)
    count = np.bincount(rows_of(s, offsets), minlength=len(offsets) - 1)
    ends = np.cumsum(count)
    w = windows(h, n)
    out = []
    for k, end in zip(count, ends, strict=True):
        if k >= n:
            out.append(np.unique(w[end - k : end - n + 1]))
        else:
            out.append(windows(h[end - k : end], int(k)) if k else np.empty(0, U))
    return out


def signatures(sets: list[np.ndarray], salts: np.ndarray = _SALTS) -> np.ndarray:
    """MinHash values of non-empty sets, one row each."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *(len(x) for x in sets[:-1])])
    out = np.empty((len(sets), len(salts)), np.uint32)
    for k, salt in enumerate(salts):
        out[:, k] = np.minimum.reduceat(((flat * salt) >> U(32)).astype(np.uint32), first)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(U)
    key = np.repeat(np.arange(1, BANDS + 1, dtype=U)[None, :], len(sig), 0)
    for k in range(ROWS):
        key = mix(key * U(0xD1342543DE82EF95) + parts[:, :, k])
    return key


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, total: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """For each round (values compared so far, fewest matches that keep a pair).

    With a uniform prior and m matches in n values the posterior is Beta(m + 1,
    n - m + 1), whose mass above t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(ROUND, total + 1, ROUND):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``SKETCH``; a text without words has a null set."""
    rows = docs.select(text_key(id_col, text_col).alias("k"), F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))

    def run(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column(2))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                sets = shingle_sets(data[part[0] : part[-1]], part - part[0])
                full = [i for i, x in enumerate(sets) if len(x)]
                bands: list = [None] * len(sets)
                if full:
                    for i, b in zip(full, band_keys(signatures([sets[i] for i in full])).astype(np.int64), strict=True):
                        bands[i] = b
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                        pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                        pa.array([len(x) for x in sets], pa.int32()), pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_key", "doc_id", "set_id", "n", "bands"],
                )

    return rows.mapInArrow(lean(run), SKETCH)


def _sets_of(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Shingles of the documents whose key may be wanted."""
    given = docs.sparkSession.sparkContext.broadcast(wanted)
    rows = docs.select(text_key(id_col, text_col).alias("k"), F.col(f"`{text_col}`").alias("t"))

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(marked(given.value, keys)))
            keys = batch.column(0).to_numpy()
            data, offsets = byte_view(batch.column(1))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                sets = shingle_sets(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo:hi]), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["doc_key", "set_id", "shingles"],
                )

    return rows.mapInArrow(lean(run), SETS)


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE):
    """(i, partners) of a unit: pairs that pass the pruning and the exact check.

    Sides 1 and 2 are two blocks, compared with each other only; side 0 is one.
    """
    sig = signatures(sets)
    size = np.array([len(x) for x in sets])
    code = pd.factorize(np.concatenate(sets))[0]
    first = np.cumsum(size) - size
    present = np.zeros(code.max() + 1, bool)
    rounds = least_matches(threshold, tolerance)
    across = np.flatnonzero(side == 2)
    for i in np.flatnonzero(side != 2):
        j = np.arange(i + 1, len(sets)) if side[i] == 0 else across
        j = j[np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i])]
        match = np.zeros(len(j), np.int64)
        for n, least in rounds:
            if not len(j):
                break
            match = match + (sig[j, n - ROUND : n] == sig[i, n - ROUND : n]).sum(1)
            j, match = j[match >= least], match[match >= least]
        if not len(j):
            continue
        own = code[first[i] : first[i] + size[i]]
        present[own] = True
        n = size[j]
        at = np.repeat(first[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.add.reduceat(present[code[at]].astype(np.int64), np.cumsum(n) - n)
        present[own] = False
        # both / (union) >= threshold, without rounding at the threshold itself
        j = j[both * 1_000_000 >= round(threshold * 1_000_000) * (n + size[i] - both)]
        if len(j):
            yield i, j


def _compare(threshold: float, tolerance: float):
    def compare(unit: dict[str, list]) -> dict[str, list]:
        sets = [np.frombuffer(x, U) for x in unit["shingles"]]
        copies = np.array(unit["copies"], np.int64)
        links, forest = np.zeros(len(sets), np.int64), Forest(len(sets))
        for i, j in similar_pairs(sets, np.array(unit["side"]), threshold, tolerance):
            links[i] += copies[j].sum()
            links[j] += copies[i]
            forest.join(i, j)
        ids = unit["set_id"]
        return {"set_id": ids, "root": [ids[x] for x in forest.label], "blocks": unit["blocks"], "links": links.tolist()}

    return compare


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row a document: ``doc_id``, ``doc_key``, ``class_key`` (the key of the
    class's first document), ``class_id`` (its least id) and ``n_links`` (other
    documents at or above the threshold, copies of the same set included)."""
    found = staged(sketch(docs, id_col, text_col), "sketch")
    # distinct sets, each with one document to take its shingles from
    sets = staged(
        found.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_key").alias("doc_key"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "sets",
    )
    banded = sets.select("set_id", F.explode("bands").alias("band"))
    stars = banded.groupBy("band").agg(F.count("*").alias("c"), F.min("set_id").alias("b")).filter("c > 1").drop("c")
    near = components(banded.join(stars, "band").select(F.col("set_id").alias("a"), "b"))
    members = staged(near.join(sets.drop("bands"), near.node == sets.set_id).select("set_id", "root", "doc_key", "copies", "n"), "members")
    shingled = _sets_of(docs, marks(members, "doc_key"), id_col, text_col).dropDuplicates(["doc_key"])
    rows = units(members, "root", "set_id", "n", BUDGET).join(shingled.drop("set_id"), "doc_key")
    rows = rows.select("unit", "side", "set_id", "copies", "blocks", "shingles")
    links = staged(each_unit(rows, _compare(threshold, tolerance), LINKS), "links")
    label = merge_labels(links, "set_id", "root", "blocks")
    count = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    result = sets.select("set_id", "copies").join(label.withColumnRenamed("node", "set_id"), "set_id", "left").join(count, "set_id", "left")
    result = result.select("set_id", F.coalesce("root", "set_id").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    result = staged(result, "result")  # so that the join with a hot set's documents can be split
    each = staged(found.select("doc_key", "doc_id", "set_id").join(result, "set_id", "left"), "classes")
    name = each.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key")).alias("f"))
    return each.join(name, "class", "left").select(
        "doc_id", "doc_key",
        F.coalesce("f.doc_key", "doc_key").alias("class_key"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the least id, and among repeated rows
    any one of them. Texts without words stay."""
    from .decontaminate import without

    classes = staged(jaccard_classes(docs, id_col, text_col).select("doc_key", "class_key", "n_links"), "kept")
    gone = classes.filter("doc_key != class_key").select("doc_key").distinct()
    left = without(docs, gone, "doc_key", text_key(id_col, text_col))
    again = classes.filter("doc_key = class_key and n_links > 0").groupBy("doc_key").count().filter("count > 1").select("doc_key")
    again = staged(again, "again")
    if again.isEmpty():
        return left
    single = without(left, again, "doc_key", text_key(id_col, text_col))
    k = "row_key" if "row_key" not in left.columns else "row_key_"
    twice = left.withColumn(k, text_key(id_col, text_col)).join(again.withColumnRenamed("doc_key", k), k, "left_semi")
    return single.unionByName(twice.dropDuplicates([k]).select(*(F.col(f"`{c}`") for c in docs.columns)))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs).select("doc_id", "class_id", "n_links")
