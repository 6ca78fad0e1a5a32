"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns the training texts into immutable index segments, one row
each, written to the shared folder: the segment's terms, and for each term its
postings (word positions, delta-coded). Positions run on over the documents of
a segment with a gap between them, so that no phrase crosses two documents.

``search`` reads the segments back, one at a time, next to a bounded block of
benchmark phrases. For each phrase the posting lists of its terms are ordered
from the rarest in the segment; the rarest list gives candidate starts, and each
further list, shifted by its term's offset, is intersected with them. Exact
matches are what is left after the last list; proximity matches need every term
within ``slop`` positions of the rarest one. A larger benchmark is searched in
several blocks of phrases, whose hits are merged by document.

Neither step shuffles texts; a segment is a few MB whatever the corpus, and a
hot source or a common passage only makes some lists longer.

Defined results: null and empty texts have no words and are clean; null or empty
benchmark items match nothing; repeated items each count; repeated documents are
judged alike; empty tables give empty results or clean documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import byte_view, chunks, fresh, lean, marks, may_hold, staged, text_key
from ._words import ALNUM, FOLD, U, hash_spans, rows_of, spans

WINDOW = 10
GAP = 64
#: Text bytes in a segment, and phrases in a block (16 MB of term hashes).
SEGMENT_BYTES = 4 << 20
BLOCK_PHRASES = 200_000

INDEX = T.StructType(
    [T.StructField(c, T.BinaryType()) for c in ("doc_ids", "doc_keys", "doc_null", "starts", "sizes", "terms", "lists", "postings")]
)
DOCUMENT = "doc_id long, doc_key long, n_words long"
RESULT = f"{DOCUMENT}, n_hit long, n_items long, items_sha256 string, contaminated boolean"
HITS = "doc_id long, doc_key long, spans array<int>, items array<string>"
MATCHES = "doc_id long, item_id string, item_word int, doc_word int, kind string"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index segments of all texts, written to the shared folder."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(id_col, text_col).alias("k"), F.col(f"`{text_col}`").alias("text")
    )

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy()
            data, offsets = byte_view(batch.column(2))
            for lo, hi in chunks(offsets, SEGMENT_BYTES):
                part = offsets[lo : hi + 1]
                s, e = spans(data[part[0] : part[-1]], part - part[0], ALNUM)
                row = rows_of(s, part - part[0])
                sizes = np.bincount(row, minlength=hi - lo)
                starts = np.cumsum(sizes) - sizes + GAP * np.arange(hi - lo)
                code, terms = pd.factorize(hash_spans(data[part[0] : part[-1]], s, e, FOLD), sort=True)
                order = np.argsort(code, kind="stable")
                at = (np.arange(len(s)) + GAP * row)[order]
                delta = np.diff(at, prepend=0).astype(np.int32)
                sub = ids.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x.tobytes()], pa.binary())
                        for x in (
                            sub.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                            keys[lo:hi].astype(np.int64),
                            sub.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
                            starts.astype(np.int64),
                            sizes.astype(np.int64),
                            terms.astype(U),
                            np.bincount(code, minlength=len(terms)).astype(np.int32),
                            delta,
                        )
                    ],
                    names=INDEX.fieldNames(),
                )

    return staged(rows.mapInArrow(lean(run), INDEX), "postings")


class Segment:
    """One index row, with posting lists addressed by term."""

    def __init__(self, row: dict[str, bytes]):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.keys = np.frombuffer(row["doc_keys"], np.int64)
        self.null = np.frombuffer(row["doc_null"], np.uint8).astype(bool)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.terms = np.frombuffer(row["terms"], U)
        self.lengths = np.frombuffer(row["lists"], np.int32).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        at = np.cumsum(np.frombuffer(row["postings"], np.int32), dtype=np.int64)
        self.postings = at
        #: (term, position) as one ascending number, for membership tests
        self.wide = int(at.max()) + 2 * GAP if len(at) else 1
        self.keyed = np.repeat(np.arange(len(self.terms)), self.lengths) * self.wide + at

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the terms here, -1 for those without postings."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term has a posting at the position."""
        want = term * self.wide + position
        at = np.minimum(np.searchsorted(self.keyed, want), len(self.keyed) - 1)
        return (self.keyed[at] == want) & (position >= 0) & (position < self.wide)

    def near(self, term: np.ndarray, position: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term has a posting within ``slop`` of the position."""
        lo = np.searchsorted(self.keyed, term * self.wide + np.maximum(position - slop, 0))
        hi = np.searchsorted(self.keyed, term * self.wide + np.minimum(position + slop, self.wide - 1), "right")
        return hi > lo

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1


class Phrases:
    """A block of benchmark phrases: padded term matrix, lengths and origins."""

    def __init__(self, items: list[str], starts: list[int], rows: list[np.ndarray], width: int):
        self.items, self.starts = np.array(items, object), np.array(starts, np.int32)
        self.length = np.array([len(r) for r in rows], np.int64)
        self.terms = np.zeros((len(rows), width), U)
        for i, r in enumerate(rows):
            self.terms[i, : len(r)] = r


def phrase_blocks(bench: DataFrame, window: int = WINDOW, most: int = BLOCK_PHRASES) -> Iterator[Phrases]:
    """The benchmark as blocks of phrases; only one block is held at a time."""
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    items, starts, terms = [], [], []
    for item, text in rows.toLocalIterator():
        data = np.frombuffer(text.encode(), np.uint8)
        s, e = spans(data, np.array([0, len(data)]), ALNUM)
        h = hash_spans(data, s, e, FOLD)
        for k in range(max(1, len(h) - window + 1) if len(h) else 0):
            items.append(item)
            starts.append(k)
            terms.append(h[k : k + window])
            if len(items) == most:
                yield Phrases(items, starts, terms, window)
                items, starts, terms = [], [], []
    if items:
        yield Phrases(items, starts, terms, window)


def intersect(seg: Segment, ph: Phrases, slop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position) of matches; position: of the phrase's first word, or of
    the rarest term if ``slop`` asks for proximity matches."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    term = seg.find(ph.terms)
    used = np.arange(ph.terms.shape[1])[None, :] < ph.length[:, None]
    live = np.flatnonzero(((term >= 0) | ~used).all(1))
    if not len(live):
        return none
    term, used = term[live], used[live]
    size = np.where(used, seg.lengths[np.maximum(term, 0)], np.iinfo(np.int64).max)
    order = np.argsort(size, axis=1, kind="stable")
    lead = order[:, 0]
    pick = np.arange(len(live))
    t0 = term[pick, lead]
    n = seg.lengths[t0]
    who = np.repeat(pick, n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = seg.postings[np.repeat(seg.first[t0], n) + within]
    if slop is None:
        at = at - lead[who]
    for k in range(1, ph.terms.shape[1]):
        if not len(who):
            return none
        place = order[who, k]
        need = used[who, place]
        t = np.maximum(term[who, place], 0)
        ok = seg.holds(t, at + place) if slop is None else seg.near(t, at, slop)
        who, at = (x[ok | ~need] for x in (who, at))
    ok = at >= 0
    return live[who[ok]], at[ok]


def _union(spans_: np.ndarray, size: int) -> int:
    """Words covered by [start, end) pairs."""
    if not len(spans_):
        return 0
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, spans_[0::2], 1)
    np.add.at(edge, np.minimum(spans_[1::2], size), -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _segments(batches) -> Iterator[Segment]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Segment(row)


def _hits(seg: Segment, ph: Phrases) -> dict[int, tuple[np.ndarray, set[str]]]:
    who, at = intersect(seg, ph)
    out: dict[int, tuple[np.ndarray, set[str]]] = {}
    if not len(who):
        return out
    doc = seg.doc_of(at)
    order = np.argsort(doc, kind="stable")
    doc, who, at = doc[order], who[order], at[order]
    cut = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        d = int(doc[lo])
        start = at[lo:hi] - seg.starts[d]
        pairs = np.unique(np.stack([start, start + ph.length[who[lo:hi]]], 1), axis=0)
        out[d] = pairs.reshape(-1), set(ph.items[who[lo:hi]])
    return out


def search(index: DataFrame, bench: DataFrame, window: int = WINDOW, block: int = BLOCK_PHRASES) -> DataFrame:
    """One row for each indexed document: ``RESULT``."""
    spark = index.sparkSession

    def finish(seg: Segment, found: dict) -> pa.RecordBatch:
        n = len(seg.ids)
        hit, items = np.zeros(n, np.int64), [()] * n
        for d, (pairs, names) in found.items():
            hit[d], items[d] = _union(pairs, int(seg.sizes[d])), names
        empty = _digest(())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(seg.ids, mask=seg.null), pa.array(seg.keys), pa.array(seg.sizes), pa.array(hit),
                pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) if x else empty for x in items]), pa.array(hit > 0),
            ],
            names=["doc_id", "doc_key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    blocks = phrase_blocks(bench, window, block)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        given = spark.sparkContext.broadcast(first)

        def whole(batches):
            for seg in _segments(batches):
                yield finish(seg, _hits(seg, given.value) if given.value else {})

        return index.mapInArrow(lean(whole), RESULT)

    def partial(given):
        def run(batches):
            for seg in _segments(batches):
                found = _hits(seg, given.value)
                at = np.array(sorted(found), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seg.ids[at], mask=seg.null[at]), pa.array(seg.keys[at]),
                        pa.array([found[d][0].astype(np.int32) for d in at], pa.list_(pa.int32())),
                        pa.array([sorted(found[d][1]) for d in at], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "doc_key", "spans", "items"],
                )

        return run

    def sizes(batches):
        for seg in _segments(batches):
            yield pa.RecordBatch.from_arrays([pa.array(seg.ids, mask=seg.null), pa.array(seg.keys), pa.array(seg.sizes)], names=["doc_id", "doc_key", "n_words"])

    hits = None
    while first is not None:
        part = staged(index.mapInArrow(partial(spark.sparkContext.broadcast(first)), HITS), "hits")
        hits = part if hits is None else hits.unionByName(part)
        first, second = second, next(blocks, None)
    merged = hits.groupBy("doc_key").agg(
        F.array_distinct(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(F.get("spans", i).alias("s"), F.get("spans", i + 1).alias("e")))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.e - F.greatest(a.to, s.s))).alias("n"), F.greatest(a.to, s.e).alias("to")),
    ).n
    docs = index.mapInArrow(sizes, DOCUMENT)
    return docs.join(merged, "doc_key", "left").select(
        "doc_id", "doc_key", "n_words", F.coalesce(covered, F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce(covered, F.lit(0)) > 0).alias("contaminated"),
    )


def matches(index: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Where phrases occur: exactly, or with every term within ``slop`` words (at
    most ``GAP`` / 2) of the phrase's rarest term. Rows: ``MATCHES``."""
    spark = index.sparkSession
    if slop is not None and slop > GAP // 2:
        raise ValueError(f"slop may be {GAP // 2} at most")
    kind, out = "exact" if slop is None else "proximity", None
    for block in phrase_blocks(bench, window):
        given = spark.sparkContext.broadcast(block)

        def run(batches, given=given):
            for seg in _segments(batches):
                ph = given.value
                who, at = intersect(seg, ph, slop)
                doc = seg.doc_of(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seg.ids[doc], mask=seg.null[doc]), pa.array(list(ph.items[who]), pa.string()), pa.array(ph.starts[who]),
                        pa.array((at - seg.starts[doc]).astype(np.int32)), pa.array([kind] * len(who), pa.string()),
                    ],
                    names=["doc_id", "item_id", "item_word", "doc_word", "kind"],
                )

        part = index.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], MATCHES)


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no phrase of the benchmark occurs.

    The keys of contaminated rows go into a bitmap of fixed size; rows that it
    cannot hold pass without a shuffle, and only the others meet the exact keys.
    """
    found = search(build_index(docs), bench, window)
    bad = staged(found.filter("contaminated").select("doc_key").distinct(), "contaminated")
    return without(docs, bad, "doc_key", text_key())


def without(docs: DataFrame, keys: DataFrame, key: str, of) -> DataFrame:
    """Rows of ``docs`` whose key is not among ``keys``: an exact anti-join, spared
    for rows that a fixed-size bitmap of the keys rules out."""
    bitmap = docs.sparkSession.sparkContext.broadcast(marks(keys, key))
    k, maybe = fresh(docs, "row_key", "maybe")
    keyed = docs.withColumn(k, of).withColumn(maybe, may_hold(bitmap)(k))
    other = keys.select(F.col(key).alias("other_key"))
    rest = keyed.filter(F.col(maybe))
    rest = rest.join(other, F.col(k) == F.col("other_key"), "left_anti")
    return keyed.filter(~F.col(maybe)).unionByName(rest).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(build_index(docs), bench).drop("doc_key")
