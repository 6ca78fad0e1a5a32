"""Removal of every byte covered by a 200-byte string that also starts elsewhere.

The repeats are decided by column-wise construction over many strings: one symbol
of each string is inserted a round, from the right, and with it the order of all
suffixes at that column and the common prefixes of neighbours are updated
(``column_repeats``). Neighbours that agree for 200 symbols are repeats.

Over whole documents that takes as many rounds as the longest text has bytes,
each a pass over everything inserted so far, so the strings are cut first, such
that none can be missed and all are aligned:

* Winnowing gives each 200-byte window one anchor, the least of the hashed 64-byte
  grams in it, chosen by content alone: equal windows have equal anchors at equal
  offsets. Consecutive windows with one anchor make a run of at most 336 bytes.
* Runs whose anchor gram occurs once in the collection hold no repeat.
* Runs equal in all their bytes are repeats as wholes, by count.
* Of the other runs one of each content is taken; runs with the same gram are
  aligned at it and go through the construction together. A construction holds
  whole grams, each of at most ``BLOCK`` strings, so that no string is in it twice.
* Around a hot gram (more than ``BLOCK`` contents) runs are cut into pieces of
  twelve windows, aligned at the gram. Pieces whose common core is theirs alone
  hold no repeat, pieces of equal bytes are repeats by count, and the windows of
  what is left are compared by count. No group is gathered, no pair is made.

Only runs travel, not texts, until spans are known; a common passage is one run
content with a count.

Defined results: a null text is empty; matches never cross documents; repeated
rows are repeats of each other, and so are repeats within one text; ties have no
role, as every copy goes; an empty table gives no rows; other columns are dropped,
and their names may clash with any made here. A very long text is hashed in one
piece, in a task with some 60 bytes of memory a byte of it. The bytes that stay
may begin or end within a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_view, chunks, marks, may_hold, partitions, staged, text_key
from ._words import _BASE, _INVERSE, BYTE_VALUES, U, _powers, mix

LENGTH, GRAM = 200, 64
SPREAD = LENGTH - GRAM + 1
#: Strings after which a construction ends at the next gram, and most of a gram.
STRINGS, BLOCK = 16_000, 16_000
#: Windows in a piece of a run around a hot gram.
WIDTH = 12
#: Bytes hashed at a time, and bits of a byte position in the order of anchors.
PIECE, PLACE = 1 << 20, 31
BITS = 27

RUNS = "gram long, content long, doc_key long, start int, size short, anchor short"
REGIONS = "gram long, doc_key long, start int, anchor short, single boolean, hot boolean, bytes binary"
SPANS = "doc_key long, start int, end int"
PARTS = "gram long, part long, content long, doc_key long, run int, start int, end int, single boolean, lo int, hi int"
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _runs(data: np.ndarray, bounds: np.ndarray):
    """(gram hash, content hash, start, size, anchor offset) of all runs.

    ``bounds`` are the row starts and the end; windows lie within rows.
    """
    n = len(data)
    none = tuple(np.empty(0, d) for d in (U, U, np.int64, np.int64, np.int64))
    if n < LENGTH:
        return none
    size = max(PIECE, 1 << int(n + 1).bit_length()) * 2
    total = np.zeros(n + 1, U)
    np.cumsum(BYTE_VALUES[data] * _powers(_BASE, size)[:n], out=total[1:])
    inverse = _powers(_INVERSE, size)
    gram = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    low = U((1 << PLACE) - 1)
    key = (gram & ~low) | (low - np.arange(len(gram), dtype=U))  # the last of equal ones
    rows = -(-len(key) // SPREAD)
    padded = np.full(rows * SPREAD + SPREAD, ~U(0))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, SPREAD)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    m = n - LENGTH + 1
    at = (low - (np.minimum(behind[:m], ahead[SPREAD - 1 : SPREAD - 1 + m]) & low)).astype(np.int64)
    s = np.arange(m)
    row = np.searchsorted(bounds[1:], s, "right")
    s = s[s + LENGTH <= bounds[1:][row]]
    if not len(s):
        return none
    a, row = at[s], row[s]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], len(s)) - 1
    start, anchor = s[first], a[first]
    bytes_ = s[last] - start + LENGTH
    content = mix((total[start + bytes_] - total[start]) * inverse[start] ^ (bytes_ * 1024 + anchor - start).astype(U))
    return gram[anchor], content, start, bytes_, anchor - start


def _run_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(text_key(id_col, text_col).alias("k"), F.col(f"`{text_col}`").alias("t"))

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = byte_view(batch.column(1))
            for lo, hi in chunks(offsets, PIECE):
                part = offsets[lo : hi + 1] - offsets[lo]
                gram, content, start, size, anchor = _runs(data[offsets[lo] : offsets[hi]], part)
                row = np.searchsorted(part[1:], start, "right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.astype(np.int64)), pa.array(content.astype(np.int64)), pa.array(keys[lo:hi][row]),
                        pa.array((start - part[row]).astype(np.int32)), pa.array(size.astype(np.int16)), pa.array(anchor.astype(np.int16)),
                    ],
                    names=["gram", "content", "doc_key", "start", "size", "anchor"],
                )

    return rows.mapInArrow(run, RUNS)


def column_repeats(data: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string (row) and window start (column, by its distance left of the
    anchor) whether the window's bytes also stand at that column of another string.

    One round a column, from the right: ``order`` holds all suffixes that start at
    the column in lexical order, ``until`` the column up to which each agrees with
    the one before it. A new symbol refines the order stably; what neighbours with
    one symbol have in common is the least of what lay between them before.
    """
    m, size = len(anchors), np.diff(offsets)
    left, right = int(anchors.max(initial=0)), int((size - anchors).max(initial=0))
    first = left - anchors
    upto = first + size
    columns = np.zeros((left + right, m), np.uint8)
    for lo in range(0, m, 1024):  # a row a column
        own = size[lo : lo + 1024]
        row = np.repeat(np.arange(lo, lo + len(own)), own)
        begin, end = offsets[lo], offsets[lo + len(own)]
        columns[np.arange(begin, end) - (offsets[:-1] - first)[row], row] = data[begin:end]
    out = np.zeros((m, left + 1), bool)
    order, until = np.arange(m), np.full(m + 1, left + right)
    for c in range(left + right - 1, -1, -1):
        symbol = np.where((c >= first) & (c < upto), columns[c], np.uint16(256))[order]
        by = np.argsort(symbol, kind="stable")
        sorted_ = symbol[by]
        same = (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] < 256)
        new = np.full(m + 1, c)
        k = np.flatnonzero(same)
        if len(k):
            pairs = np.stack([by[k] + 1, by[k + 1] + 1], 1).reshape(-1)
            new[k + 1] = np.minimum.reduceat(until, pairs)[::2]
        order, until = order[by], new
        until[m] = left + right
        if c <= left:
            hit = np.flatnonzero(until[1:m] >= c + length) + 1
            out[order[hit], left - c] = True
            out[order[hit - 1], left - c] = True
    return out


def _repeat_spans(most: int):
    """Repeated byte ranges of the strings that stand for one run alone; rows come
    sorted by gram, and a gram's strings all go into one construction."""

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        key, start, anchor, single = (rows.column(c).to_numpy() for c in ("doc_key", "start", "anchor", "single"))
        data, offsets = byte_view(rows.column("bytes"))
        found = column_repeats(data, offsets, anchor.astype(np.int64))
        found &= single.astype(bool)[:, None]
        # maximal ranges of window starts, by their distance left of the anchor
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, near = np.nonzero(edge == 1)
        far = np.nonzero(edge == -1)[1] - 1
        at = start[row].astype(np.int64) + anchor[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(key[row]), pa.array((at - far).astype(np.int32)), pa.array((at - near + LENGTH).astype(np.int32))], names=["doc_key", "start", "end"]
        )

    def run(batches):
        held, count, last = [], 0, None
        for batch in batches:
            gram, lo = batch.column(0).to_numpy(), 0
            while lo < len(gram):
                if count >= most and gram[lo] != last:
                    yield finish(held)
                    held, count = [], 0
                hi = min(lo + max(most - count, 0), len(gram)) if count < most else lo
                if hi < len(gram):  # to the end of the gram that is there
                    hi = lo + int(np.searchsorted(gram[lo:], gram[max(hi - 1, lo)], "right"))
                held.append(batch.slice(lo, hi - lo))
                count, last, lo = count + hi - lo, gram[hi - 1], hi
        if held:
            yield finish(held)

    return run


def _cut(width: int):
    """The pieces of ``width`` windows of each run, aligned at its anchor: a hash of
    the core that all windows of such a piece have, and one of the bytes it has."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, start, anchor, single, lo, hi = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_key", "start", "anchor", "single", "lo", "hi"))
            data, offsets = byte_view(batch.column("bytes"))
            size = 1 << int(len(data) + 1).bit_length()
            total = np.zeros(len(data) + 1, U)
            np.cumsum(BYTE_VALUES[data] * _powers(_BASE, size)[: len(data)], out=total[1:])
            inverse = _powers(_INVERSE, size)
            hashed = lambda a, b: mix((total[b] - total[a]) * inverse[a])
            # distances left of the anchor, and the classes of them
            anchor = anchor.astype(np.int64)
            near, far = anchor - hi, anchor - lo
            n = far // width - near // width + 1
            row = np.repeat(np.arange(len(n)), n)
            part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (near // width)[row]
            d0, d1 = np.maximum(part * width, near[row]), np.minimum(part * width + width - 1, far[row])
            at = offsets[:-1][row] + anchor[row]
            core = hashed(at - part * width, at - part * width - width + 1 + LENGTH)
            content = mix(hashed(at - d1, at - d0 + LENGTH) ^ ((d1 - d0) * 1024 + d0).astype(U))
            base = (start + anchor)[row]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("gram").take(pa.array(row)), pa.array(mix(core ^ part.astype(U)).astype(np.int64)), pa.array(content.astype(np.int64)), pa.array(key[row]),
                    pa.array(start[row]), pa.array((base - d1).astype(np.int32)), pa.array((base - d0 + LENGTH).astype(np.int32)), pa.array(single[row]),
                    pa.array((anchor[row] - d1).astype(np.int32)), pa.array((anchor[row] - d0).astype(np.int32)),
                ],
                names=["gram", "part", "content", "doc_key", "run", "start", "end", "single", "lo", "hi"],
            )

    return run


def _hot_spans(hot: DataFrame) -> DataFrame:
    """``SPANS`` of runs around grams that have too many contents to compare."""
    runs = hot.withColumn("lo", F.lit(0)).withColumn("hi", F.octet_length("bytes") - LENGTH)
    pieces = staged(runs.mapInArrow(_cut(WIDTH), PARTS), "pieces")
    which = ["gram", "part"]
    place = F.struct("doc_key", "run", "start", "end", "single", "lo", "hi")
    contents = staged(pieces.groupBy(*which, "content").agg(F.count("*").alias("n"), F.min(place).alias("p")), "piece_contents")
    again = contents.filter("n > 1").select(*which, "content")
    whole = pieces.filter("single").join(again, [*which, "content"]).select("doc_key", "start", "end")
    several = staged(contents.groupBy(*which).agg((F.min("content") < F.max("content")).alias("several")).filter("several").select(*which), "several")
    # one piece of each content, whose windows are compared by count
    left = contents.join(several, which).select("gram", "p.doc_key", F.col("p.run").alias("start"), (F.col("p.single") & (F.col("n") == 1)).alias("single"), "p.lo", "p.hi")
    again = left.join(hot.drop("single"), ["gram", "doc_key", "start"])
    windows = staged(again.select(*runs.columns).mapInArrow(_cut(1), PARTS), "windows")
    seen = windows.groupBy(*which).agg(F.count("*").alias("n")).filter("n > 1").select(*which)
    return whole.unionByName(windows.filter("single").join(staged(seen, "seen"), which).select("doc_key", "start", "end"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_key`` and ``spans``, the repeated byte ranges (overlapping, in order)
    of each document that has any."""
    spark = docs.sparkSession
    runs = staged(_run_table(docs, id_col, text_col), "runs")
    grams = runs.groupBy("gram").agg(F.count("*").alias("n"), (F.min("content") < F.max("content")).alias("several")).filter("n > 1").drop("n")
    grams = staged(grams, "grams")
    given = spark.sparkContext.broadcast(marks(grams, "gram", BITS))
    may = may_hold(given)
    shared = staged(runs.filter(may("gram")).join(grams, "gram"), "shared")
    place = F.struct("doc_key", "start", "size", "anchor")
    contents = staged(shared.groupBy("gram", "content").agg(F.count("*").alias("n"), F.min(place).alias("p"), F.first("several").alias("several")), "contents")
    whole = shared.select("gram", "content", "doc_key", "start", "size").join(contents.filter("n > 1").select("gram", "content"), ["gram", "content"])
    whole = whole.select("doc_key", "start", (F.col("start") + F.col("size")).alias("end"))

    hot = staged(contents.filter("several").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("gram", F.lit(True).alias("hot")), "hot")
    mixed = contents.filter("several").join(hot, "gram", "left").select("gram", (F.col("n") == 1).alias("single"), F.coalesce("hot", F.lit(False)).alias("hot"), "p.*")
    asked = staged(mixed.groupBy("doc_key").agg(F.collect_list(F.struct("gram", "single", "hot", "start", "size", "anchor")).alias("asked")), "asked")
    regions = staged(_regions(_rows_with(docs, asked, id_col, text_col)), "regions")
    few = regions.filter("not hot").drop("hot").repartition(partitions(spark), "gram").sortWithinPartitions("gram")
    parts = staged(few.mapInArrow(_repeat_spans(STRINGS), SPANS), "parts")
    many = regions.filter("hot").drop("hot")
    if not hot.isEmpty():
        parts = parts.unionByName(staged(_hot_spans(many), "hot_spans"))
    every = whole.unionByName(parts).groupBy("doc_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return staged(every, "spans")


def _rows_with(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts of documents in ``keys`` with its other columns; a bitmap of fixed
    size spares others the shuffle. Of repeated rows all are there."""
    given = docs.sparkSession.sparkContext.broadcast(marks(keys, "doc_key"))
    may = may_hold(given)
    rows = docs.select(text_key(id_col, text_col).alias("doc_key"), F.col(f"`{text_col}`").alias("text"))
    return rows.filter(may("doc_key")).join(keys, "doc_key")


def _regions(rows: DataFrame) -> DataFrame:
    """The bytes of the runs that are asked for, one for each run."""
    rows = rows.dropDuplicates(["doc_key"]).select("doc_key", "text", "asked")

    def run(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            lists = batch.column(2)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            asked = dict(zip(("gram", "single", "hot", "start", "size", "anchor"), lists.flatten().flatten(), strict=True))
            first = offsets[:-1][row] + asked["start"].to_numpy()
            size = asked["size"].to_numpy().astype(np.int64)
            for lo in range(0, len(row), 20_000):
                f, n = first[lo : lo + 20_000], size[lo : lo + 20_000]
                upto = np.concatenate([[0], np.cumsum(n)])
                raw = data[np.repeat(f - upto[:-1], n) + np.arange(upto[-1])]
                bytes_ = pa.Array.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(raw)])
                sub = {k: v.slice(lo, 20_000) for k, v in asked.items()}
                yield pa.RecordBatch.from_arrays(
                    [sub["gram"], batch.column(0).take(pa.array(row[lo : lo + 20_000])), sub["start"], sub["anchor"], sub["single"], sub["hot"], bytes_],
                    names=["gram", "doc_key", "start", "anchor", "single", "hot", "bytes"],
                )

    return rows.mapInArrow(run, REGIONS)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """``doc_id`` and ``RESULT`` for each document, with the ``kept`` bytes if asked."""
    spans = repeated_spans(docs, id_col, text_col)
    given = docs.sparkSession.sparkContext.broadcast(marks(spans, "doc_key"))
    schema = f"doc_id long, {RESULT}" + ", kept binary" * keep_bytes

    def run(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            out = []
            for i in range(len(offsets) - 1):
                text = data[offsets[i] : offsets[i + 1]]
                pairs = batch.column(2)[i]
                if not pairs.is_valid or not len(pairs):
                    out.append((len(text), 0, 0, text))
                    continue
                flat = pairs.values.flatten()
                a, b = (x.to_numpy() for x in flat)
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, b, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((len(text), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), text[~gone]))
            new = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            new.append(pa.array([hashlib.sha256(x[3].tobytes()).hexdigest() for x in out], pa.string()))
            if keep_bytes:
                new.append(pa.array([x[3].tobytes() for x in out], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes])

    may = may_hold(given)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), text_key(id_col, text_col).alias("doc_key"))
    rows = rows.withColumn("maybe", may("doc_key"))
    some = rows.filter("maybe").join(spans, "doc_key", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    zero = F.lit(0).cast("long")
    rest = rows.filter("not maybe").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"),
        *[text.alias("kept")] * keep_bytes,
    )
    return rest.unionByName(some)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
