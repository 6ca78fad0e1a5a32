"""MP4 boxes: one row a box, fields decoded as columns.

``files`` has ``file_id`` and ``content``, as from ``binaryFile``. Offsets are those
of the published container format. A file is walked within one task; bodies over
``MOST`` bytes are left out (their place and size are there).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import fixed16, packed_language, take, text4, uint
from ..schemas import BOXES

MOST = 10 << 20
CONTAINERS = frozenset("moov trak mdia minf stbl edts dinf mvex moof traf sinf schi rinf hnti hinf strk strd".split())
#: Bytes of a sample entry before its own boxes.
VIDEO, AUDIO = 78, 28
ENTRIES = {**dict.fromkeys("avc1 avc3 hvc1 hev1 av01 vp08 vp09 encv dvh1 dvhe".split(), VIDEO), **dict.fromkeys("mp4a enca ac-3 ec-3 Opus fLaC".split(), AUDIO)}
SUBTITLE_HANDLERS = ("sbtl", "text")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")


def _walk(data: bytes, start: int, end: int, path: tuple[str, ...]) -> Iterator[tuple]:
    """(path, size, offset of the box, body) of all boxes, parents first."""
    at = start
    while at + 8 <= end:
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        stop, here = min(at + size, end), (*path, kind)
        body = at + head
        yield here, size, at, (body, stop)
        inner = 8 if kind == "stsd" else 4 if kind == "meta" else ENTRIES.get(kind) if path[-1:] == ("stsd",) else 0 if kind in CONTAINERS else None
        if inner is not None and body + inner <= stop:
            yield from _walk(data, body + inner, stop, here)
        at += size


def boxes(files: DataFrame, most: int = MOST) -> DataFrame:
    """``BOXES`` of every file, in order of their places."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(p, s, o, content[a:b] if b - a <= most else None) for p, s, o, (a, b) in _walk(content or b"", 0, len(content or b""), ())]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * n, pa.string()), pa.array([list(r[0]) for r in rows], pa.list_(pa.string())), pa.array([len(r[0]) - 1 for r in rows], pa.int32()),
                        pa.array(range(n), pa.int32()), pa.array([r[0][-1] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()),
                    ],
                    names=["file_id", "path", "depth", "pos", "box_type", "size", "offset", "body"],
                )

    return files.select(F.col("file_id").cast("string"), F.col("content").cast("binary")).mapInArrow(run, BOXES)


def is_container(kind: Column) -> Column:
    return kind.isin(*sorted(CONTAINERS))


def in_tracks(rows: DataFrame) -> DataFrame:
    """Boxes inside tracks, with the ``track`` they belong to (0, 1, ... by place)."""
    order = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    track = F.sum(F.when((F.col("box_type") == "trak"), 1).otherwise(0)).over(order) - 1
    return rows.withColumn("track", track).filter(F.array_contains("path", "trak"))


def _full(body: Column, v0: int, v1: int) -> Column:
    """An offset by the version in a full box's first byte."""
    return F.when(uint(body, 0, 1) == 1, v1).otherwise(v0)


def tracks(rows: DataFrame) -> DataFrame:
    """One row a track: id, size, timescale, language, handler, codec."""
    b = F.col("body")
    of = lambda kind, value: F.max_by(F.when(F.col("box_type") == kind, value), F.when(F.col("box_type") == kind, F.col("pos")))
    return in_tracks(rows).groupBy("file_id", "track").agg(
        of("tkhd", uint(b, _full(b, 12, 20), 4)).alias("track_id"),
        of("tkhd", fixed16(b, _full(b, 76, 88))).cast("int").alias("width"),
        of("tkhd", fixed16(b, _full(b, 80, 92))).cast("int").alias("height"),
        of("mdhd", uint(b, _full(b, 12, 20), 4)).alias("timescale"),
        of("mdhd", packed_language(b, _full(b, 20, 32))).alias("language"),
        of("hdlr", text4(b, 8)).alias("handler"),
        of("stsd", text4(b, 12)).alias("codec"),
    )


def subtitle_tracks(rows: DataFrame) -> DataFrame:
    return tracks(rows).filter(F.col("handler").isin(*SUBTITLE_HANDLERS))


def init_info(rows: DataFrame) -> DataFrame:
    """One row a file: size, timescale, duration and codecs of its init segment."""
    t = tracks(rows).groupBy("file_id").agg(
        F.max("width").alias("width"), F.max("height").alias("height"), F.min_by("timescale", "track").alias("timescale"),
        F.max_by("track_id", "track").alias("track_id"), F.array_sort(F.collect_set("codec")).alias("codecs"), (F.max("width") > 0).alias("has_video"),
        F.max(F.col("handler") == "soun").alias("has_audio"),
    )
    b = F.col("body")
    movie = rows.filter("box_type = 'mvhd'").select("file_id", uint(b, _full(b, 12, 20), 4).alias("movie_timescale"), uint(b, _full(b, 16, 24), 4).alias("duration"))
    return t.join(movie, "file_id", "left")


# --- sample tables -----------------------------------------------------------


def _table(body: Column, count_at: int, width: int, fields: dict[str, tuple[int, int]]) -> Column:
    """Rows of a table: a count, then entries of ``width`` bytes with fields."""
    n = F.least(uint(body, count_at, 4), F.floor((F.octet_length(body) - count_at - 4) / width).cast("bigint"))
    at = lambda i: F.lit(count_at + 4) + (i * width)
    entry = lambda i: F.struct(*(uint(body, at(i) + o, w).alias(k) for k, (o, w) in fields.items()))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), entry)).otherwise(F.array())


def stsz(body: Column) -> Column:
    """Sample sizes; a common size is repeated."""
    common, n = uint(body, 4, 4), uint(body, 8, 4)
    each = F.transform(_table(body, 8, 4, {"size": (0, 4)}), lambda x: x["size"])
    return F.when((common > 0) & (F.octet_length(body) == 12), F.array_repeat(common, F.least(n, F.lit(2**31 - 16)).cast("int"))).otherwise(each)


def stco(body: Column) -> Column:
    return F.transform(_table(body, 4, 4, {"offset": (0, 4)}), lambda x: x["offset"])


def co64(body: Column) -> Column:
    return F.transform(_table(body, 4, 8, {"offset": (0, 8)}), lambda x: x["offset"])


def stsc(body: Column) -> Column:
    return _table(body, 4, 12, {"first_chunk": (0, 4), "samples": (4, 4)})


def stts(body: Column) -> Column:
    return _table(body, 4, 8, {"count": (0, 4), "delta": (4, 4)})


def samples(rows: DataFrame, files: DataFrame, timescale: int | None = None) -> DataFrame:
    """Every sample of every track: place in the file, time and bytes.

    Chunk runs are looked up by the running last run of each chunk; a sample's
    offset is its chunk's plus the sizes before it there; its time is the running
    sum of run-length deltas over the track's timescale (or a given one).
    """
    from ..operators.ordered import chunk_of, expanded

    b, key = F.col("body"), ["file_id", "track"]
    t = in_tracks(rows)
    # guarded, since an inferred filter may try the value on other boxes too
    one = lambda kind, value: t.filter(F.col("box_type") == kind).select(*key, F.when(F.col("box_type") == kind, value).alias("v"))
    sizes = one("stsz", stsz(b)).select(*key, F.posexplode("v").alias("idx", "size"))
    chunks = one("stco", stco(b)).unionByName(one("co64", co64(b))).select(*key, F.posexplode("v").alias("c", "chunk_offset"))
    chunks = chunks.select(*key, (F.col("c") + 1).cast("bigint").alias("chunk"), "chunk_offset")
    entries = one("stsc", stsc(b)).select(*key, F.posexplode("v").alias("p", "e")).select(*key, "p", F.col("e.first_chunk").alias("first_chunk"), F.col("e.samples").alias("samples"))
    dealt = chunk_of(entries, chunks, key, "first_chunk", "chunk", "p").filter("entry.samples > 0")
    w = Window.partitionBy(*key).orderBy("chunk")
    before = F.coalesce(F.sum("entry.samples").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.withColumn("first", before).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("entry.samples") - 1)))
    dealt = dealt.select(*key, (F.col("first") + F.col("k")).cast("int").alias("idx"), "chunk", "chunk_offset")
    placed = dealt.join(sizes, [*key, "idx"])
    within = Window.partitionBy(*key, "chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.col("chunk_offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    times = one("stts", stts(b)).select(*key, F.posexplode("v").alias("p", "e")).select(*key, "p", F.col("e.count").alias("count"), F.col("e.delta").alias("delta"))
    times = expanded(times.filter("count > 0"), F.col("count") - 1)
    order = Window.partitionBy(*key).orderBy("p", "rep")
    times = times.withColumn("idx", F.row_number().over(order) - 1)
    times = times.withColumn("t", F.coalesce(F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    scales = tracks(rows).select(*key, "track_id", (F.lit(timescale) if timescale else F.col("timescale")).alias("scale"))
    out = placed.join(times.select(*key, "idx", "t", "delta"), [*key, "idx"], "left").join(scales, key).join(files, "file_id")
    return out.select(
        *key, "track_id", "idx", "offset", "size", (F.col("t") / F.col("scale")).alias("start_s"), (F.col("delta") / F.col("scale")).alias("duration_s"),
        take(F.col("content"), F.col("offset"), F.col("size")).alias("data"),
    )


def subtitle_samples(rows: DataFrame, files: DataFrame, timescale: int = 1000) -> DataFrame:
    """Samples of subtitle tracks; the timescale is 1000 unless another is given."""
    return samples(rows, files, timescale).join(subtitle_tracks(rows).select("file_id", "track"), ["file_id", "track"], "left_semi")


# --- encryption --------------------------------------------------------------


def protections(rows: DataFrame) -> DataFrame:
    """Scheme and default key parameters of each protected track."""
    b = F.col("body")
    of = lambda kind, value: F.max(F.when(F.col("box_type") == kind, value))
    iv_size = uint(b, 7, 1)
    constant = F.when((uint(b, 6, 1) == 1) & (iv_size == 0), take(b, 25, uint(b, 24, 1)))
    return in_tracks(rows).filter(F.array_contains("path", "sinf")).groupBy("file_id", "track").agg(
        of("frma", text4(b, 0)).alias("format"), of("schm", text4(b, 4)).alias("scheme"), of("tenc", uint(b, 6, 1)).cast("int").alias("is_protected"),
        of("tenc", iv_size).cast("int").alias("iv_size"), of("tenc", take(b, 8, 16)).alias("key_id"), of("tenc", constant).alias("constant_iv"),
    )


def systems(rows: DataFrame) -> DataFrame:
    """Protection system headers: system, key ids (version 1) and data."""
    b = F.col("body")
    v1 = uint(b, 0, 1) == 1
    n = F.when(v1, uint(b, 20, 4)).otherwise(F.lit(0))
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: take(b, F.lit(24) + i * 16, 16))).otherwise(F.array().cast("array<binary>"))
    at = F.when(v1, 24 + n * 16).otherwise(20)
    return rows.filter("box_type = 'pssh'").select("file_id", "pos", take(b, 4, 16).alias("system_id"), ids.alias("key_ids"), take(b, at + 4, uint(b, at, 4)).alias("data"))


SENC = "file_id string, pos int, idx int, iv binary, subsamples array<struct<clear: int, encrypted: bigint>>"


def sample_encryption(rows: DataFrame, iv_size: int = 8) -> DataFrame:
    """IV and subsample sizes of each sample of ``senc`` boxes."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for file, pos, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                flags, n, at = int.from_bytes(body[1:4], "big"), int.from_bytes(body[4:8], "big"), 8
                for i in range(n):
                    iv, subs = body[at : at + iv_size], []
                    at += iv_size
                    if flags & 2:
                        count = int.from_bytes(body[at : at + 2], "big")
                        for k in range(at + 2, at + 2 + 6 * count, 6):
                            subs.append({"clear": int.from_bytes(body[k : k + 2], "big"), "encrypted": int.from_bytes(body[k + 2 : k + 6], "big")})
                        at += 2 + 6 * count
                    if at > len(body):
                        break
                    for column, value in zip(out, (file, pos, i, iv, subs), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("clear", pa.int32()), ("encrypted", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["file_id", "pos", "idx", "iv", "subsamples"])

    return rows.filter("box_type = 'senc' and body is not null").select("file_id", "pos", "body").mapInArrow(run, SENC)


# --- rewriting fragments -----------------------------------------------------


def box(kind: Column, body: Column) -> Column:
    """The bytes of a box. The body is bound once, as boxes are nested deeply."""
    whole = lambda b: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b) + 8), 8, "0")), F.encode(kind, "ISO-8859-1"), b)
    return F.get(F.transform(F.array(body), whole), F.lit(0))


def patched(data: Column, kind: str, value: Column) -> Column:
    """A fragment whose boxes of a kind below ``moof`` have a number in the four
    bytes after their flags; boxes are walked, so that equal bytes elsewhere stay."""

    @F.pandas_udf(T.BinaryType())
    def patch(data: pd.Series, value: pd.Series) -> pd.Series:
        out = []
        for d, v in zip(data, value, strict=True):
            b = None if d is None else bytearray(d)
            for path, _, _, (at, end) in _walk(bytes(d), 0, len(d), ()) if d is not None and not pd.isna(v) else ():
                if path[0] == "moof" and path[-1] == kind and end - at >= 8:
                    b[at + 4 : at + 8] = int(v).to_bytes(4, "big")
            out.append(b if b is None else bytes(b))
        return pd.Series(out, dtype=object)

    return patch(data, value.cast("bigint"))


def renumbered(fragments: DataFrame, by: list[str], order: list[str], data: str = "data") -> DataFrame:
    """Fragments with the sequence numbers of their ``mfhd`` counted from 1 in order."""
    rows = fragments.withColumn("sequence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return rows.withColumn(data, patched(F.col(data), "mfhd", F.col("sequence")))
