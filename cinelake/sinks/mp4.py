"""An MP4 file as one binary column, from sample and track tables.

Layout and tables are windows and aggregates; boxes are column expressions after
the published container format. A file is one row, so one file is bounded by the
size of a binary value (2 GiB); files are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import concatenated, interleaved, runs
from ..sources.boxes import box, patched

MOVIE_SCALE = 90000
_MATRIX = bytes.fromhex("00010000" + "00" * 12 + "00010000" + "00" * 12 + "40000000")


def number(value: Column, n: int) -> Column:
    """A number as n big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n, "0"))


def numbers(values: Column) -> Column:
    """An array of numbers as four bytes each."""
    return F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x.cast("bigint")), 8, "0")), ""))


def _b(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, bytes) else p for p in parts))


def _box(kind: str, *parts) -> Column:
    return box(F.lit(kind), _b(*parts) if parts else F.lit(b""))


def elementary_config(object_type: Column, rate_index: Column, channels: Column) -> Column:
    """An ``esds`` box with the two bytes that an AAC decoder needs."""
    specific = number(F.shiftleft(object_type.cast("bigint"), 11).bitwiseOR(F.shiftleft(rate_index.cast("bigint"), 7)).bitwiseOR(F.shiftleft(channels.cast("bigint"), 3)), 2)
    decoder = _b(b"\x04\x11\x40\x15", bytes(11), b"\x05\x02", specific)
    return _box("esds", bytes(4), b"\x03\x19\x00\x01\x00", decoder, b"\x06\x01\x02")


def _entry(t: Column) -> Column:
    """A sample entry: picture or sound fields, then the decoder's own box."""
    config = F.coalesce(t["config"], F.lit(b""))
    picture = _b(bytes(6), b"\0\1", bytes(16), number(t["width"], 2), number(t["height"], 2), bytes.fromhex("0048000000480000"), bytes(4), b"\0\1", bytes(32), b"\0\x18\xff\xff", config)
    sound = _b(bytes(6), b"\0\1", bytes(8), number(t["channels"], 2), b"\0\x10", bytes(4), number(t["sample_rate"], 2), bytes(2), config)
    return box(t["entry"], F.when(t["kind"] == "video", picture).otherwise(sound))


def _track(t: Column, number_: Column, base: Column) -> Column:
    """A track box; chunk offsets count from ``base``."""
    n, keys = F.size(t["sizes"]), t["keys"]
    stts = _box("stts", bytes(4), number(F.size(t["runs"]), 4), numbers(F.flatten(F.transform(t["runs"], lambda r: F.array(r["n"], r["duration"])))))
    stss = F.when((t["kind"] == "video") & (F.size(keys) > 0) & (F.size(keys) < n), _box("stss", bytes(4), number(F.size(keys), 4), numbers(keys))).otherwise(F.lit(b""))
    stsc = _box("stsc", bytes(4), number(F.lit(1), 4), numbers(F.array(*map(F.lit, (1, 1, 1)))))
    stsz = _box("stsz", bytes(8), number(n, 4), numbers(t["sizes"]))
    stco = _box("stco", bytes(4), number(n, 4), numbers(F.transform(t["offsets"], lambda o: o + base)))
    stbl = _box("stbl", _box("stsd", bytes(4), b"\0\0\0\1", _entry(t)), stts, stss, stsc, stsz, stco)
    dinf = _box("dinf", _box("dref", bytes(4), b"\0\0\0\1", _box("url ", b"\0\0\0\1")))
    media = F.when(t["kind"] == "video", _box("vmhd", b"\0\0\0\1", bytes(8))).otherwise(_box("smhd", bytes(8)))
    handler = F.when(t["kind"] == "video", F.lit(b"vide")).otherwise(F.lit(b"soun"))
    mdia = _box("mdia", _box("mdhd", bytes(12), number(t["timescale"], 4), number(t["total"], 4), b"\x55\xc4\0\0"), _box("hdlr", bytes(8), handler, bytes(13)), _box("minf", media, dinf, stbl))
    volume = F.when(t["kind"] == "video", F.lit(b"\0\0")).otherwise(F.lit(b"\1\0"))
    tkhd = _box("tkhd", b"\0\0\0\7", bytes(8), number(number_, 4), bytes(4), number(t["total"] * MOVIE_SCALE / t["timescale"], 4), bytes(12), volume, b"\0\0", _MATRIX, number(t["width"], 2), b"\0\0", number(t["height"], 2), b"\0\0")
    return _box("trak", tkhd, mdia)


def _moov(tracks: Column, base: Column) -> Column:
    longest = F.array_max(F.transform(tracks, lambda t: (t["total"] * MOVIE_SCALE / t["timescale"]).cast("bigint")))
    mvhd = _box("mvhd", bytes(12), number(F.lit(MOVIE_SCALE), 4), number(longest, 4), b"\0\1\0\0\1\0", bytes(10), _MATRIX, bytes(24), number(F.size(tracks) + 1, 4))
    traks = F.aggregate(F.transform(tracks, lambda t, i: _track(t, i + 1, base)), F.lit(b""), lambda acc, x: F.concat(acc, x))
    return _box("moov", mvhd, traks)


def mux(samples: DataFrame, tracks: DataFrame) -> DataFrame:
    """``file_id`` and ``content``: video and audio of each file in one container.

    ``samples``: ``file_id``, ``kind`` (video, audio), ``idx``, ``pts``, ``duration``,
    ``is_key``, ``data``. ``tracks``: ``file_id``, ``kind``, ``entry`` (sample entry
    name), ``timescale``, ``width``, ``height``, ``channels``, ``sample_rate``,
    ``config`` (the decoder's box). Samples are interleaved by time, video first on
    ties, one chunk each; runs of equal durations are one entry.
    """
    rows = samples.withColumn("size", F.octet_length("data").cast("bigint"))
    laid = interleaved(rows.filter("kind = 'video'"), rows.filter("kind != 'video'"), "pts", ["file_id"], ["idx"], "size")
    by = ["file_id", "kind"]
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(c).alias("v")))), lambda x: x["v"])
    lists = laid.groupBy(*by).agg(in_order("size").alias("sizes"), in_order("offset").alias("offsets"), in_order("is_key").alias("k"), F.sum("duration").alias("total"))
    keys = F.filter(F.transform("k", lambda k, i: F.when(k, i + 1)), lambda i: i.isNotNull())
    r = runs(rows, "duration", by, ["idx"]).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("run", "n", "duration"))).alias("runs"))
    whole = lists.withColumn("keys", keys).drop("k").join(r, by).join(tracks, by)
    fields = [c for c in whole.columns if c != "file_id"]
    # video sorts after audio by name, and comes first in the file
    order = F.struct((F.col("kind") != "video").alias("o"), F.struct(*fields).alias("t"))
    files = whole.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["t"]).alias("tracks"))
    media = concatenated(laid, "data", ["file_id"], ["place"])
    ftyp = _box("ftyp", b"isom\0\0\2\0isomiso2avc1mp41")
    rows = files.join(media, "file_id").withColumn("size_of_moov", F.octet_length(_moov(F.col("tracks"), F.lit(0))))
    base = F.octet_length(ftyp) + F.col("size_of_moov") + 8
    return rows.select("file_id", F.concat(ftyp, _moov(F.col("tracks"), base), _box("mdat", F.col("data"))).alias("content"))


def retracked(fragments: DataFrame, track: Column, data: str = "data") -> DataFrame:
    """Fragments whose ``tfhd`` boxes, every one, name another track."""
    return fragments.withColumn(data, patched(F.col(data), "tfhd", track))
