"""Smooth Streaming manifests through ``from_xml``; times in units of 100 ns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fragment_url
from ..schemas import ENCRYPTION, ISM
from .dash import _long, _or

UNITS = 10_000_000
#: Codec names by FourCC.
CODECS = {
    "H264": "avc1", "AVC1": "avc1", "H265": "hev1", "HEVC": "hev1", "HEV1": "hev1", "AV01": "av01", "VP09": "vp09", "VP9": "vp09",
    "AACL": "mp4a.40.2", "AAC": "mp4a.40.2", "EC-3": "ec-3", "EC3": "ec-3", "EAC3": "ec-3", "AC-3": "ac-3", "AC3": "ac-3", "OPUS": "opus", "FLAC": "fLaC",
}


def codec_of(fourcc: Column) -> Column:
    """The codec of a FourCC in any case, or the FourCC in lower case."""
    known = F.create_map(*(F.lit(x) for pair in CODECS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.upper(fourcc)), F.lower(fourcc))


def _levels(manifests: DataFrame) -> DataFrame:
    body = F.regexp_replace(F.col("body"), r"(?s)^.*?(<SmoothStreamingMedia[\s>])", "$1")
    rows = manifests.select("manifest_id", "url", F.from_xml(body, ISM).alias("m")).select("*", F.posexplode("m.StreamIndex").alias("i", "s"))
    rows = rows.filter(_or(F.col("s._Type")) != "text").select("*", F.posexplode("s.QualityLevel").alias("j", "q"))
    order = Window.partitionBy("manifest_id").orderBy("i", "j")
    return rows.withColumn("stream_idx", F.row_number().over(order) - 1).withColumn("total", _long(F.col("m._Duration")))


def streams(manifests: DataFrame) -> DataFrame:
    """``STREAMS`` of every quality level but those of text."""
    rows = _levels(manifests)
    kind, w, h, ch = _or(F.col("s._Type")), _long(F.col("q._MaxWidth")), _long(F.col("q._MaxHeight")), _long(F.col("q._Channels"))
    name = _or(F.col("s._Name"))
    counts = segments(manifests).groupBy("manifest_id", "stream_idx").agg(F.count("*").alias("segments_count"))
    out = rows.select(
        "manifest_id", "stream_idx", F.when(kind.isin("video", "audio"), kind).otherwise("").alias("media_type"), F.lit("").alias("group_id"),
        _or(F.col("s._Language")).alias("language"), F.when(h > 0, F.format_string("%s_%dp", name, h)).otherwise(name).alias("name"),
        _long(F.col("q._Bitrate")).alias("bandwidth"), codec_of(_or(F.col("q._FourCC"))).alias("codecs"),
        F.when((kind == "video") & (w > 0) & (h > 0), F.format_string("%dx%d", w, h)).otherwise("").alias("resolution"), F.lit(0.0).alias("frame_rate"),
        F.when((kind == "audio") & (ch > 0), ch.cast("string")).otherwise("").alias("channels"),
        *(F.lit("").alias(c) for c in ("extension", "video_range", "role")), "url",
    )
    return out.join(counts, ["manifest_id", "stream_idx"], "left").fillna(0, ["segments_count"])


def segments(manifests: DataFrame) -> DataFrame:
    """``SEGMENTS``: explicit chunks, whose time 0 after the first one means the end
    of the one before; or the total dealt into the stated number of chunks."""
    rows = _levels(manifests)
    zero = F.lit(0).cast("bigint")
    n = _long(F.col("s._Chunks"))
    each = F.floor(F.col("total") / n).cast("bigint")
    made = F.transform(F.sequence(zero, n - 1), lambda i: F.struct((i * each).alias("t"), each.alias("d")))
    told = F.transform(F.coalesce(F.col("s.c"), F.array()), lambda c: F.struct(_long(c["_t"]).alias("t"), _long(c["_d"]).alias("d")))
    chunks = F.when(F.size("s.c") > 0, told).when((n > 0) & (F.col("total") > 0), made)
    start = F.struct(zero.alias("end"), F.array().cast("array<struct<t: bigint, d: bigint>>").alias("out"))

    def step(acc, c):
        t = F.when((c["t"] == 0) & (F.size(acc["out"]) > 0), acc["end"]).otherwise(c["t"])
        return F.struct((t + c["d"]).alias("end"), F.array_append(acc["out"], F.struct(t.alias("t"), c["d"].alias("d"))).alias("out"))

    rows = rows.select("*", F.posexplode(F.aggregate(chunks, start, step)["out"]).alias("pos", "c"))
    return rows.select(
        "manifest_id", "stream_idx", F.lit(0).alias("part_idx"), "pos", F.col("pos").cast("bigint").alias("seg_index"), (F.col("c.d") / UNITS).alias("duration_s"),
        fragment_url(F.col("url"), _long(F.col("q._Bitrate")), _or(F.col("s._Name")), F.col("c.t")).alias("url"),
        F.lit(None).cast("bigint").alias("range_start"), F.lit(None).cast("bigint").alias("range_len"), F.lit(None).cast(ENCRYPTION).alias("enc"),
    )


def playlists(manifests: DataFrame) -> DataFrame:
    """``PLAYLISTS``: the live flag is the manifest's."""
    live = F.lower(_or(F.col("m._IsLive"))).isin("true", "1", "t")
    return _levels(manifests).select(
        "manifest_id", "stream_idx", live.alias("is_live"), F.lit(0.0).alias("refresh_ms"), (F.greatest(F.col("total"), F.lit(0)) / UNITS).alias("total_duration_s"),
        F.lit(None).cast("double").alias("target_duration_s"),
        F.lit(None).cast("struct<url: string, range_start: bigint, range_len: bigint>").alias("init"),
    )
