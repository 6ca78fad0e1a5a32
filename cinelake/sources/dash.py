"""DASH manifests through ``from_xml``: streams, playlists and segments.

A stream is a representation of an adaptation set of a period. Timelines are
expanded from run lengths and clocks are running sums: expressions over arrays
within a manifest's row, then one explode; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill_template, frame_rate, iso_duration, join_path, to_long
from ..schemas import ENCRYPTION, MPD


def _long(c: Column) -> Column:
    return to_long(F.coalesce(c, F.lit("")))


def _or(c: Column, other: str = "") -> Column:
    return F.coalesce(c, F.lit(other))


def representations(manifests: DataFrame) -> DataFrame:
    """One row a stream, in document order, with its period ``p``, adaptation set
    ``a``, representation ``r`` and the total duration."""
    body = F.regexp_replace(F.col("body"), r"(?s)^.*?(<(?:\w+:)?MPD[\s>])", "$1")
    rows = manifests.select("manifest_id", "url", F.from_xml(body, MPD).alias("m"))
    rows = rows.select("manifest_id", "url", "m", F.posexplode("m.Period").alias("i", "p"))
    rows = rows.select("*", F.posexplode("p.AdaptationSet").alias("j", "a"))
    rows = rows.select("*", F.posexplode("a.Representation").alias("k", "r"))
    total = iso_duration(F.col("m._mediaPresentationDuration"))
    from pyspark.sql import Window

    order = Window.partitionBy("manifest_id").orderBy("i", "j", "k")
    return rows.select(
        "manifest_id", "url", "p", "a", "r", (F.row_number().over(order) - 1).alias("stream_idx"),
        F.when(total != 0, total).otherwise(iso_duration(F.col("p._duration"))).alias("total_duration_s"),
    )


def streams(manifests: DataFrame) -> DataFrame:
    """``STREAMS`` of DASH manifests."""
    rows = representations(manifests)
    kind = F.lit("")
    for name, prefix in (("subtitles", "text"), ("audio", "audio"), ("video", "video")):
        kind = F.when((_or(F.col("a._contentType")) == prefix) | _or(F.col("a._mimeType")).startswith(prefix + "/"), name).otherwise(kind)
    w, h = _long(F.col("r._width")), _long(F.col("r._height"))
    counts = segments(manifests).groupBy("manifest_id", "stream_idx").agg(F.count("*").alias("segments_count"))
    base = F.get(F.col("r.BaseURL"), F.lit(0))
    out = rows.select(
        "manifest_id", "stream_idx", kind.alias("media_type"), F.lit("").alias("group_id"), _or(F.col("a._lang")).alias("language"),
        F.when(_or(F.col("r._id")) != "", F.col("r._id")).otherwise(_or(F.col("a._id"))).alias("name"),
        _long(F.col("r._bandwidth")).alias("bandwidth"), _or(F.col("r._codecs")).alias("codecs"),
        F.when((w > 0) & (h > 0), F.format_string("%dx%d", w, h)).when(kind == "video", "unknown").otherwise("").alias("resolution"),
        F.coalesce(frame_rate(F.col("r._frameRate")), F.lit(0.0)).alias("frame_rate"),
        *(F.lit("").alias(c) for c in ("channels", "extension", "video_range", "role")),
        F.when(base.isNotNull(), join_path(F.col("url"), base)).otherwise(F.col("url")).alias("url"),
    )
    return out.join(counts, ["manifest_id", "stream_idx"], "left").fillna(0, ["segments_count"])


def _timeline(t: Column) -> Column:
    """(number from 0, time, duration) of each segment of run-length entries.

    An entry with a time above 0 sets the clock; a run of r repeats is r + 1
    segments, and a negative r one.
    """
    entries = F.transform(
        t, lambda s: F.struct(_long(s["_t"]).alias("t"), _long(s["_d"]).alias("d"), (F.greatest(_long(s["_r"]), F.lit(0)) + 1).cast("bigint").alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("clock"), zero.alias("n"), F.array().cast("array<struct<n: bigint, t: bigint, d: bigint, first: bigint>>").alias("runs"))

    def step(acc, e):
        at = F.when(e["t"] > 0, e["t"]).otherwise(acc["clock"])
        run = F.struct(e["n"].alias("n"), at.alias("t"), e["d"].alias("d"), acc["n"].alias("first"))
        return F.struct((at + e["n"] * e["d"]).alias("clock"), (acc["n"] + e["n"]).alias("n"), F.array_append(acc["runs"], run).alias("runs"))

    runs = F.aggregate(entries, start, step)["runs"]
    expand = lambda r: F.transform(F.sequence(zero, r["n"] - 1), lambda i: F.struct((r["first"] + i).alias("i"), (r["t"] + i * r["d"]).alias("time"), r["d"].alias("d")))
    return F.flatten(F.transform(runs, expand))


def _addressing(rows: DataFrame) -> DataFrame:
    """Which of template (representation's first), list (adaptation set's first) or
    a single address applies, with timescale and start number."""
    st = F.coalesce("r.SegmentTemplate", "a.SegmentTemplate")
    sl = F.coalesce("a.SegmentList", "r.SegmentList")
    rows = rows.withColumn("st", st).withColumn("sl", F.when(st.isNull(), sl))
    from_ = lambda name: _long(F.coalesce(F.col(f"st.{name}"), F.col(f"sl.{name}")))
    nonzero = lambda c: F.when(c == 0, 1).otherwise(c)
    return rows.withColumn("scale", nonzero(from_("_timescale"))).withColumn("first", nonzero(from_("_startNumber")))


def segments(manifests: DataFrame) -> DataFrame:
    """``SEGMENTS`` of DASH manifests; a fixed duration gives as many whole segments
    as the total has, one at least."""
    rows = _addressing(representations(manifests))
    fixed = _long(F.col("st._duration"))
    zero = F.lit(0).cast("bigint")
    count = F.greatest(F.floor(F.col("total_duration_s") / (fixed / F.col("scale"))).cast("bigint"), F.lit(1).cast("bigint"))
    uniform = F.transform(F.sequence(zero, count - 1), lambda i: F.struct(i.alias("i"), (i * fixed).alias("time"), fixed.alias("d")))
    listed = F.transform(
        F.col("sl.SegmentURL"), lambda s, i: F.struct(i.cast("bigint").alias("i"), zero.alias("time"), _long(F.col("sl._duration")).alias("d"))
    )
    parts = F.when(F.col("st.SegmentTimeline").isNotNull(), _timeline(F.coalesce(F.col("st.SegmentTimeline.S"), F.array()))).when(
        F.col("st").isNotNull(), F.when(fixed > 0, uniform)
    ).otherwise(listed)
    rows = rows.withColumn("seg", F.explode(parts))
    number = F.col("first") + F.col("seg.i")
    ref = F.when(F.col("st").isNotNull(), fill_template(_or(F.col("st._media")), number, F.col("seg.time"), F.col("scale"))).otherwise(
        _or(F.get(F.col("sl.SegmentURL"), F.col("seg.i").cast("int"))["_media"])
    )
    return rows.select(
        "manifest_id", "stream_idx", F.lit(0).alias("part_idx"), F.col("seg.i").cast("int").alias("pos"), number.alias("seg_index"),
        (F.col("seg.d") / F.col("scale")).alias("duration_s"), join_path(F.col("url"), ref).alias("url"),
        F.lit(None).cast("bigint").alias("range_start"), F.lit(None).cast("bigint").alias("range_len"), F.lit(None).cast(ENCRYPTION).alias("enc"),
    )


def playlists(manifests: DataFrame) -> DataFrame:
    """``PLAYLISTS`` of DASH manifests; never live."""
    rows = _addressing(representations(manifests))
    zero = F.lit(0).cast("bigint")
    template = fill_template(F.col("st._initialization"), zero, zero, F.col("scale"))
    ref = F.when(_or(F.col("st._initialization")) != "", template).when(_or(F.col("sl.Initialization._sourceURL")) != "", F.col("sl.Initialization._sourceURL"))
    none = F.lit(None).cast("bigint")
    init = F.struct(join_path(F.col("url"), ref).alias("url"), none.alias("range_start"), none.alias("range_len"))
    return rows.select(
        "manifest_id", "stream_idx", F.lit(False).alias("is_live"), F.lit(0.0).alias("refresh_ms"), "total_duration_s",
        F.lit(None).cast("double").alias("target_duration_s"), F.when(ref.isNotNull(), init).alias("init"),
    )


def protection(manifests: DataFrame) -> DataFrame:
    """Content protection of each stream's adaptation set."""
    rows = representations(manifests).select("manifest_id", "stream_idx", F.explode("a.ContentProtection").alias("c"))
    return rows.select("manifest_id", "stream_idx", F.col("c._schemeIdUri").alias("scheme"), F.col("c._value").alias("value"), F.col("c.`_cenc:default_KID`").alias("kid"))
