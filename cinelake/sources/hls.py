"""HLS playlists: ordered lines with tags, as windows over their positions.

A manifest's lines are one partition of a window; nothing crosses manifests, so
one shuffle by manifest serves all windows of a query. Errors are rows of
``errors``, not failures: other manifests go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_range, resolve_url, to_double, to_long, trimmed
from ..schemas import ENCRYPTION

#: Tags, as the specification spells them.
STREAM_INF, MEDIA, MEDIA_SEQUENCE = "#EXT-X-STREAM-INF", "#EXT-X-MEDIA", "#EXT-X-MEDIA-SEQUENCE"
TARGET, ENDLIST, KEY, MAP = "#EXT-X-TARGETDURATION", "#EXT-X-ENDLIST", "#EXT-X-KEY", "#EXT-X-MAP"
INF, RANGE = "#EXTINF", "#EXT-X-BYTERANGE"
METHODS = ("NONE", "AES-128", "AES-128-ECB", "SAMPLE-AES", "SAMPLE-AES-CTR")


def _order():
    return Window.partitionBy("manifest_id").orderBy("pos")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def attributes(line: Column) -> Column:
    """The ``KEY=value`` pairs after a line's first colon, in order. A quoted value
    ends at the next quote, or with the line."""
    rest = F.regexp_extract(line, r"^[^:]*:(.*)$", 1)
    pairs = F.regexp_extract_all(rest, F.lit(r'[ ,]*([^=]*=(?:"[^"]*"?|[^,]*))'), 1)
    key = lambda p: trimmed(F.substring_index(p, "=", 1))
    raw = lambda p: F.regexp_replace(p, "^[^=]*=", "")
    value = lambda p: F.when(raw(p).startswith('"'), F.regexp_replace(raw(p), '^"|"$', "")).otherwise(raw(p))
    return F.transform(pairs, lambda p: F.struct(key(p).alias("key"), value(p).alias("value")))


def attribute(pairs: Column, key: str) -> Column:
    """The last value of a key, or null."""
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"]


def attribute_map(line: Column) -> Column:
    """The pairs as a map; a later value of a key wins."""
    pairs = attributes(line)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def value_of(line: Column, tag: str) -> Column:
    """What follows a tag and its colon."""
    return F.when(line.startswith(tag + ":"), F.substring(line, F.lit(len(tag) + 2), F.length(line))).otherwise(line)


def lines(manifests: DataFrame) -> DataFrame:
    """Trimmed non-blank lines of valid playlists, with ``is_master``."""
    rows = manifests.select("manifest_id", "url", F.posexplode(F.split("body", "\n")).alias("pos", "line")).withColumn("line", trimmed(F.col("line")))
    whole = Window.partitionBy("manifest_id")
    valid = F.max(F.when(F.col("pos") == 0, F.col("line") == "#EXTM3U")).over(whole)
    master = F.max(F.col("line").startswith(STREAM_INF)).over(whole)
    return rows.withColumn("valid", valid).withColumn("is_master", master).filter("valid and line != ''").drop("valid")


def errors(manifests: DataFrame) -> DataFrame:
    """``manifest_id`` and ``error`` of playlists that cannot be read."""
    first = trimmed(F.substring_index(F.coalesce("body", F.lit("")), "\n", 1))
    bad = manifests.filter(first != "#EXTM3U").select("manifest_id", F.when(F.coalesce("body", F.lit("")) == "", "empty playlist").otherwise("missing #EXTM3U").alias("error"))
    lost = _variants(lines(manifests).filter("is_master")).filter("is_first and uri is null").select("manifest_id", F.lit("STREAM-INF without URL").alias("error"))
    return bad.unionByName(lost.distinct())


def _variants(rows: DataFrame) -> DataFrame:
    """Lines with the address that ends their group, and the group's first variant."""
    uri = ~F.col("line").startswith("#")
    rows = rows.withColumn("grp", F.coalesce(F.sum(uri.cast("int")).over(_before()), F.lit(0)))
    group = Window.partitionBy("manifest_id", "grp")
    first = F.min(F.when(F.col("line").startswith(STREAM_INF), F.col("pos"))).over(group)
    return rows.withColumn("uri", F.max(F.when(uri, F.col("line"))).over(group)).withColumn("first_inf", first).withColumn("is_first", F.col("pos") == F.col("first_inf"))


def master_streams(manifests: DataFrame) -> DataFrame:
    """Variants and renditions of master playlists, in order of their lines.

    A variant takes the next line that is no tag as its address; what stands in
    between belongs to it. A manifest with a variant without address has no rows.
    """
    rows = _variants(lines(manifests).filter("is_master"))
    lost = F.max(F.col("is_first") & F.col("uri").isNull()).over(Window.partitionBy("manifest_id"))
    rows = rows.withColumn("lost", F.coalesce(lost, F.lit(False))).filter("not lost")
    line = F.col("line")
    variant = F.coalesce(F.col("is_first"), F.lit(False))
    rendition = line.startswith(MEDIA) & ~line.startswith(MEDIA_SEQUENCE) & line.contains(":") & (F.col("first_inf").isNull() | (F.col("pos") < F.col("first_inf")))
    rows = rows.filter(variant | rendition).withColumn("a", attributes(line)).withColumn("variant", variant)
    text = lambda k: F.coalesce(attribute(F.col("a"), k), F.lit(""))
    on_variant = lambda c, other: F.when(F.col("variant"), c).otherwise(other)
    kind = F.upper(text("TYPE"))
    ref = on_variant(F.col("uri"), text("URI"))
    return (
        rows.filter(ref != "")
        .select(
            "manifest_id",
            (F.row_number().over(_order()) - 1).alias("stream_idx"),
            on_variant(F.lit("video"), F.when(kind == "AUDIO", "audio").when(kind == "SUBTITLES", "subtitles").otherwise("video")).alias("media_type"),
            on_variant(F.lit(""), text("GROUP-ID")).alias("group_id"),
            on_variant(F.lit(""), text("LANGUAGE")).alias("language"),
            text("NAME").alias("name"),
            on_variant(to_long(text("BANDWIDTH")), F.lit(0).cast("bigint")).alias("bandwidth"),
            on_variant(text("CODECS"), F.lit("")).alias("codecs"),
            on_variant(text("RESOLUTION"), F.lit("")).alias("resolution"),
            on_variant(F.coalesce(to_double(text("FRAME-RATE")), F.lit(0.0)), F.lit(0.0)).alias("frame_rate"),
            *(F.lit("").alias(c) for c in ("channels", "extension", "video_range", "role")),
            resolve_url(F.col("url"), ref).alias("url"),
            F.lit(0).cast("bigint").alias("segments_count"),
        )
    )


def _key(pairs: Column, base: Column) -> Column:
    """An encryption struct, or null where the tag is to be ignored."""
    method, iv = F.upper(F.coalesce(attribute(pairs, "METHOD"), F.lit(""))), F.regexp_replace(F.regexp_replace(attribute(pairs, "IV"), "^0x", ""), "^0X", "")
    uri = attribute(pairs, "URI")
    fine = method.isin(*METHODS) & (iv.isNull() | iv.rlike("^([0-9a-fA-F]{2})*$"))
    return F.when(
        fine,
        F.struct(
            method.alias("method"), F.lit(None).cast("binary").alias("key"), F.when(F.length(iv) > 0, F.unhex(iv)).alias("iv"), F.lit(None).cast("binary").alias("key_id"),
            F.when(uri.isNull(), "").otherwise(resolve_url(base, uri)).alias("key_url"), F.coalesce(attribute(pairs, "KEYFORMAT"), F.lit("")).alias("key_format"),
        ).cast(ENCRYPTION),
    )


def _tagged(manifests: DataFrame) -> DataFrame:
    """Media playlist lines with the state that holds at each."""
    line = F.col("line")
    rows = lines(manifests).filter("not is_master")
    rows = rows.withColumn("a", F.when(line.startswith(KEY) | line.startswith(MAP), attributes(line)))
    seconds = to_double(F.substring_index(value_of(line, INF), ",", 1))
    rows = (
        rows.withColumn("inf", F.when(line.startswith(INF), seconds))
        .withColumn("seq", F.when(line.startswith(MEDIA_SEQUENCE), to_long(value_of(line, MEDIA_SEQUENCE))))
        .withColumn("key", F.when(line.startswith(KEY) & line.contains(":"), _key(F.col("a"), F.col("url"))))
        .withColumn("range", F.when(line.startswith(RANGE), byte_range(value_of(line, RANGE))))
        .withColumn("is_uri", ~line.startswith("#"))
    )
    rows = rows.withColumn("cnt", F.count("inf").over(_so_far()))
    # the base number may be set again anywhere: numbers count on from the last one
    base = F.last(F.when(F.col("seq").isNotNull(), F.struct("seq", "cnt")), True).over(_so_far())
    rows = rows.withColumn("base", base).withColumn("held", F.last("key", True).over(_so_far()))
    number = F.coalesce(F.col("base.seq"), F.lit(0)) + F.col("cnt") - F.coalesce(F.col("base.cnt"), F.lit(0)) - 1
    return rows.withColumn("number", number.cast("bigint")).withColumn("grp", F.coalesce(F.sum(F.col("is_uri").cast("int")).over(_before()), F.lit(0)))


def media_segments(manifests: DataFrame) -> DataFrame:
    """Segments of media playlists. Durations and ranges attach to the next address
    and are then forgotten; keys hold until the next key tag; an AES-128 key
    without IV takes the segment's number as a 16-byte one."""
    rows = _tagged(manifests)
    none = F.struct(F.lit("").alias("method"), *(F.lit(None).cast("binary").alias(c) for c in ("key", "iv", "key_id")), F.lit("").alias("key_url"), F.lit("").alias("key_format")).cast(ENCRYPTION)
    inf = F.when(F.col("inf").isNotNull(), F.struct("inf", "number", "held"))
    grouped = rows.groupBy("manifest_id", "url", "grp").agg(
        F.max_by(inf, F.when(F.col("inf").isNotNull(), F.col("pos"))).alias("i"),
        F.max_by("range", F.when(F.col("range").isNotNull(), F.col("pos"))).alias("r"),
        F.max(F.when(F.col("is_uri"), F.col("line"))).alias("uri"),
    )
    number = F.coalesce(F.col("i.number"), F.lit(0)).cast("bigint")
    held = F.coalesce(F.col("i.held"), none)
    iv = F.when((held["method"] == "AES-128") & held["iv"].isNull(), F.unhex(F.lpad(F.hex(number), 32, "0"))).otherwise(held["iv"])
    return grouped.filter("uri is not null").select(
        "manifest_id", F.lit(0).alias("stream_idx"), F.lit(0).alias("part_idx"), F.col("grp").cast("int").alias("pos"), number.alias("seg_index"),
        F.coalesce(F.col("i.inf"), F.lit(0.0)).alias("duration_s"), resolve_url(F.col("url"), F.col("uri")).alias("url"),
        F.col("r.start").alias("range_start"), F.col("r.length").alias("range_len"), held.withField("iv", iv).alias("enc"),
    )


def media_playlists(manifests: DataFrame) -> DataFrame:
    """One row a media playlist: live flag, refresh interval, durations, init.

    Live means at least one segment and no line that is exactly the end tag.
    """
    rows = _tagged(manifests)
    line = F.col("line")
    target = to_double(value_of(line, TARGET))
    uri, at = attribute(F.col("a"), "URI"), byte_range(attribute(F.col("a"), "BYTERANGE"))
    has = line.startswith(MAP) & line.contains(":") & uri.isNotNull()
    init = F.struct(resolve_url(F.col("url"), uri).alias("url"), F.when(attribute(F.col("a"), "BYTERANGE").isNotNull(), at["start"]).alias("range_start"), F.when(attribute(F.col("a"), "BYTERANGE").isNotNull(), at["length"]).alias("range_len"))
    facts = rows.groupBy("manifest_id").agg(
        F.max_by(F.when(line.startswith(TARGET), target), F.when(line.startswith(TARGET) & target.isNotNull(), F.col("pos"))).alias("target_duration_s"),
        F.max_by(F.when(has, init), F.when(has, F.col("pos"))).alias("init"),
        F.max(line == ENDLIST).alias("ended"),
        F.sum(F.col("is_uri").cast("int")).alias("n"),
    )
    total = media_segments(manifests).groupBy("manifest_id").agg(F.sum("duration_s").alias("total"))
    live = (F.col("n") > 0) & ~F.col("ended")
    return facts.join(total, "manifest_id", "left").select(
        "manifest_id", F.lit(0).alias("stream_idx"), live.alias("is_live"),
        F.when(live & F.col("target_duration_s").isNotNull(), F.col("target_duration_s") * 1000).otherwise(0.0).alias("refresh_ms"),
        F.coalesce("total", F.lit(0.0)).alias("total_duration_s"), "target_duration_s", "init",
    )
