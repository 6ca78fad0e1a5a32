"""Queries that make manifests, containers, packets and names out of driver tables
and read them back, with the DuckDB SQL each is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits, crypto, enums, text
from ..operators import joins, progress, select
from ..sinks.mp4 import mux, number
from ..sources import boxes, config, dash, hls, mss, subtitles, transport

BASE = "https://example.com/path/list.m3u8"
ORACLE_SQL: dict[str, str] = {}
QUERIES: dict = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _joined(rows: DataFrame, by: str, order: list[str], line: Column) -> DataFrame:
    """The lines of each group in order, as one text."""
    x = F.struct(*order, line.alias("line"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda x: x["line"]), "").alias("lines"))


# --- streams ---------------------------------------------------------------------


@_query("""
    SELECT p_partkey AS stream_idx, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
    WHERE regexp_matches(substr(p_name, 1, 2), '^(la|sm)') AND regexp_matches(p_size * 16 || 'x' || p_size * 9, '[02468]x') AND regexp_matches(printf('%.2f', p_size / 4), '\\.(50|00)$')
      AND p_size % 7 <> 3 AND regexp_matches(CASE WHEN p_size % 2 = 0 THEN 'SDR' ELSE 'PQ' END, 'S|P') AND regexp_matches('https://c/' || p_partkey, '[1-9]$') AND lower(p_type) = 'economy'""")
def q36_filter_keys(spark, sf_dir):
    """All keys of the filter language that the catalogue of parts can serve."""
    size = F.col("p_size")
    rows = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("stream_idx"), F.col("p_brand").alias("group_id"), F.substring("p_name", 1, 2).alias("language"), F.col("p_retailprice").alias("bandwidth"),
        _text(size * 16, "x", size * 9).alias("resolution"), (size / 4).alias("frame_rate"), (size % 7).cast("string").alias("channels"),
        F.when(size % 2 == 0, "SDR").otherwise("PQ").alias("video_range"), _text("https://c/", F.col("p_partkey")).alias("url"), F.col("p_type").alias("role"),
    )
    spec = r'lang="^(la|sm)":res=[02468]x:frame=\.(50|00)$:ch=[^3]:range=S|P:url=[1-9]$:role=Economy:for=all'
    return select.selected(rows, spec, ["group_id"]).select("stream_idx", F.col("rank").cast("long").alias("rank"))


@_query("SELECT p_partkey AS stream_idx, CASE WHEN p_type = 'PROMO' THEN 'audio' ELSE 'video' END AS side FROM part")
def q36b_split_types(spark, sf_dir):
    kind = F.when(F.col("p_type") == "PROMO", "audio").when(F.col("p_type") == "SMALL", "subtitles").otherwise("video")
    video, audio = select.split_by_type(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stream_idx"), kind.alias("media_type")))
    return video.select("stream_idx", F.lit("video").alias("side")).unionByName(audio.select("stream_idx", F.lit("audio").alias("side")))


@_query("""
    WITH v AS (SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS v FROM part WHERE p_type <> 'PROMO' GROUP BY 1),
    a AS (SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS a FROM part WHERE p_type = 'PROMO' GROUP BY 1)
    SELECT p_brand AS brand, v AS video, a AS audio FROM v LEFT JOIN a USING (p_brand)""")
def q36c_paired(spark, sf_dir):
    """The best video and audio stream of each brand."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("stream_idx"), F.col("p_retailprice").alias("bandwidth"), "p_type")
    pairs = joins.paired(rows.filter("p_type != 'PROMO'"), rows.filter("p_type = 'PROMO'"), ["brand"])
    return pairs.select("brand", F.col("video.stream_idx").alias("video"), F.col("audio.stream_idx").alias("audio"))


@_query("SELECT o_orderkey, 'u' || o_custkey AS url, c_name AS title FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 > 0) c ON c_custkey = o_custkey")
def q36d_with_playlists(spark, sf_dir):
    streams = _table(spark, sf_dir, "orders").select("o_orderkey", _text("u", F.col("o_custkey")).alias("url"))
    lists = _table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(_text("u", F.col("c_custkey")).alias("url"), F.col("c_name").alias("title"))
    return joins.with_playlists(streams, lists).select("o_orderkey", "url", "title")


# --- names, states, parts --------------------------------------------------------


@_query("""
    SELECT p_partkey, coalesce(['pending', 'parsing', 'downloading', 'decrypting', 'merging', 'muxing', 'done', 'failed', 'cancelled'][p_size % 11 + 1], 'unknown') AS state,
      CASE p_type WHEN 'PROMO' THEN 2 WHEN 'SMALL' THEN 0 ELSE 1 END AS mode_number, CASE p_type WHEN 'PROMO' THEN 'fmp4' WHEN 'SMALL' THEN 'binary' ELSE 'ts2mp4' END AS mode,
      CASE p_type WHEN 'PROMO' THEN '/out/' || p_name || '.mp4' WHEN 'SMALL' THEN '/out/' || p_name || '.ts' ELSE '/out/' || p_name || '.mp4' END AS path,
      CASE WHEN length(p_name) > 9 THEN substr(p_name, 1, 8) || chr(8230) ELSE p_name END AS short, length(p_name) AS visible,
      p_type AS header_name, p_brand AS header_value, strftime(DATE '1970-01-01' + INTERVAL (p_partkey * 86400 + p_size) SECOND, '%Y%m%d') || '_' || (p_partkey * 86400 + p_size) AS save_name,
      p_name || ' | ' || p_type AS tidy FROM part""")
def q37_names(spark, sf_dir):
    """States, modes, paths and text helpers on the names of parts."""
    p, kind = _table(spark, sf_dir, "part"), F.col("p_type")
    mode = F.when(kind == "PROMO", "fmp4").when(kind == "SMALL", "binary").otherwise(kind)
    known = enums.merge_mode(mode)
    coloured = _text("\x1b[1;31m", F.col("p_name"), "\x1b[0m")
    return p.select(
        "p_partkey", enums.name_of(F.col("p_size") % 11, enums.TASK_STATES).alias("state"), enums.number_of(mode, enums.MERGE_MODES, 1).alias("mode_number"), known.alias("mode"),
        enums.output_path(F.lit("/out/"), F.col("p_name"), known, F.lit("")).alias("path"), text.shortened(F.col("p_name"), 9).alias("short"), text.visible_length(coloured).alias("visible"),
        text.header(_text(kind, " : ", F.col("p_brand")))["name"].alias("header_name"), text.header(_text(kind, ": ", F.col("p_brand")))["value"].alias("header_value"),
        text.save_name(F.timestamp_seconds(F.col("p_partkey") * 86400 + F.col("p_size"))).alias("save_name"), text.tidy_pipes(_text("| ", F.col("p_name"), " |  | ", kind, " | ")).alias("tidy"),
    )


@_query("""
    SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(event_id AS INT) AS pos, 'seg_' || event_id || '.ts' AS path, n AS total,
      round(count(*) OVER (PARTITION BY user_id) / n * 100, 6) AS percent
    FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE event_type = 'view'""")
def q38_resume(spark, sf_dir):
    """State documents of users written as JSON and read again."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").cast("int").alias("pos"), "event_type", text.segment_file(F.col("event_id")).alias("path"))
    tasks = e.groupBy("task_id").agg(F.count("*").alias("total")).withColumn("url", F.lit(BASE))
    states = config.resume_states(config.state_json(tasks, e.filter("event_type = 'view'")))
    rows = config.completed(states).join(states.select("task_id", F.col("total").cast("long").alias("total"), F.size("completed").alias("done")), "task_id")
    return rows.select("task_id", "pos", "path", "total", F.round(progress.resume_percent(F.col("done"), F.col("total")), 6).alias("percent"))


@_query("SELECT event_id AS part FROM events WHERE strlen(props) = user_id % 3 + 8")
def q39_complete_parts(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    parts = e.select(F.col("event_id").alias("part"), F.col("user_id").alias("start"), (F.col("user_id") + F.col("user_id") % 3 + 7).alias("end"))
    return joins.complete_parts(parts, e.select(F.col("event_id").alias("part"), F.octet_length("props").alias("size"))).select("part")


@_query("SELECT 2 AS place, min(props) AS body FROM events")
def q39b_first_config(spark, sf_dir):
    """The first place that has a document."""
    none = _table(spark, sf_dir, "events").agg(F.lit(1).alias("place"), F.min(F.when(F.col("event_id") < 0, F.col("props"))).alias("body"))
    some = _table(spark, sf_dir, "events").agg(F.lit(2).alias("place"), F.min("props").alias("body"))
    return config.first_found(none.unionByName(some).unionByName(some.withColumn("place", F.lit(3))))


# --- manifests -------------------------------------------------------------------


def _event_playlists(spark, sf_dir) -> DataFrame:
    """A media playlist of each user: events are segments, some with tags before."""
    kind, event = F.col("event_type"), F.col("event_id")
    tag = (
        F.when(kind == "error", _text('#EXT-X-KEY:METHOD=AES-128,URI="k', event, '.bin"\n'))
        .when(kind == "signup", "#EXT-X-KEY:METHOD=NONE\n")
        .when(kind == "purchase", _text("#EXT-X-BYTERANGE:", event, "@", F.col("user_id"), "\n"))
        .otherwise("# a remark\n\n")
    )
    rows = _joined(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], _text(tag, "#EXTINF:", F.col("value"), ",\r\n", event, ".ts\n"))
    head = _text("#EXTM3U\n#EXT-X-TARGETDURATION:9\n#EXT-X-MEDIA-SEQUENCE:", F.col("user_id"), "\n")
    end = F.when(F.col("user_id") % 2 == 1, "#EXT-X-ENDLIST\n").otherwise("")
    return rows.select(F.col("user_id").cast("string").alias("manifest_id"), F.lit(BASE).alias("url"), F.concat(head, "lines", end).alias("body"))


@_query("""
    WITH e AS (SELECT *, row_number() OVER w - 1 AS pos, last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS k,
      last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS key FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT CAST(user_id AS VARCHAR) AS manifest_id, CAST(pos AS INT) AS pos, user_id + pos AS seg_index, value AS duration_s, 'https://example.com/path/' || event_id || '.ts' AS url,
      CASE WHEN event_type = 'purchase' THEN user_id END AS range_start, CASE WHEN event_type = 'purchase' THEN event_id END AS range_len,
      CASE k WHEN 'error' THEN 'AES-128' WHEN 'signup' THEN 'NONE' ELSE '' END AS method, CASE WHEN k = 'error' THEN 'https://example.com/path/k' || key || '.bin' ELSE '' END AS key_url,
      CASE WHEN k = 'error' THEN printf('%032X', user_id + pos) END AS iv FROM e""")
def q40_hls_segments(spark, sf_dir):
    s = hls.media_segments(_event_playlists(spark, sf_dir))
    return s.select("manifest_id", "pos", "seg_index", "duration_s", "url", "range_start", "range_len", F.col("enc.method").alias("method"), F.col("enc.key_url").alias("key_url"), F.hex("enc.iv").alias("iv"))


@_query("""
    SELECT CAST(user_id AS VARCHAR) AS manifest_id, user_id % 2 = 0 AS is_live, CASE WHEN user_id % 2 = 0 THEN 9000 ELSE 0 END::DOUBLE AS refresh_ms,
      round(sum(value), 4) AS total_duration_s, 9::DOUBLE AS target_duration_s FROM events GROUP BY user_id""")
def q40b_hls_playlists(spark, sf_dir):
    rows = hls.media_playlists(_event_playlists(spark, sf_dir))
    return rows.select("manifest_id", "is_live", "refresh_ms", F.round("total_duration_s", 4).alias("total_duration_s"), "target_duration_s")


@_query("""
    SELECT p_brand AS manifest_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS stream_idx, CASE p_type WHEN 'PROMO' THEN 'audio' WHEN 'SMALL' THEN 'subtitles' ELSE 'video' END AS media_type,
      CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_brand ELSE '' END AS group_id, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'en' ELSE '' END AS language,
      CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_name || ', voll' ELSE '' END AS name, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 0 ELSE p_partkey * 1000 END AS bandwidth,
      CASE WHEN p_type IN ('PROMO', 'SMALL') THEN '' ELSE p_type || ',mp4a' END AS codecs, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN '' ELSE p_size * 16 || 'x' || p_size * 9 END AS resolution,
      CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 0 ELSE p_size / 2 END::DOUBLE AS frame_rate, 'https://example.com/path/s/' || p_partkey || '.m3u8' AS url FROM part""")
def q41_hls_streams(spark, sf_dir):
    """Master playlists of brands: parts as variants and renditions."""
    p = _table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    rendition = _text("#EXT-X-MEDIA:TYPE=", F.when(F.col("p_type") == "PROMO", "AUDIO").otherwise("SUBTITLES"), ',GROUP-ID="', F.col("p_brand"), '",LANGUAGE="en",NAME="', F.col("p_name"), ', voll",URI="s/', key, '.m3u8"\n')
    variant = _text("#EXT-X-STREAM-INF:BANDWIDTH=", key * 1000, ",RESOLUTION=", size * 16, "x", size * 9, ',CODECS="', F.col("p_type"), ',mp4a",FRAME-RATE=', size / 2, "\n# between\n\ns/", key, ".m3u8\n")
    rows = _joined(p, "p_brand", ["p_partkey"], F.when(F.col("p_type").isin("PROMO", "SMALL"), rendition).otherwise(variant))
    s = hls.master_streams(rows.select(F.col("p_brand").alias("manifest_id"), F.lit(BASE).alias("url"), F.concat(F.lit("#EXTM3U\n"), "lines").alias("body")))
    return s.select("manifest_id", F.col("stream_idx").cast("int").alias("stream_idx"), "media_type", "group_id", "language", "name", "bandwidth", "codecs", "resolution", "frame_rate", "url")


def _event_manifests(spark, sf_dir) -> DataFrame:
    """A DASH manifest of each user: a timeline, a fixed duration and a list."""
    d = F.floor(F.col("value") * 100) + 1
    e = _table(spark, sf_dir, "events").withColumn("first", F.row_number().over(_by_user()) == 1)
    entry = F.struct("ts", "event_id", _text("<S ", F.when(F.col("first"), _text('t="', F.col("user_id") * 10, '" ')).otherwise(""), 'd="', d, '" r="', F.col("event_id") % 3, '"/>').alias("s"), _text('<SegmentURL media="', F.col("event_id"), '.m4s"/>').alias("u"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    part = lambda name: F.array_join(F.transform("x", lambda x: x[name]), "")
    body = _text(
        '<MPD type="static" mediaPresentationDuration="PT1M', F.col("user_id") % 60, 'S"><Period><AdaptationSet contentType="video" lang="en">',
        '<Representation id="t" bandwidth="1000"><SegmentTemplate timescale="100" startNumber="', F.col("user_id") + 1, '" media="t_$Number$_$Time$.m4s"><SegmentTimeline>', part("s"), "</SegmentTimeline></SegmentTemplate></Representation>",
        '<Representation id="f" bandwidth="2000" frameRate="', F.col("user_id") % 50 + 1, '/2" width="16" height="9"><SegmentTemplate duration="7" media="f_$Number$.m4s"/></Representation></AdaptationSet>',
        '<AdaptationSet mimeType="audio/mp4"><Representation id="l" bandwidth="3000"><SegmentList timescale="10" duration="25">', part("u"), "</SegmentList></Representation></AdaptationSet></Period></MPD>",
    )
    return rows.select(F.col("user_id").cast("string").alias("manifest_id"), F.lit("https://example.com/d/m.mpd").alias("url"), body.alias("body"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@_query("""
    WITH e AS (SELECT *, CAST(floor(value * 100) AS BIGINT) + 1 AS d, unnest(range(0, event_id % 3 + 1)) AS rep FROM events),
    t AS (SELECT user_id, d, row_number() OVER w - 1 AS pos, user_id * 10 + coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id, rep)),
    l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
    f AS (SELECT user_id, unnest(range(0, (60 + user_id % 60) // 7)) AS pos FROM (SELECT DISTINCT user_id FROM events))
    SELECT CAST(user_id AS VARCHAR) AS manifest_id, 0::INT AS stream_idx, CAST(pos AS INT) AS pos, user_id + 1 + pos AS seg_index, d / 100 AS duration_s, 'https://example.com/d/t_' || (user_id + 1 + pos) || '_' || t0 || '.m4s' AS url FROM t
    UNION ALL SELECT CAST(user_id AS VARCHAR), 1, pos, 1 + pos, 7, 'https://example.com/d/f_' || (1 + pos) || '.m4s' FROM f
    UNION ALL SELECT CAST(user_id AS VARCHAR), 2, pos, 1 + pos, 2.5, 'https://example.com/d/' || event_id || '.m4s' FROM l""")
def q42_dash_segments(spark, sf_dir):
    s = dash.segments(_event_manifests(spark, sf_dir))
    return s.select("manifest_id", F.col("stream_idx").cast("int").alias("stream_idx"), "pos", "seg_index", "duration_s", "url")


@_query("""
    WITH u AS (SELECT user_id, count(*) AS n, sum(event_id % 3 + 1) AS t FROM events GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS manifest_id, x.i AS stream_idx, x.k AS media_type, x.l AS language, x.b AS bandwidth, x.r AS resolution, round(x.f, 4) AS frame_rate, CAST(x.n AS BIGINT) AS segments_count FROM (
      SELECT user_id, unnest([{'i': 0::INT, 'k': 'video', 'l': 'en', 'b': 1000::BIGINT, 'r': 'unknown', 'f': 0::DOUBLE, 'n': t}, {'i': 1, 'k': 'video', 'l': 'en', 'b': 2000, 'r': '16x9', 'f': (user_id % 50 + 1) / 2, 'n': (60 + user_id % 60) // 7},
        {'i': 2, 'k': 'audio', 'l': '', 'b': 3000, 'r': '', 'f': 0, 'n': n}]) AS x FROM u)""")
def q42b_dash_streams(spark, sf_dir):
    s = dash.streams(_event_manifests(spark, sf_dir))
    return s.select("manifest_id", F.col("stream_idx").cast("int").alias("stream_idx"), "media_type", "language", "bandwidth", "resolution", F.round("frame_rate", 4).alias("frame_rate"), "segments_count")


def _part_manifests(spark, sf_dir) -> DataFrame:
    """A Smooth Streaming manifest of each brand: its types are quality levels, its
    parts chunks, some with a time of their own; and an audio stream by count."""
    p = _table(spark, sf_dir, "part")
    t = F.when(F.col("p_size") % 10 == 0, _text(' t="', F.col("p_partkey") * 1_000_000, '"')).otherwise("")
    chunks = _joined(p, "p_brand", ["p_partkey"], _text('<c d="', (F.col("p_size") + 1) * 100_000, '"', t, "/>"))
    levels = p.groupBy("p_brand", "p_type").agg(F.max("p_size").alias("h"))
    levels = _joined(levels, "p_brand", ["p_type"], _text('<QualityLevel Bitrate="', F.col("h") * 1000 + F.length("p_type"), '" FourCC="', F.when(F.col("p_type") == "PROMO", "hvc1").otherwise("H264"), '" MaxWidth="', F.col("h") * 2, '" MaxHeight="', F.col("h"), '"/>')).withColumnRenamed("lines", "levels")
    body = _text(
        '<SmoothStreamingMedia Duration="90000000" IsLive="TRUE"><StreamIndex Type="video" Name="v">', F.col("levels"), F.col("lines"),
        '</StreamIndex><StreamIndex Type="audio" Name="a" Language="de" Chunks="3"><QualityLevel Bitrate="64000" FourCC="AACL" Channels="2"/></StreamIndex><StreamIndex Type="text" Name="x"><QualityLevel Bitrate="1" FourCC="TTML"/></StreamIndex></SmoothStreamingMedia>',
    )
    return chunks.join(levels, "p_brand").select(F.col("p_brand").alias("manifest_id"), F.lit("https://example.com/v.ism/").alias("url"), body.alias("body"))


@_query("""
    WITH c AS (SELECT p_brand, p_partkey, (p_size + 1) * 100000 AS d, CASE WHEN p_size % 10 = 0 AND p_partkey > 0 THEN p_partkey * 1000000 END AS t FROM part),
    g AS (SELECT *, count(t) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS g, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM c),
    s AS (SELECT *, coalesce(max(t) OVER (PARTITION BY p_brand, g), 0) + coalesce(sum(d) OVER (PARTITION BY p_brand, g ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t0 FROM g),
    q AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n, max(p_size) * 1000 + length(p_type) AS b FROM part GROUP BY p_brand, p_type)
    SELECT p_brand AS manifest_id, CAST(i AS INT) AS stream_idx, CAST(pos AS INT) AS pos, d / 1e7 AS duration_s, 'https://example.com/v.ism/QualityLevels(' || b || ')/Fragments(v=' || t0 || ')' AS url FROM s JOIN q USING (p_brand)
    UNION ALL SELECT p_brand, n, k, 3, 'https://example.com/v.ism/QualityLevels(64000)/Fragments(a=' || k * 30000000 || ')' FROM (SELECT p_brand, any_value(n) AS n, unnest([0, 1, 2]) AS k FROM q GROUP BY p_brand)""")
def q43_mss_segments(spark, sf_dir):
    return mss.segments(_part_manifests(spark, sf_dir)).select("manifest_id", F.col("stream_idx").cast("int").alias("stream_idx"), "pos", "duration_s", "url")


@_query("""
    WITH q AS (SELECT p_brand, p_type, max(p_size) AS h, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM part) GROUP BY p_brand, p_type)
    SELECT p_brand AS manifest_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS INT) AS stream_idx, 'video' AS media_type, 'v_' || h || 'p' AS name, CAST(h * 1000 + length(p_type) AS BIGINT) AS bandwidth,
      CASE p_type WHEN 'PROMO' THEN 'hvc1' ELSE 'avc1' END AS codecs, h * 2 || 'x' || h AS resolution, '' AS channels, n AS segments_count FROM q
    UNION ALL SELECT p_brand, count(*), 'audio', 'a', 64000, 'mp4a.40.2', '', '2', 3 FROM q GROUP BY p_brand""")
def q43b_mss_streams(spark, sf_dir):
    s = mss.streams(_part_manifests(spark, sf_dir))
    return s.select("manifest_id", F.col("stream_idx").cast("int").alias("stream_idx"), "media_type", "name", "bandwidth", "codecs", "resolution", "channels", "segments_count")


_WORDS = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) || '.'"


def _turns(spark, sf_dir) -> DataFrame:
    words = F.concat(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")), F.lit("."))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"))


@_query(f"""
    SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, CASE WHEN turn % 2 = 0 THEN 'id ' || turn ELSE '' END AS id, turn * 61500000 AS start_us,
      turn * 61500000 + 1250000 AS end_us, {_WORDS} || chr(10) || 'second' AS text, CASE WHEN turn % 3 = 0 THEN 'line' ELSE '' END AS settings FROM conversations""")
def q44_vtt_cues(spark, sf_dir):
    """Conversations as WebVTT texts, read again."""
    turn = F.col("turn")
    cue = _text(
        F.when(turn % 2 == 0, _text("id ", turn, "\n")).otherwise(""), text.clock(turn * 61_500_000), " --> ", text.clock(turn * 61_500_000 + 1_250_000), F.when(turn % 3 == 0, " line").otherwise(""),
        "\n", F.col("words"), "\nsecond\n\n",
    )
    rows = _joined(_turns(spark, sf_dir), "conv_id", ["turn"], cue)
    cues = subtitles.vtt_cues(rows.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("WEBVTT - talk\nNOTE none\n\n"), "lines").alias("body")))
    return cues.select("doc_id", "pos", "id", "start_us", "end_us", "text", "settings")


@_query(f"""
    SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, turn * 1500000 AS start_us, turn * 1500000 + 1000000 AS end_us,
      CASE WHEN turn % 2 = 0 THEN {_WORDS} ELSE 'one' || chr(10) || {_WORDS} END AS text FROM conversations""")
def q45_ttml_cues(spark, sf_dir):
    """Conversations as TTML texts, with paragraphs of their own text or of spans."""
    turn = F.col("turn")
    own = F.when(turn % 2 == 0, F.col("words")).otherwise(_text("<span>one</span><span>", F.col("words"), "</span>"))
    paragraph = _text('<p begin="', turn * 45, 'f" end="', turn * 1500 + 1000, 'ms">', own, '</p><p begin="x" end="1s">never</p>')
    rows = _joined(_turns(spark, sf_dir), "conv_id", ["turn"], paragraph)
    cues = subtitles.ttml_cues(rows.select(F.col("conv_id").cast("string").alias("doc_id"), _text('<?xml version="1.0"?><tt xmlns="http://www.w3.org/ns/ttml"><body><div>', F.col("lines"), "</div></body></tt>").alias("body")))
    return cues.select("doc_id", F.col("pos").cast("int").alias("pos"), "start_us", "end_us", "text")


# --- packets and frames ----------------------------------------------------------


@_query("""
    SELECT event_id, true AS sync, CAST(event_id % 8192 AS INT) AS pid, event_id % 2 = 1 AS pusi, CAST(1 + event_id % 3 AS INT) AS adaptation, CAST(event_id % 16 AS INT) AS counter,
      CAST(CASE WHEN event_id % 3 = 0 THEN 4 ELSE 5 + event_id % 100 END AS INT) AS payload_at, CASE event_id % 3 WHEN 0 THEN 'ts' WHEN 1 THEN 'fmp4' ELSE 'unknown' END AS format FROM events""")
def q46_packet_headers(spark, sf_dir):
    """Header fields of packets made of events, and formats by first bytes."""
    k = F.col("event_id")
    head = F.concat(F.lit(b"\x47"), number(k % 2 * 64 * 256 + k % 8192, 2), number((1 + k % 3) * 16 + k % 16, 1), number(k % 100, 1))
    start = F.when(k % 3 == 0, head).when(k % 3 == 1, F.concat(number(k, 4), F.encode(F.element_at(F.array(*map(F.lit, ("ftyp", "moof", "styp"))), (k % 2 + 1).cast("int")), "utf-8"))).otherwise(F.lit(b"\x01\x02"))
    return _table(spark, sf_dir, "events").select("event_id", bits.ts_header(head).alias("h"), bits.segment_format(start).alias("format")).select("event_id", "h.*", "format")


@_query("""
    SELECT event_id, CAST(f AS INT) AS frame, event_id * 10 + f * (1024 * 90000 // r) AS pts, CAST(r AS INT) AS sample_rate, 2::INT AS channels, md5(props || f) AS md5
    FROM (SELECT event_id, props, unnest([0, 1, 2]) AS f, [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][event_id % 13 + 1] AS r FROM events)""")
def q47_adts_frames(spark, sf_dir):
    """Three audio frames a row, with bytes in between that start none."""
    k = F.col("event_id")

    def frame(i):
        body = F.concat(F.col("props"), F.lit(str(i))).cast("binary")
        size = F.octet_length(body) + 7
        head = F.concat(F.lit(b"\xff\xf1"), number((1 * 64 + k % 13 * 4).cast("long"), 1), number(F.lit(128) + F.shiftright(size, 11), 1), number(F.shiftright(size, 3).bitwiseAND(F.lit(255)), 1), number(size.bitwiseAND(F.lit(7)) * 32 + 31, 1), F.lit(b"\xfc"))
        return F.concat(F.lit(b"xy"), head, body)

    rows = _table(spark, sf_dir, "events").select("event_id", (k * 10).alias("pts"), F.concat(*map(frame, range(3))).alias("data"))
    frames = transport.adts_frames(rows, ["event_id"])
    return frames.select("event_id", "frame", "pts", F.col("sample_rate").cast("int").alias("sample_rate"), F.col("channels").cast("int").alias("channels"), F.md5("body").alias("md5"))


def _packets(pid: int, data: Column) -> Column:
    """Transport packets of one unit: the first says so, the last is filled up."""

    def packet(i):
        piece = F.substring(data, (i * 184 + 1).cast("int"), F.lit(184))
        room = 184 - F.octet_length(piece)
        fill = F.concat(number(room - 1, 1), F.when(room > 1, F.concat(F.lit(b"\0"), F.unhex(F.repeat(F.lit("FF"), (room - 2).cast("int"))))).otherwise(F.lit(b"")))
        head = F.concat(F.lit(b"\x47"), number(F.when(i == 0, 0x4000).otherwise(0) + pid, 2), F.when(room == 0, F.lit(b"\x10")).otherwise(F.lit(b"\x30")))
        return F.hex(F.concat(head, F.when(room == 0, F.lit(b"")).otherwise(fill), piece))

    n = F.ceil(F.octet_length(data) / 184).cast("bigint")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), packet), ""))


@_query("""
    SELECT CAST(p_partkey AS VARCHAR) || ':' || (256 + u // 9) AS track_id, CAST(u % 9 AS INT) AS idx, p_partkey * 100 + (u % 9) * 3000 AS pts, 3000::BIGINT AS duration, u % 9 = 0 AS is_key,
      md5(unhex('00000001' || CASE WHEN u % 9 = 0 THEN '65' ELSE '41' END) || encode(repeat(p_name, p_size % 50 + 1))) AS md5 FROM (SELECT *, unnest([0, 1]) AS u FROM part)""")
def q48_transport_samples(spark, sf_dir):
    """Transport streams of parts: tables, two video units of one to many packets."""
    key = F.col("p_partkey")
    table = lambda raw: F.lit(bytes.fromhex(raw))
    pat = table("0000b00d0001c1000000" + "01e100" + "00000000")
    pmt = table("0002b0120001c10000e100f0001be100f000" + "00000000")

    def unit(i):
        pts = key * 100 + i * 3000
        nal = F.concat(F.lit(b"\0\0\0\1" + (b"\x41" if i else b"\x65")), F.repeat("p_name", (F.col("p_size") % 50 + 1).cast("int")).cast("binary"))
        return _packets(256, F.concat(F.lit(b"\0\0\1\xe0\0\0\x80\x80\5"), bits.pack_pts(pts), nal))

    content = F.concat(F.lit(b"junk"), _packets(0, pat), _packets(256, pmt), unit(0), unit(1))
    files = _table(spark, sf_dir, "part").select(key.cast("string").alias("file_id"), content.alias("content"))
    s = transport.samples(files)
    return s.select("track_id", F.col("idx").cast("int").alias("idx"), "pts", F.col("duration").cast("long").alias("duration"), "is_key", F.md5("data").alias("md5"))


@_query("""
    SELECT CAST(p_partkey AS VARCHAR) AS file_id, 3::BIGINT AS units, '01' || '42001E' || 'FFE1' || printf('%04X', strlen(p_name) + 4) || '6742001E' || hex(encode(p_name)) || '01' || printf('%04X', strlen(p_brand) + 1) || '68' || hex(encode(p_brand)) AS config FROM part""")
def q49_parameter_sets(spark, sf_dir):
    """NAL units of byte streams with both kinds of start codes; the decoder's box."""
    stream = F.concat(F.lit(b"\0\0\0\1\x67\x42\x00\x1e"), F.col("p_name").cast("binary"), F.lit(b"\0\0\1\x68"), F.col("p_brand").cast("binary"), F.lit(b"\0\0\0\1\x65"), F.col("p_type").cast("binary"))
    nals = transport.nal_units(_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file_id"), F.lit(0).alias("pos"), stream.alias("data")))
    back = transport.nal_units(transport.sized_units(nals, ["file_id"]).withColumn("pos", F.lit(0)), sized=4).groupBy("file_id").agg(F.count("*").alias("units"))
    sets = transport.parameter_sets(nals).select("file_id", F.hex(transport.avc_config(F.col("sps"), F.col("pps"))).alias("config"))
    return sets.join(back, "file_id").select("file_id", "units", "config")


# --- containers ------------------------------------------------------------------


def _movies(spark, sf_dir) -> DataFrame:
    """A movie of each user: views are video samples, clicks audio samples."""
    from pyspark.sql import Window

    e = _table(spark, sf_dir, "events").filter("event_type in ('view', 'click')")
    kind = F.when(F.col("event_type") == "view", "video").otherwise("audio")
    order = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    d = (F.col("event_id") % 2 * 500 + 1000).cast("long")
    rows = e.select(
        F.col("user_id").cast("string").alias("file_id"), kind.alias("kind"), (F.row_number().over(order) - 1).alias("idx"), d.alias("duration"),
        F.coalesce(F.sum(d).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("pts"), (F.col("event_id") % 5 == 0).alias("is_key"), F.col("props").cast("binary").alias("data"),
    )
    tracks = rows.select("file_id", "kind").distinct().select(
        "file_id", "kind", F.when(F.col("kind") == "video", "avc1").otherwise("mp4a").alias("entry"), F.lit(1000).cast("long").alias("timescale"), F.lit(64).alias("width"), F.lit(36).alias("height"),
        F.lit(2).alias("channels"), F.lit(8000).alias("sample_rate"), F.lit(None).cast("binary").alias("config"),
    )
    return mux(rows, tracks)


@_query("""
    WITH e AS (SELECT *, event_id % 2 * 500 + 1000 AS d, row_number() OVER w - 1 AS idx, bool_or(event_type = 'view') OVER (PARTITION BY user_id) AS v FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)),
    t AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pts FROM e)
    SELECT CAST(user_id AS VARCHAR) AS file_id, CASE WHEN event_type = 'click' AND v THEN 2 ELSE 1 END::BIGINT AS track_id, CAST(idx AS INT) AS idx, strlen(props) AS size, round(pts / 1000, 6) AS start_s, round(d / 1000, 6) AS duration_s, md5(props) AS md5 FROM t""")
def q50_movie_samples(spark, sf_dir):
    """Movies written from events and read back through their sample tables."""
    files = _movies(spark, sf_dir)
    s = boxes.samples(boxes.boxes(files), files)
    return s.select("file_id", "track_id", "idx", "size", F.round("start_s", 6).alias("start_s"), F.round("duration_s", 6).alias("duration_s"), F.md5("data").alias("md5"))


@_query("""
    WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS a FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS file_id, 64::INT AS width, 36::INT AS height, 1000::BIGINT AS timescale, CASE WHEN v AND a THEN 2 ELSE 1 END::BIGINT AS track_id, 90000::BIGINT AS movie_timescale,
      CASE WHEN v AND a THEN 'avc1,mp4a' WHEN v THEN 'avc1' ELSE 'mp4a' END AS codecs, a AS has_audio FROM u""")
def q50b_movie_info(spark, sf_dir):
    i = boxes.init_info(boxes.boxes(_movies(spark, sf_dir)))
    return i.select("file_id", "width", "height", "timescale", "track_id", "movie_timescale", F.array_join("codecs", ",").alias("codecs"), "has_audio")


def _box(kind: str, *parts) -> Column:
    return boxes.box(F.lit(kind), F.concat(*(F.lit(p) if isinstance(p, bytes) else p for p in parts)))


@_query("""
    SELECT CAST(c_custkey AS VARCHAR) AS file_id, CASE WHEN c_custkey % 4 = 0 THEN 'sbtl' ELSE 'text' END AS handler, 'eng' AS language, 9::BIGINT AS containers, x.i AS idx, x.s AS start_s, x.d AS duration_s, x.t AS text
    FROM (SELECT c_custkey, unnest([{'i': 0::INT, 's': 0::DOUBLE, 'd': 2::DOUBLE, 't': c_name}, {'i': 1, 's': 2, 'd': 3, 't': 'next'}]) AS x FROM customer WHERE c_custkey % 2 = 0)""")
def q51_subtitle_tracks(spark, sf_dir):
    """Movies with one track of customers' names; those with a subtitle handler."""
    key, name = F.col("c_custkey"), F.col("c_name").cast("binary")
    handler = F.when(key % 4 == 0, "sbtl").when(key % 2 == 0, "text").otherwise("vide")
    size = F.octet_length(name)
    stbl = lambda at: _box(
        "stbl", _box("stsd", b"\0\0\0\0\0\0\0\1", _box("tx3g", b"")), _box("stsz", bytes(11) + b"\2", number(size, 4), number(F.lit(4), 4)), _box("stco", b"\0\0\0\0\0\0\0\1", number(at, 4)),
        _box("stsc", b"\0\0\0\0\0\0\0\1\0\0\0\1\0\0\0\2\0\0\0\1"), _box("stts", b"\0\0\0\0\0\0\0\2\0\0\0\1\0\0\7\xd0\0\0\0\1\0\0\x0b\xb8"),
    )
    moov = lambda at: _box(
        "moov", _box("trak", _box("tkhd", bytes(12) + b"\0\0\0\7" + bytes(68)), _box("edts", b""), _box("mdia", _box("mdhd", bytes(12) + b"\0\0\3\xe8\0\0\0\0\x15\xc7\0\0"), _box("hdlr", bytes(8), F.encode(handler, "utf-8"), bytes(12)), _box("minf", _box("dinf", b""), stbl(at)))),
        _box("mvex", b""), _box("udta", b""),
    )
    files = _table(spark, sf_dir, "customer").select(key.cast("string").alias("file_id"), F.concat(_box("free", b"x"), moov(F.octet_length(moov(F.lit(0))) + 17), _box("mdat", name, b"next"), _box("sinf", b"")).alias("content"))
    rows = boxes.boxes(files)
    counts = rows.groupBy("file_id").agg(F.count(F.when(boxes.is_container(F.col("box_type")), 1)).alias("containers"))
    tracks = boxes.subtitle_tracks(rows).select("file_id", "handler", "language").join(counts, "file_id")
    s = boxes.subtitle_samples(rows, files).select("file_id", "idx", "start_s", "duration_s", F.col("data").cast("string").alias("text"))
    return tracks.join(s, "file_id").select("file_id", "handler", "language", "containers", "idx", "start_s", "duration_s", "text")


@_query("""
    SELECT CAST(c_custkey AS VARCHAR) AS file_id, 'avc1' AS format, CASE WHEN c_custkey % 2 = 0 THEN 'cenc' ELSE 'cbcs' END AS scheme, 8::INT AS iv_size, md5(c_name) AS key_id, md5(c_name) AS system_key, c_name AS data,
      x.i AS idx, x.v AS iv, x.s AS subsamples FROM (SELECT c_custkey, c_name, unnest([{'i': 0::INT, 'v': printf('%016x', c_custkey), 's': '5:' || c_custkey || ',0:32'}, {'i': 1, 'v': printf('%016x', c_custkey + 1), 's': ''}]) AS x FROM customer)""")
def q52_protection(spark, sf_dir):
    """Protection boxes of customers: scheme, default key, systems, samples' IVs."""
    key, kid = F.col("c_custkey"), F.unhex(F.md5("c_name"))
    sinf = _box("sinf", _box("frma", b"avc1"), _box("schm", bytes(4), F.when(key % 2 == 0, F.lit(b"cenc")).otherwise(F.lit(b"cbcs")), b"\0\1\0\0"), _box("schi", _box("tenc", bytes(6) + b"\1\x08", kid)))
    trak = _box("trak", _box("mdia", _box("minf", _box("stbl", _box("stsd", bytes(7) + b"\1", _box("encv", bytes(78), sinf))))))
    pssh = _box("pssh", b"\1\0\0\0" + b"S" * 16 + b"\0\0\0\1", kid, number(F.octet_length("c_name"), 4), F.col("c_name").cast("binary"))
    senc = _box("senc", b"\0\0\0\2\0\0\0\2", number(key, 8), b"\0\2\0\5", number(key, 4), b"\0\0\0\0\0\x20", number(key + 1, 8), b"\0\0")
    files = _table(spark, sf_dir, "customer").select(key.cast("string").alias("file_id"), F.concat(_box("moov", trak, pssh), _box("moof", _box("traf", senc))).alias("content"))
    rows = boxes.boxes(files)
    p = boxes.protections(rows).select("file_id", "format", "scheme", "iv_size", F.lower(F.hex("key_id")).alias("key_id"))
    s = boxes.systems(rows).select("file_id", F.lower(F.hex(F.get("key_ids", F.lit(0)))).alias("system_key"), F.col("data").cast("string").alias("data"))
    e = boxes.sample_encryption(rows).select("file_id", "idx", F.lower(F.hex("iv")).alias("iv"), F.array_join(F.transform("subsamples", lambda x: F.concat(x["clear"].cast("string"), F.lit(":"), x["encrypted"].cast("string"))), ",").alias("subsamples"))
    return p.join(s, "file_id").join(e, "file_id")


@_query("SELECT doc_id, md5(text) AS back, text IS NOT NULL AND strlen(text) > 0 AS changed, md5(encode(text)[1:3]) AS clear, md5(text) AS chacha FROM documents")
def q53_common_encryption(spark, sf_dir):
    """Whole texts through common encryption by subsamples, and through ChaCha20."""
    t, key, iv = F.col("t"), F.col("key"), F.col("iv")
    n = F.octet_length("t")
    subs = F.when(n > 40, F.array(*(F.struct(F.lit(c).alias("clear"), F.lit(e).alias("encrypted")) for c, e in ((3, 20), (1, 0), (2, 9))))).otherwise(F.array().cast("array<struct<clear: int, encrypted: int>>"))
    d = _table(crypto.in_small_batches(spark), sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("t"), F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("key"), F.substring(bits.big_endian16(F.col("doc_id")), 9, 8).alias("iv"))
    d = d.withColumn("sealed", crypto.cenc(t, key, iv, subs)).withColumn("long_key", F.concat("key", "key")).withColumn("nonce", F.concat("iv", F.lit(b"1234")))
    chacha = crypto.chacha20(crypto.chacha20(t, F.col("long_key"), F.col("nonce")), F.col("long_key"), F.col("nonce"))
    clear = F.substring(F.when(n > 40, F.col("sealed")).otherwise(t), 1, 3)
    return d.select("doc_id", F.md5(crypto.cenc(F.col("sealed"), key, iv, subs)).alias("back"), F.coalesce(F.col("sealed") != t, F.lit(False)).alias("changed"), F.md5(clear).alias("clear"), F.md5(chacha).alias("chacha"))
