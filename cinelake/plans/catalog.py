"""Every query by name, with the DuckDB SQL it is held against.

The reference of an ordered operator on a driver table names the columns that
order its rows; all computed columns have the same names on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, crypto, text
from ..operators import joins, ordered, progress, select
from ..sources import boxes, config, dash, hls, mss, ranges, subtitles
from ..sources.manifests import format_of
from . import fixtures

PART = {"p_name": "name", "p_brand": "group_id", "p_type": "codecs", "p_size": "segments_count", "p_retailprice": "bandwidth", "p_partkey": "stream_idx"}
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a catalogue of streams."""
    return _table(spark, sf_dir, "part").select(*(F.col(a).alias(b) for a, b in PART.items()))


def q01_stream_select(spark, sf_dir):
    """The second best of each brand among the streams that a filter matches."""
    spec = 'name=^(large|small|cold) :codecs="ECONOMY|PROMO|LARGE":id=Brand:segsmin=5:segsmax=45:bwmin=901:bwmax=100000:for=best2'
    return select.selected(_catalog(spark, sf_dir), spec, ["group_id"]).select(*PART.values())


def q02_stream_worst(spark, sf_dir):
    """The third worst of each brand and type."""
    return select.selected(_catalog(spark, sf_dir), "bwmin=1:for=worst3", ["group_id", "codecs"]).select("group_id", "codecs", "stream_idx", "bandwidth")


def q02b_auto_select(spark, sf_dir):
    """The first stream of each brand unless a "video" has more bandwidth."""
    return select.auto_selected(_catalog(spark, sf_dir), ["group_id"], is_video=F.col("codecs").isin("ECONOMY", "PROMO")).select("group_id", "stream_idx", "codecs", "bandwidth")


def q03_segment_clock(spark, sf_dir):
    """Start times of an order's items, with the order's total and count."""
    rows = ordered.clocked(_table(spark, sf_dir, "lineitem"), F.col("l_quantity"), ["l_orderkey"], ITEM_ORDER, name="start_time")
    return rows.select("l_orderkey", *ITEM_ORDER, "l_quantity", "start_time")


def q03b_totals(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total_duration"), F.count("*").alias("segments_count"))


def q03c_clock_reset(spark, sf_dir):
    """Running time that an item's discount of ten percent sets anew."""
    reset = F.when(F.col("l_discount") == 0.1, F.col("l_partkey"))
    rows = ordered.clocked(_table(spark, sf_dir, "lineitem"), F.col("l_quantity"), ["l_orderkey"], ITEM_ORDER, reset, "start_time")
    return rows.select("l_orderkey", *ITEM_ORDER, F.col("start_time").cast("double").alias("start_time"))


def q04_carry_forward(spark, sf_dir):
    """The last error of each user, and numbers that a signup sets anew."""
    e = _table(spark, sf_dir, "events")
    by, order = ["user_id"], ["ts", "event_id"]
    rows = ordered.carried(e, F.when(F.col("event_type") == "error", F.col("event_id")), by, order, "current_key")
    rows = ordered.numbered_from(rows, F.when(F.col("event_type") == "signup", F.col("event_id") % 100), F.col("event_type") == "view", by, order, "media_index")
    return rows.select("event_id", "user_id", "event_type", "current_key", "media_index")


def q05_run_expand(spark, sf_dir):
    """Items repeated by line number, with running times; summed up by order."""
    rows = ordered.expanded(_table(spark, sf_dir, "lineitem"), F.col("l_linenumber"))
    rows = ordered.clocked(rows, F.col("l_quantity"), ["l_orderkey"], [*ITEM_ORDER, "rep"], name="at")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("at").alias("last_at"), F.sum("at").alias("sum_at"))


def q06_run_encode(spark, sf_dir):
    rows = ordered.runs(_table(spark, sf_dir, "events"), "event_type", ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n")


def q07_chunk_lookup(spark, sf_dir):
    """The last signup at or before each view of a user, by event number."""
    e = _table(spark, sf_dir, "events")
    entries = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("first_chunk"), "value")
    chunks = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("chunk"))
    rows = ordered.chunk_of(entries, chunks, ["user_id"], "first_chunk", "chunk")
    return rows.select("user_id", "chunk", F.col("entry.value").alias("value"))


def q07b_chunk_offsets(spark, sf_dir):
    """Byte offsets of items within their order."""
    rows = ordered.clocked(_table(spark, sf_dir, "lineitem"), F.col("l_extendedprice").cast("bigint"), ["l_orderkey"], ITEM_ORDER, name="sample_offset")
    return rows.select("l_orderkey", *ITEM_ORDER, "sample_offset")


def _two_inputs(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("value") * 100).cast("bigint").alias("pts"), F.length("props").cast("bigint").alias("size"))
    return e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'click'").drop("event_type")


def q08_interleave(spark, sf_dir):
    """Views and clicks of a user merged by a time that may go back, with offsets."""
    v, a = _two_inputs(spark, sf_dir)
    rows = ordered.interleaved(v, a, "pts", ["user_id"], ["event_id"], "size", 48)
    return rows.select("user_id", "event_id", "is_b", F.col("place").cast("long").alias("place"), "offset")


def q09_alternate(spark, sf_dir):
    v, a = _two_inputs(spark, sf_dir)
    return ordered.alternated(v, a, ["user_id"], ["event_id"]).select("user_id", "event_id", F.col("sequence").cast("long").alias("sequence"))


def q10_first_of_key(spark, sf_dir):
    return ordered.first_of(_table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def q11_pending(spark, sf_dir):
    """Positions 0 to 7 of each part without an item of that line number."""
    tasks = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.lit(8).alias("n"))
    done = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("task_id"), F.col("l_linenumber").alias("pos")).distinct()
    return joins.pending(tasks, done)


def q12_key_attach(spark, sf_dir):
    """Items with their supplier's key; suppliers in the red have none."""
    item = _table(spark, sf_dir, "lineitem")
    keys = _table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").cast("string").alias("key_url"), F.unhex(F.md5("s_name")).alias("key"))
    enc = F.struct(F.lit("AES-128").alias("method"), F.lit(None).cast("binary").alias("key"), F.col("l_suppkey").cast("string").alias("key_url"))
    rows = joins.with_keys(item.select("l_orderkey", *ITEM_ORDER, enc.alias("enc")), keys, small=True)
    return rows.select("l_orderkey", *ITEM_ORDER, F.lower(F.hex("enc.key")).alias("key_hex"))


def q13_progress(spark, sf_dir):
    """Progress of each user at a fixed time, from all their events."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.floor(F.col("value") * 100).cast("bigint").alias("bytes"), F.col("ts").cast("timestamp").alias("at"))
    tasks = e.groupBy("task_id").agg((F.count("*") + F.max("task_id") % 5).alias("segments"), F.min("at").alias("started"))
    tasks = tasks.withColumn("total_bytes", F.when(F.col("task_id") % 2 == 0, F.col("segments") * 30000).otherwise(0))
    rows = progress.snapshot(e, tasks, F.lit("2024-03-01 00:00:00").cast("timestamp"), 20 * 86400)
    return rows.withColumns({c: F.round(c, 6) for c in ("elapsed", "percent", "eta")})


def q14_trailing(spark, sf_dir):
    """Sums over the last six hours at each event of a user."""
    e = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cents", F.floor(F.col("value") * 100).cast("bigint"))
    rows = progress.trailing(e, ["user_id"], "ts", "cents", 21600)
    return rows.select("event_id", "recent", (F.unix_micros("ts") - F.unix_micros("oldest")).alias("span_us"))


def q15_split_ranges(spark, sf_dir):
    return ordered.split_ranges(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars"), 4)


def q16_ordered_concat(spark, sf_dir):
    return ordered.joined_text(_table(spark, sf_dir, "conversations"), "text", ["conv_id"], ["turn"])


def q16b_binary_concat(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("data"), F.col("role").cast("binary").alias("init"))
    rows = ordered.concatenated(rows.withColumn("init", F.lit(b"init")), "data", ["conv_id"], ["turn"], "init")
    return rows.select("conv_id", F.md5("data").alias("md5"), F.octet_length("data").cast("long").alias("n_bytes"))


def q16c_srt(spark, sf_dir):
    """Conversations as subtitles of a second a turn."""
    c = _table(spark, sf_dir, "conversations")
    cues = c.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("pos"), (F.col("turn") * 1_234_567).alias("start_us"), ((F.col("turn") + 1) * 1_234_567).alias("end_us"), "text")
    return subtitles.to_srt(subtitles.shifted(cues, 2_000_000))


def q17_addresses(spark, sf_dir):
    p, url = _table(spark, sf_dir, "pages"), F.col("url")
    return p.select(
        "page_id", text.base_url(url).alias("base"), text.join_path(url, F.lit("seg.m4s")).alias("relative"), text.join_path(url, F.lit("/abs/seg.m4s")).alias("absolute"),
        text.join_path(url, F.lit("")).alias("empty"), text.fragment_url(F.concat(url, F.lit("//")), F.col("page_id"), F.lit("video"), F.col("page_id") * 10).alias("fragment"),
        text.resolve_url(url, F.lit("https://other.example.org/x")).alias("passed"),
    )


def q18_formats(spark, sf_dir):
    item, price = _table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")
    return item.select(
        "l_orderkey", *ITEM_ORDER, text.size_text(price * 5000).alias("size_text"), text.eta_text(F.col("l_partkey")).alias("eta_text"), text.duration_text(price / 10).alias("duration_text"),
        text.bandwidth_text(price * 100).alias("bandwidth"), text.bandwidth_short((price * 100).cast("bigint")).alias("bandwidth_short"), text.clock((price * 1_000_000).cast("bigint")).alias("clock"),
    )


def q19_pts_bits(spark, sf_dir):
    o, v = _table(spark, sf_dir, "orders"), F.col("o_orderkey") * 104729 % (1 << 33)
    packed = o.select("o_orderkey", v.alias("pts"), bits.pack_pts(v).alias("p"))
    return packed.select("o_orderkey", "pts", F.hex("p").alias("packed"), bits.unpack_pts(F.col("p")).alias("unpacked"))


def q20_overlay(spark, sf_dir):
    """A user's first settings under the latest ones."""
    e = _table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    ends = e.groupBy("user_id").agg(F.min_by("m", F.struct("ts", "event_id")).alias("a"), F.max_by("m", F.struct("ts", "event_id")).alias("b"), F.count("*").alias("n"))
    base = F.map_concat("a", F.create_map(F.lit("only_base"), F.col("n").cast("string")))
    rows = ends.withColumn("m", joins.overlay(base, F.col("b")))
    return rows.select("user_id", F.col("m")["k"].alias("k"), F.col("m")["only_base"].alias("only_base"))


def _manifests(spark, *rows):
    return spark.createDataFrame([(n, u, b) for n, u, b in rows], "manifest_id string, url string, body string")


def _hls_texts(spark):
    return _manifests(spark, ("master", fixtures.BASE, fixtures.MASTER), ("media", fixtures.BASE, fixtures.MEDIA), ("live", fixtures.BASE, fixtures.LIVE), ("bad", fixtures.BASE, "no playlist"))


def q21_hls_streams(spark, sf_dir):
    s = hls.master_streams(_hls_texts(spark))
    return s.select("manifest_id", F.col("stream_idx").cast("int").alias("stream_idx"), "media_type", "group_id", "language", "name", "bandwidth", "codecs", "resolution", "frame_rate", "url")


def q21b_hls_segments(spark, sf_dir):
    s = hls.media_segments(_hls_texts(spark))
    return s.select("manifest_id", "pos", "seg_index", "duration_s", "url", "range_start", "range_len", F.col("enc.method").alias("method"), F.col("enc.key_url").alias("key_url"), F.hex("enc.iv").alias("iv"))


def q21c_hls_playlists(spark, sf_dir):
    return hls.media_playlists(_hls_texts(spark)).select("manifest_id", "is_live", "refresh_ms", "total_duration_s", "target_duration_s", F.col("init.url").alias("init_url"), F.col("init.range_len").alias("init_len"))


def q22_dash_segments(spark, sf_dir):
    s = dash.segments(_manifests(spark, ("mpd", "https://example.com/d/m.mpd", fixtures.MPD)))
    return s.select("stream_idx", "pos", "seg_index", "duration_s", "url")


def q22b_dash_streams(spark, sf_dir):
    s = dash.streams(_manifests(spark, ("mpd", "https://example.com/d/m.mpd", fixtures.MPD)))
    return s.select("stream_idx", "media_type", "language", "name", "bandwidth", "resolution", F.round("frame_rate", 4).alias("frame_rate"), "url", "segments_count")


def q22c_mss_segments(spark, sf_dir):
    return mss.segments(_manifests(spark, ("ism", "https://example.com/v.ism/", fixtures.ISM))).select("stream_idx", "pos", "duration_s", "url")


def q22d_mss_streams(spark, sf_dir):
    s = mss.streams(_manifests(spark, ("ism", "https://example.com/v.ism/", fixtures.ISM)))
    return s.select("stream_idx", "media_type", "language", "name", "bandwidth", "codecs", "resolution", "channels", "segments_count")


def q23_cues(spark, sf_dir):
    doc = lambda n, b: spark.createDataFrame([(n, b)], "doc_id string, body string")
    rows = subtitles.vtt_cues(doc("vtt", fixtures.VTT)).unionByName(subtitles.ttml_cues(doc("ttml", fixtures.TTML)))
    return rows.select("doc_id", F.col("pos").cast("int").alias("pos"), "id", "start_us", "end_us", "text", "settings")


def q24_live_dedup(spark, sf_dir):
    """Events as a stream of snapshots; each type of a user is new once."""
    from ..streaming import live

    schema = _table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a file or a folder
    rows = live.new_segments(events.select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_type").alias("url")))
    folder = _shared(spark, "live")
    live.record(rows, f"{folder}/state", live.appended(f"{folder}/rows")).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select(F.col("stream_id").cast("long").alias("user_id"), F.col("url").alias("event_type"))


def _shared(spark, label):
    """A new folder that driver and executors share."""
    import tempfile
    import uuid

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{(named or tempfile.mkdtemp(prefix='cinelake-')).rstrip('/')}/cinelake-{label}-{uuid.uuid4().hex}"


def q25_aes_round_trip(spark, sf_dir):
    """Whole texts encrypted and decrypted again, in padded, unpadded and counter mode."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("t"), F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("key"), bits.big_endian16(F.col("doc_id")).alias("iv"))
    cbc = F.substring(F.aes_encrypt("t", "key", F.lit("CBC"), F.lit("PKCS"), "iv"), F.lit(17), F.lit(2**31 - 1))
    d = d.withColumn("sealed", crypto.aes_ctr(F.col("t"), F.col("key"), F.col("iv")))
    out = d.select(
        "doc_id", F.md5(crypto.decrypted(cbc, F.lit("AES-128"), F.col("key"), F.col("iv"))).alias("cbc"),
        F.md5(crypto.decrypted(F.aes_encrypt("t", "key", F.lit("ECB"), F.lit("PKCS")), F.lit("AES-128-ECB"), F.col("key"), F.col("iv"))).alias("ecb"),
        F.md5(crypto.aes_ctr(F.col("sealed"), F.col("key"), F.col("iv"))).alias("ctr"), (F.col("sealed") != F.col("t")).alias("changed"),
    )
    return out


def q26_boxes(spark, sf_dir):
    """Containers built of boxes from documents, and walked again."""
    body = F.col("text").cast("binary")
    d = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.concat(boxes.box(F.lit("ftyp"), F.lit(b"isom")), boxes.box(F.lit("moov"), F.concat(boxes.box(F.lit("trak"), boxes.box(F.lit("free"), body)), boxes.box(F.lit("udta"), F.lit(b""))))).alias("content"),
    )
    rows = boxes.boxes(d)
    return rows.select(F.col("file_id").cast("long").alias("doc_id"), F.array_join("path", "/").alias("path"), "depth", "pos", "size", "offset")


def q27_display(spark, sf_dir):
    rows = _catalog(spark, sf_dir).withColumns({"media_type": F.when(F.col("codecs") == "PROMO", "audio").when(F.col("codecs") == "SMALL", "subtitles").otherwise("video"), "bandwidth": (F.col("bandwidth") * 1000).cast("bigint")})
    rows = rows.withColumns({"frame_rate": F.lit(25.0), "language": F.lit(""), "channels": F.lit("2"), "role": F.lit(""), "resolution": F.lit(""), "video_range": F.lit("")})
    return select.display(rows).select("stream_idx", "full", "short")


def q28_listing(spark, sf_dir):
    rows = _catalog(spark, sf_dir).select(F.col("group_id").alias("manifest_id"), "stream_idx", F.when(F.col("codecs") == "PROMO", "audio").when(F.col("codecs") == "SMALL", "subtitles").otherwise("video").alias("media_type"), F.col("name").alias("language"))
    return select.listed(rows).select("manifest_id", "stream_idx", F.col("place").cast("long").alias("place"), "is_default", "first_of_language")


def q29_durations(spark, sf_dir):
    """Distances between a user's values where they rise."""
    e = _table(spark, sf_dir, "events").withColumn("pts", F.floor(F.col("value") * 100).cast("bigint"))
    return ordered.durations_from_next(e, "pts", ["user_id"], ["ts", "event_id"], 3600).select("event_id", F.col("duration").cast("long").alias("duration"))


def q30_key_indexes(spark, sf_dir):
    rows = ordered.marked_indexes(_table(spark, sf_dir, "events"), F.col("event_type") == "purchase", ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", "event_id", F.col("index").cast("long").alias("index"))


def q31_movie_duration(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.col("event_id").alias("idx"), F.floor(F.col("value") * 100).cast("bigint").alias("pts"), F.lit(3600).cast("bigint").alias("duration"), F.col("props").cast("binary").alias("data")
    )
    return progress.movie_duration(e, ["user_id"], "event_type")


def q32_config(spark, sf_dir):
    """Settings in JSON over the defaults."""
    doc = F.concat(F.lit('{"thread_num": '), (F.col("user_id") % 9).cast("string"), F.lit(', "headers": '), F.col("props"), F.lit("}"))
    rows = config.parse(_table(spark, sf_dir, "events").select("event_id", doc.alias("body")))
    return rows.select("event_id", "thread_num", "retry_count", "merge", F.col("headers")["k"].alias("k"))


def q33_byte_ranges(spark, sf_dir):
    """Ranges of documents' bytes; beyond the end they are cut."""
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("text").cast("binary").alias("content"))
    want = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), (F.col("doc_id") % 50).alias("range_start"), F.when(F.col("doc_id") % 3 > 0, F.lit(200).cast("bigint")).alias("range_len"))
    return ranges.segment_bytes(want, files).select("doc_id", F.md5("data").alias("md5"), F.octet_length("data").cast("long").alias("n"))


def q34_format_sniff(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", format_of(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("#EXTM3U "), F.col("url"))).when(F.col("page_id") % 3 == 1, "<MPD>").otherwise(""), F.concat("url", F.when(F.col("page_id") % 2 == 0, ".ism").otherwise(""))).alias("format"))


def q35_scalars(spark, sf_dir):
    """Durations, rates, ranges, times and codecs read from texts made of events."""
    e, k = _table(spark, sf_dir, "events"), F.col("event_id")
    s = lambda c: c.cast("string")
    return e.select(
        "event_id",
        text.iso_duration(F.concat(F.lit("PT"), s(k % 5), F.lit("H"), s(k % 61), F.lit("M"), s(k % 7), F.lit(".5S"))).alias("iso"),
        F.round(text.frame_rate(F.concat(s(k % 60 * 1000), F.lit("/"), s(k % 2 * 1001))), 6).alias("rate"),
        text.byte_range(F.concat(s(k), F.when(k % 2 == 0, F.concat(F.lit("@"), s(k * 2))).otherwise("")))["start"].alias("range_start"),
        text.clock_us(F.concat(F.lpad(s(k % 60), 2, "0"), F.lit(":"), F.lpad(s(k % 59), 2, "0"), F.lit(".250"))).alias("vtt_us"),
        text.ttml_us(F.concat(s(k % 300), F.element_at(F.array(F.lit("f"), F.lit("t"), F.lit("s"), F.lit("ms")), (k % 4 + 1).cast("int")))).alias("ttml_us"),
        mss.codec_of(F.element_at(F.array(F.lit("H264"), F.lit("aacl"), F.lit("WVC1")), (k % 3 + 1).cast("int"))).alias("codec"),
        text.speed_bytes(F.concat(s(k % 100), F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit(""), F.lit("x")), (k % 4 + 1).cast("int")))).alias("speed"),
        text.segment_file(k).alias("file"), text.retry_delay_ms(k % 4).alias("delay"),
        text.fill_template(F.lit("$RepresentationID$_$Number$_$Time$_$Timescale$"), k, k * 9, F.lit(90000)).alias("filled"),
    )


QUERIES = {name: f for name, f in globals().items() if name.startswith("q") and callable(f)}

from .oracle import ORACLE_SQL  # noqa: E402
from . import media  # noqa: E402

QUERIES |= media.QUERIES
ORACLE_SQL = ORACLE_SQL | media.ORACLE_SQL
