import random

from pyspark.sql import functions as F

from cinelake.functions import text
from cinelake.sources import dash, hls, mss, subtitles
from cinelake.sources.manifests import format_of, read


def manifests(spark, *bodies, url="https://example.com/a/list.m3u8"):
    return spark.createDataFrame([(str(i), url, b) for i, b in enumerate(bodies)], "manifest_id string, url string, body string")


def test_attribute_lists(spark):
    lines = ['#EXT-X-STREAM-INF:A=1,B="x,y",C=z w,A=2', '#T:A="open, end', "#T: A=1, ,B=", "#T:no pairs", "#T", '#T:A="q"tail,B=3']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r.i: r.m for r in df.select("i", hls.attribute_map(F.col("line")).alias("m")).collect()}
    assert got[0] == {"A": "2", "B": "x,y", "C": "z w"}
    assert got[1] == {"A": "open, end"}
    assert got[2] == {"A": "1", "B": ""}
    assert got[3] == got[4] == {}
    assert got[5]["A"] == "q"


def walk(body):
    """A playlist's segments by one pass over its lines."""
    number, key, out, cur = 0, "", [], {}
    for line in filter(None, (x.strip() for x in body.split("\n"))):
        tag, _, value = line.partition(":")
        if tag == "#EXT-X-MEDIA-SEQUENCE":
            number = int(value) if value.lstrip("-").isdigit() else 0
        elif tag == "#EXT-X-KEY":
            method = value.split("METHOD=")[1].split(",")[0]
            if method in hls.METHODS:
                key = method
        elif tag == "#EXTINF":
            try:
                cur.update(duration=float(value.split(",")[0]), index=number, key=key)
                number += 1
            except ValueError:
                pass
        elif tag == "#EXT-X-BYTERANGE":
            n, _, at = value.partition("@")
            cur.update(range=(int(at or 0), int(n)))
        elif not line.startswith("#"):
            out.append((len(out), cur.get("index", 0), cur.get("duration", 0.0), cur.get("key", ""), *cur.get("range", (None, None)), "https://example.com/a/" + line))
            cur = {}
    return out


def test_segments_equal_a_sequential_walk(spark):
    rng = random.Random(3)
    tags = ["#EXTINF:4.5,t", "#EXTINF:6", "#EXTINF:bad", "#EXT-X-BYTERANGE:100@5", "#EXT-X-BYTERANGE:7", "#EXT-X-KEY:METHOD=AES-128,URI=\"k\"", "#EXT-X-KEY:METHOD=NONE", "#EXT-X-KEY:METHOD=ODD", "#EXT-X-MEDIA-SEQUENCE:9", "#EXT-X-MEDIA-SEQUENCE:x", "#EXT-X-DISCONTINUITY", "", "s.ts", "t.ts", "u.ts"]
    bodies = ["#EXTM3U\n" + "\n".join(rng.choices(tags, k=rng.randint(0, 40))) for _ in range(150)]
    rows = hls.media_segments(manifests(spark, *bodies)).select("manifest_id", "pos", "seg_index", "duration_s", "enc.method", "range_start", "range_len", "url", "enc.iv").collect()
    got = {}
    for r in rows:
        got.setdefault(int(r.manifest_id), []).append(tuple(r)[1:8])
        if r.method == "AES-128":
            assert int.from_bytes(r.iv, "big") == r.seg_index
    for i, body in enumerate(bodies):
        assert sorted(got.get(i, []), key=lambda r: r[0]) == walk(body), body


def test_master_gaps_and_errors(spark):
    gap = '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\n#EXT-X-MEDIA:TYPE=AUDIO,URI="skipped"\n#EXT-X-STREAM-INF:BANDWIDTH=2\nv1\norphan\n#EXT-X-MEDIA:TYPE=AUDIO,URI="kept"\n#EXT-X-STREAM-INF:BANDWIDTH=3\nv2'
    m = manifests(spark, gap, "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1", "", "#EXTM3U8")
    got = [(r.media_type, r.bandwidth, r.url.rsplit("/", 1)[1]) for r in hls.master_streams(m).orderBy("stream_idx").collect()]
    assert got == [("video", 1, "v1"), ("audio", 0, "kept"), ("video", 3, "v2")]
    assert {(r.manifest_id, r.error) for r in hls.errors(m).collect()} == {("1", "STREAM-INF without URL"), ("2", "empty playlist"), ("3", "missing #EXTM3U")}


def test_dash_details(spark):
    mpd = """<MPD><Period duration="PT10S"><AdaptationSet contentType="text"><SegmentList duration="4" startNumber="0"><SegmentURL media="a"/></SegmentList>
      <Representation id="x"><SegmentList duration="9"><SegmentURL media="no"/></SegmentList></Representation></AdaptationSet>
      <AdaptationSet mimeType="video/mp4"><ContentProtection schemeIdUri="urn:s" xmlns:cenc="c" cenc:default_KID="kid"/><SegmentTemplate duration="7" media="m$Number$"/>
      <Representation id="y"/></AdaptationSet></Period></MPD>"""
    m = manifests(spark, mpd, "<MPD></MPD>", "not xml at all", url="https://example.com")
    got = sorted((r.stream_idx, r.pos, r.seg_index, r.duration_s, r.url) for r in dash.segments(m).collect())
    assert got == [(0, 0, 1, 4.0, "https://a"), (1, 0, 1, 7.0, "https://m1")]
    assert [r.media_type for r in dash.streams(m).orderBy("stream_idx").collect()] == ["subtitles", "video"]
    assert [tuple(r)[1:] for r in dash.protection(m).collect()] == [(1, "urn:s", None, "kid")]
    assert [r.total_duration_s for r in dash.playlists(m).collect()] == [10.0, 10.0]


def test_mss_live_and_playlists(spark):
    ism = '<SmoothStreamingMedia Duration="0" IsLive="TRUE"><StreamIndex Type="video" Name="v" Chunks="2"><QualityLevel Bitrate="5"/><c d="10000000"/></StreamIndex></SmoothStreamingMedia>'
    m = manifests(spark, ism, url="http://x/m/")
    assert [(r.is_live, r.total_duration_s) for r in mss.playlists(m).collect()] == [(True, 0.0)]
    assert mss.segments(m).first().url == "http://x/m/QualityLevels(5)/Fragments(v=0)"


def test_subtitles(spark):
    body = "﻿WEBVTT\n\n1\n00:01.000 --> 00:02.000 line:0 position:20%\nA\n\nbroken --> 00:03.000\n\n00:00:04.5 --> 00:00:05.25\nB\nC"
    t = spark.createDataFrame([("d", body.lstrip("﻿")), ("n", "no header")], "doc_id string, body string")
    cues = lambda **k: [(r.id, r.start_us, r.end_us, r.text, r.settings) for r in subtitles.vtt_cues(t, **k).orderBy("pos").collect()]
    assert cues() == [("", 4_500_000, 5_250_000, "B\nC", "")]
    assert cues(spec=True) == [("1", 1_000_000, 2_000_000, "A", "line:0 position:20%"), ("", 4_500_000, 5_250_000, "B\nC", "")]
    assert [r.doc_id for r in subtitles.vtt_errors(t).collect()] == ["n"]
    srt = subtitles.to_srt(subtitles.vtt_cues(t, spec=True), comma=True).first().body
    assert srt == "1\n00:00:01,000 --> 00:00:02,000\nA\n\n2\n00:00:04,500 --> 00:00:05,250\nB\nC\n\n"


def test_reading_and_sniffing(spark, tmp_path):
    (tmp_path / "a.m3u8").write_text("#EXTM3U\n#EXTINF:1,\nx.ts")
    m = read(spark, str(tmp_path))
    assert hls.media_segments(m).first().url.endswith("/x.ts")
    assert m.select(format_of(F.col("body"), F.col("url"))).first()[0] == "hls"


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    s = F.lit
    assert value(text.iso_duration(s("PT1H2M3.5S"))) == 3723.5 and value(text.iso_duration(s(""))) == 0.0
    assert round(value(text.frame_rate(s("30000/1001"))), 2) == 29.97 and value(text.frame_rate(s("1/0"))) is None
    assert value(text.clock_us(s("1:2:3.5"))) == 3_723_500_000 and value(text.clock_us(s("x:1"))) is None and value(text.clock_us(s("5"))) is None
    assert value(text.ttml_us(s("100ms"))) == 100_000 and value(text.ttml_us(s("90f"))) == 3_000_000 and value(text.ttml_us(s(""))) is None
    assert value(text.join_path(s("http://h"), s("/a"))) == "http://h/a" and value(text.join_path(s("none"), s("x"))) == "x"
    assert value(text.resolve_url(s("http://h/a/b/c?q"), s("../d"))) == "http://h/a/d"
    assert value(text.byte_range(s("1024@5"))).asDict() == {"start": 5, "length": 1024}
    assert value(text.header(s("Name: a: b"))).asDict() == {"name": "Name", "value": "a: b"} and value(text.header(s("none"))) is None
    assert value(text.shortened(s("abcdef"), 4)) == "abc…" and value(text.without_escapes(s("\x1b[31mred\x1b[0m"))) == "red"
    assert value(text.tidy_pipes(s(" | a |  |  | b | "))) == "a | b" and value(text.visible_length(s("\x1b[1mab"))) == 2
    assert value(text.eta_text(s(3661.0))) == "01h01m01s" and value(text.eta_text(s(-1))) == "--m--s"
    assert value(text.fixed(s(1.005), 2)) == "1.00" and value(text.fixed(s(0.125), 2)) == "0.12"
    assert value(text.save_name(F.timestamp_seconds(s(86400)))) == "19700102_86400"
    assert value(text.base_url(s("http://h/a/b.m3u8?x=/y#z"))) == "http://h/a/" and value(text.directory(s("x"))) == "/"


def test_exact_decimals(spark):
    rng = random.Random(1)
    values = [0.0, 0.125, 0.375, 0.005, 0.015, 1.005, 2.5, 3.5, 0.5, 1.5, 999.995, 0.995, 1e-9, 1e-30, 5e-324, 123456789.125, 8.99e15, 1e15 + 0.5, -0.125, -1.005, -0.001, 29.97, 23.976]
    values += [rng.uniform(0, 10 ** rng.randint(-4, 12)) for _ in range(2000)] + [round(rng.uniform(0, 1000), 3) for _ in range(2000)] + [rng.randrange(10**6) / 8 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(text.fixed(F.col("v"), digits)).collect()]
        bad = [(v, g) for v, g in zip(values, got, strict=True) if g != f"{v:.{digits}f}"]
        assert not bad, bad[:5]
    assert spark.sql("select cast(null as double) v").select(text.fixed(F.col("v"), 2)).first()[0] is None
