import pytest
from pyspark.sql import functions as F

from cinelake.operators.select import auto_selected, compile_filter, display, listed, matching, selected, split_by_type

COLUMNS = "manifest_id string, stream_idx int, media_type string, group_id string, language string, name string, bandwidth long, codecs string, resolution string, frame_rate double, channels string, video_range string, role string, url string, segments_count long"
ROWS = [
    ("m", 0, "video", "", "", "low", 800_000, "avc1.4d", "640x360", 25.0, "", "SDR", "", "http://a/low", 3),
    ("m", 1, "video", "", "", "mid", 2_000_000, "avc1.64", "1280x720", 29.97, "", "SDR", "Main", "http://a/mid", 30),
    ("m", 2, "video", "", "", "top", 2_000_000, "hev1", "1920x1080", 59.94, "", "PQ", "main", "http://a/top", 300),
    ("m", 3, "audio", "aud", "en", "English", 128_000, "mp4a", "", 0.0, "2", "", "", "http://a/en", 1),
    ("m", 4, "audio", "aud", "en", "English 5.1", 256_000, "ec-3", "", 0.0, "6", "", "", "http://a/en6", 0),
    ("m", 5, "subtitles", "sub", "de", "Deutsch", 0, "", "", 0.0, "", "", "forced", "http://a/de", 0),
]


@pytest.fixture(scope="module")
def streams(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("res=1080|720", {1, 2}), ('codecs="avc1":bwmin=1000000', {1}), ("frame=^29.97$", {1}), ("id=aud:lang=en:ch=6", {4}), ("language=^$:name=o", {0, 2}),
        ("segsmin=2:segsmax=100", {0, 1}), ("segsmin=-4:segsmax=x", {0, 1, 2, 3, 4, 5}), ("range=PQ", {2}), ("url=/en", {3, 4}), ("bwmax=256000", {3, 4, 5}),
        ("role=MAIN", {1, 2}), (" : name = mid : ", {1}), ("framerate=0.00:channels=2", {3}), ("name=Deutsch:name=low", {0}), ("", {0, 1, 2, 3, 4, 5}),
    ],
)
def test_predicates(streams, text, want):
    assert {r.stream_idx for r in matching(streams, text).collect()} == want


@pytest.mark.parametrize("text", ["name", "colour=red", "res=1:oops"])
def test_bad_parts(text):
    with pytest.raises(ValueError):
        compile_filter(text)


@pytest.mark.parametrize(
    ("mode", "want"),
    [("best", [1]), ("best1", [1]), ("best2", [2]), ("best3", [1]), ("best9", [1]), ("worst", [0]), ("worst2", [2]), ("worst3", [0]), ("worst0", [0]), ("bestx", [1]), ("BEST2", [2]), ("all", [1, 2, 0])],
)
def test_nth(streams, mode, want):
    rows = selected(streams.filter("media_type = 'video'"), f"for={mode}", ["manifest_id"])
    rows = rows.orderBy("rank") if "rank" in rows.columns else rows
    assert [r.stream_idx for r in rows.collect()] == want


def test_auto_split_listing_display(streams):
    assert auto_selected(streams, ["manifest_id"]).first().stream_idx == 1
    assert auto_selected(streams.filter("stream_idx >= 3"), ["manifest_id"]).first().stream_idx == 3
    video, audio = split_by_type(streams)
    assert (video.count(), audio.count()) == (4, 2)
    rows = {r.stream_idx: r for r in listed(streams).collect()}
    assert [rows[i].first_of_language for i in (3, 4, 5)] == [True, False, False] and rows[0].is_default
    text = {r.stream_idx: r for r in display(streams).collect()}
    assert text[1].full == "Vid 1280x720 | 2.0 Mbps | 30 | avc1.64 | SDR | 30 Segments"
    assert text[3].full == "Aud aud | 128 Kbps | English | mp4a | en | 2 | 1 Segment"
    assert text[5].full == "Sub sub | de | Deutsch | forced"
    assert text[0].short == "Vid 640x360 | 800 Kbps | 25 | avc1.4d | SDR"


def test_predicate_is_one_codegen_stage(streams):
    plan = matching(streams.filter(F.col("stream_idx") >= 0), "res=1080:bwmin=5")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
