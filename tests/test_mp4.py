from pyspark.sql import functions as F

from cinelake.operators.ordered import alternated, concatenated
from cinelake.sinks.mp4 import elementary_config, mux, retracked
from cinelake.sources import boxes


def test_mux_and_read_back(spark):
    video = [("f", "video", i, p, d, i in (0, 3), bytearray(b"v%d" % i * (i + 1))) for i, (p, d) in enumerate([(0, 3000), (6000, 3000), (3000, 3000), (9000, 1500)])]
    audio = [("f", "audio", i, i * 2000, 2000, True, bytearray(b"a%d" % i)) for i in range(5)]
    samples = spark.createDataFrame(video + audio, "file_id string, kind string, idx int, pts long, duration long, is_key boolean, data binary")
    tracks = spark.createDataFrame(
        [("f", "video", "avc1", 90000, 640, 360, 0, 0, bytearray(b"\0\0\0\x0cavcCconf")), ("f", "audio", "mp4a", 44100, 0, 0, 2, 44100, None)],
        "file_id string, kind string, entry string, timescale long, width int, height int, channels int, sample_rate int, config binary",
    )
    esds = elementary_config(F.lit(2), F.lit(4), F.col("channels"))
    files = mux(samples, tracks.withColumn("config", F.when(F.col("kind") == "audio", esds).otherwise(F.col("config"))))
    rows = boxes.boxes(files).cache()
    paths = ["/".join(r.path) for r in rows.orderBy("pos").collect()]
    assert [p for p in paths if "/" not in p] == ["ftyp", "moov", "mdat"]
    assert "moov/trak/mdia/minf/stbl/stsd/avc1/avcC" in paths and "moov/trak/mdia/minf/stbl/stsd/mp4a/esds" in paths
    t = boxes.tracks(rows).orderBy("track").collect()
    assert [(x.track_id, x.width, x.height, x.timescale, x.handler, x.codec, x.language) for x in t] == [(1, 640, 360, 90000, "vide", "avc1", "und"), (2, 0, 0, 44100, "soun", "mp4a", "und")]
    got = boxes.samples(rows, files).orderBy("track", "idx").collect()
    assert [bytes(r.data) for r in got] == [bytes(r[6]) for r in video + audio]
    assert [round(r.duration_s * 90000) for r in got[:4]] == [3000, 3000, 3000, 1500]
    # interleaved by running time, video first on ties
    order = [bytes(r.data) for r in sorted(got, key=lambda r: r.offset)]
    assert order == [b"v0", b"a0", b"a1", b"a2", b"v1v1", b"v2v2v2", b"a3", b"a4", b"v3v3v3v3"]
    assert boxes.init_info(rows).first().movie_timescale == 90000


def test_fragments_in_turn(spark):
    fragment = lambda n: b"\0\0\0\x18moof\0\0\0\x10tfhd\0\0\0\0" + n.to_bytes(4, "big")
    df = lambda kind, n: spark.createDataFrame([("f", kind, i, bytearray(fragment(9))) for i in range(n)], "f string, kind string, i int, data binary")
    v, a = retracked(df("v", 2), F.lit(1)), retracked(df("a", 3), F.lit(2))
    rows = alternated(v, a, ["f"], ["i"])
    out = concatenated(rows.withColumn("init", F.lit(b"INIT")), "data", ["f"], ["sequence"], "init").first().data
    assert bytes(out) == b"INIT" + b"".join(fragment(n) for n in (1, 2, 1, 2, 2))


def test_every_track_header_and_nothing_else(spark):
    box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    tfhd = lambda n: box(b"tfhd", bytes(4) + n.to_bytes(4, "big"))
    decoy = bytes.fromhex("07466686400000000000000000")  # the name from half a byte on
    make = lambda n: box(b"free", decoy) + box(b"moof", box(b"traf", tfhd(n)) + box(b"traf", tfhd(n))) + box(b"mdat", b"tfhd" + bytes(8))
    df = spark.createDataFrame([("f", bytearray(make(9))), ("g", None), ("h", bytearray(b"no box"))], "f string, data binary")
    got = {r.f: r.data for r in retracked(df, F.lit(4)).collect()}
    assert bytes(got["f"]) == make(4) and got["g"] is None and bytes(got["h"]) == b"no box"
