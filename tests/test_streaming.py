import json
import threading

import pytest
from pyspark.sql import functions as F

from cinelake.operators import joins
from cinelake.sources import config, ranges
from cinelake.streaming import live
from cinelake.streaming.control import RateLimit, TaskManager


def playlist(first, n, end=False):
    lines = ["#EXTM3U", "#EXT-X-TARGETDURATION:4", f"#EXT-X-MEDIA-SEQUENCE:{first}"]
    for i in range(first, first + n):
        lines += ["#EXTINF:4,", f"s{i}.ts"]
    return "\n".join([*lines, *["#EXT-X-ENDLIST"] * end])


def test_live_recording_across_restarts(spark, tmp_path):
    folder, out, state = tmp_path / "in" / "chan", tmp_path / "out", tmp_path / "state"
    folder.mkdir(parents=True)

    def poll():
        rows = live.new_segments(live.segments(live.snapshots(spark, str(tmp_path / "in"), per_batch=1)))
        live.record(rows, str(state), live.appended(str(out))).awaitTermination()

    (folder / "001.m3u8").write_text(playlist(0, 3))
    (folder / "002.m3u8").write_text("garbage")
    poll()
    (folder / "003.m3u8").write_text(playlist(2, 3))
    (folder / "004.m3u8").write_text(playlist(4, 2, end=True))
    poll()
    rows = live.recorded(spark, str(out)).orderBy("place").collect()
    assert [r.url.rsplit("/", 1)[1] for r in rows] == [f"s{i}.ts" for i in range(6)]
    assert [r.seg_index for r in rows] == list(range(6)) and rows[-1].recorded_s == 24.0
    assert [r.stream_id for r in live.ended(live.recorded(spark, str(out))).collect()] == ["chan"]


def test_refresh(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.2,), (6.0,), (90.0,)], "t double")
    assert [r[0] for r in df.select(live.refresh_seconds(F.col("t"))).collect()] == [3.0, 3.0, 1.0, 6.0, 30.0]


def test_tasks(spark):
    seen, gate = [], threading.Event()
    manager = TaskManager(spark, 2, lambda t: seen.append((t.task_id, t.state)))
    manager.submit("count", lambda: spark.range(10).count())
    manager.submit("fails", lambda: 1 / 0)
    with pytest.raises(ValueError):
        manager.submit("count", lambda: None)
    manager.submit("held", gate.wait)
    manager.submit("held too", gate.wait)
    manager.submit("never", lambda: seen.append("ran"))
    assert manager.cancel("never") and not manager.cancel("unknown")
    gate.set()
    assert manager.wait() == {"count": "done", "fails": "failed", "held": "done", "held too": "done", "never": "cancelled"}
    assert manager.tasks["count"].result == 10 and "ran" not in seen and ("count", "done") in seen
    manager.close()


def test_rate_limit():
    now = [0.0]
    limit = RateLimit(100, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert limit.allow(100) and not limit.allow(1)
    limit.wait(250)
    assert 2.4 < now[0] < 2.7
    assert RateLimit(0).allow(10**9)


def test_byte_ranges(spark, tmp_path):
    path = tmp_path / "f.bin"
    data = bytes(range(256)) * 41 + b"xyz"
    path.write_bytes(data)
    ranges.register(spark)
    read = lambda n: spark.read.format("byte_ranges").option("path", f"file://{path}").option("size", str(n)).option("parts", "4").load()
    rows = read(len(data)).orderBy("part").collect()
    assert b"".join(bytes(r.data) for r in rows) == data and len(rows) == 4
    assert [(r.start, r.end) for r in read(3).collect()] == [(0, 2)]
    parts = read(len(data)).select("part", "start", "end")
    files = spark.createDataFrame([(0, len(rows[0].data)), (1, 5)], "part int, size long")
    assert [r.part for r in joins.complete_parts(parts, files).collect()] == [0]


def test_config_and_resume(spark):
    docs = spark.createDataFrame([(1, '{"thread_num": 2, "headers": {"a": "b"}, "del_after_done": false}'), (2, "broken")], "i int, body string")
    rows = {r.i: r for r in config.parse(docs).collect()}
    assert (rows[1].thread_num, rows[1].merge, rows[1].headers, rows[1].del_after_done) == (2, "ts2mp4", {"a": "b"}, False)
    assert (rows[2].thread_num, rows[2].save_dir) == (8, "/downloads")
    again = config.parse(config.parse(docs).select("i", config.to_json(config.parse(docs)).alias("body")))
    assert {r.i: r.thread_num for r in again.collect()} == {1: 2, 2: 8}
    tasks = spark.createDataFrame([("t", "u", 5), ("e", "u", 0)], "task_id string, url string, total int")
    done = spark.createDataFrame([("t", 0, "a"), ("t", 3, "b")], "task_id string, pos int, path string")
    states = config.resume_states(config.state_json(tasks, done))
    assert sorted((r.task_id, r.pos, r.path) for r in config.completed(states).collect()) == [("t", 0, "a"), ("t", 3, "b")]
    left = joins.pending(states.select("task_id", F.col("total").alias("n")), config.completed(states))
    assert sorted(r.pos for r in left.collect()) == [1, 2, 4]
    assert json.loads(config.state_json(tasks, done).filter("task_id = 'e'").first().body)["completed"] == {}


def test_keys_and_overlays(spark):
    enc = "struct<method: string, key: binary, key_url: string>"
    rows = [(1, ("AES-128", None, "k1")), (2, ("NONE", None, "k1")), (3, ("AES-128", None, "short")), (4, None)]
    seg = spark.createDataFrame(rows, f"pos int, enc {enc}")
    keys = spark.createDataFrame([("k1", bytearray(b"K" * 16)), ("short", bytearray(b"K"))], "key_url string, key binary")
    for small in (True, False):
        got = {r.pos: r.enc and r.enc.key for r in joins.with_keys(seg, keys, small).collect()}
        assert got == {1: b"K" * 16, 2: None, 3: None, 4: None}
    assert [r.key_url for r in joins.missing_keys(seg, keys).collect()] == ["short"]
    one = spark.range(1).select(joins.overlay_set(F.lit("base"), F.lit("")).alias("a"), joins.overlay_set(F.lit("base"), F.lit("over")).alias("b"), joins.overlay(F.create_map(F.lit("x"), F.lit("1")), F.lit(None)).alias("m")).first()
    assert (one.a, one.b, one.m) == ("base", "over", {"x": "1"})
