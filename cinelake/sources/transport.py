"""MPEG transport streams: packets, tables, packetised streams, samples.

Packets come from a walk over each file; everything after is windows over packet
numbers: a stream's bytes are those of its packets, grouped at unit starts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import aac_frame_duration, adts_header, is_key_frame, take, uint, unpack_pts
from ..operators.ordered import concatenated
from ..schemas import TS_PACKETS

SIZE, SYNC = 188, 0x47
#: Stream types of programme tables.
CODECS = {0x1B: "h264", 0x24: "hevc", 0x0F: "aac", 0x11: "aac", 0x03: "mp3", 0x04: "mp3", 0x81: "ac3"}
#: Taken for video and audio where a file has no tables.
DEFAULT_PIDS = {"video": 256, "audio": 257}
NALS = "file_id string, pos int, idx int, nal_type int, hevc_type int, data binary"


def packets(files: DataFrame) -> DataFrame:
    """``TS_PACKETS`` of files (``file_id``, ``content``); bytes before a sync byte
    are passed over."""

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, at, n = data or b"", 0, 0
                out = [[] for _ in range(5)]
                while at + SIZE <= len(data):
                    if data[at] != SYNC:
                        at += 1
                        continue
                    p = data[at : at + SIZE]
                    kind = p[3] >> 4 & 3
                    start = 5 + p[4] if kind & 2 else 4
                    payload = p[start:] if kind & 1 and start <= SIZE else b""
                    for column, value in zip(out, (n, (p[1] & 31) << 8 | p[2], bool(p[1] & 64), kind, payload), strict=True):
                        column.append(value)
                    at, n = at + SIZE, n + 1
                kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["file_id", "n", "pid", "pusi", "adaptation", "payload"]
                )

    return files.select(F.col("file_id").cast("string"), F.col("content").cast("binary")).mapInArrow(run, TS_PACKETS)


def _section(payload: Column) -> Column:
    """A table section: after the pointer byte and as many bytes as it says."""
    return take(payload, 1 + uint(payload, 0, 1), F.octet_length(payload))


def _pid(body: Column, at: Column) -> Column:
    return uint(body, at, 2).bitwiseAND(F.lit(0x1FFF)).cast("int")


def programmes(rows: DataFrame) -> DataFrame:
    """``file_id`` and ``pmt_pid`` of each programme; the last table counts."""
    s = _section(F.col("payload"))
    table = rows.filter("pid = 0 and pusi and octet_length(payload) > 1").groupBy("file_id").agg(F.max_by(s, "n").alias("s"))
    size = uint(F.col("s"), 1, 2).bitwiseAND(F.lit(0x0FFF))
    n = F.floor((F.least(size + 3, F.octet_length("s")) - 12) / 4)
    entries = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.struct(uint(F.col("s"), 8 + i * 4, 2).alias("programme"), _pid(F.col("s"), 10 + i * 4).alias("pmt_pid"))))
    return table.select("file_id", F.explode(entries).alias("e")).select("file_id", "e.*").filter("programme != 0")


def elementary(rows: DataFrame) -> DataFrame:
    """``file_id``, ``pid``, ``codec``, ``kind`` of each stream, from the programme
    tables; the usual two where a file has none."""
    tables = rows.join(programmes(rows).withColumnRenamed("pmt_pid", "pid"), ["file_id", "pid"]).filter("pusi and octet_length(payload) > 1")
    tables = tables.groupBy("file_id", "programme").agg(F.max_by(_section(F.col("payload")), "n").alias("s"))
    size = uint(F.col("s"), 1, 2).bitwiseAND(F.lit(0x0FFF))
    info = uint(F.col("s"), 10, 2).bitwiseAND(F.lit(0x0FFF))
    end = F.least(size + 3, F.octet_length("s")) - 4
    # entries have different sizes: walked with the next place in hand
    zero = F.struct((12 + info).alias("at"), F.array().cast("array<struct<type: int, pid: int>>").alias("out"))

    def step(acc, _):
        entry = F.struct(uint(F.col("s"), acc["at"], 1).cast("int").alias("type"), _pid(F.col("s"), acc["at"] + 1).alias("pid"))
        after = acc["at"] + 5 + uint(F.col("s"), acc["at"] + 3, 2).bitwiseAND(F.lit(0x0FFF))
        more = acc["at"] + 5 <= end
        return F.struct(F.when(more, after).otherwise(acc["at"]).alias("at"), F.when(more, F.array_append(acc["out"], entry)).otherwise(acc["out"]).alias("out"))

    steps = F.sequence(F.lit(0), F.greatest(F.floor(end / 5).cast("int"), F.lit(0)))  # an entry has five bytes at least
    found = tables.select("file_id", F.explode(F.aggregate(steps, zero, step)["out"]).alias("e")).select("file_id", "e.*")
    codec = F.create_map(*(F.lit(x) for pair in CODECS.items() for x in pair))
    found = found.select("file_id", "pid", F.try_element_at(codec, F.col("type")).alias("codec")).filter("codec is not null")
    usual = rows.select("file_id").distinct().join(found.select("file_id").distinct(), "file_id", "left_anti")
    usual = usual.select("file_id", F.explode(F.array(*(F.struct(F.lit(p).alias("pid"), F.lit("h264" if k == "video" else "aac").alias("codec")) for k, p in DEFAULT_PIDS.items()))).alias("e")).select("file_id", "e.*")
    out = found.distinct().unionByName(usual)
    return out.withColumn("kind", F.when(F.col("codec").isin("h264", "hevc"), "video").otherwise("audio"))


def units(rows: DataFrame, streams: DataFrame) -> DataFrame:
    """Packetised units: ``file_id``, ``pid``, ``unit``, ``data``; bytes before a
    stream's first unit start are dropped."""
    w = Window.partitionBy("file_id", "pid").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.join(streams.select("file_id", "pid"), ["file_id", "pid"], "left_semi").withColumn("unit", F.sum(F.col("pusi").cast("int")).over(w))
    return concatenated(own.filter("unit > 0"), "payload", ["file_id", "pid", "unit"], ["n"])


def headers(pes: DataFrame) -> DataFrame:
    """Units with ``pts``, ``dts`` and the payload after the header."""
    d = F.col("data")
    valid = take(d, 0, 3) == F.lit(b"\x00\x00\x01")
    flags = F.shiftright(uint(d, 7, 1), 6)
    pts = F.when(flags >= 2, unpack_pts(d, 9))
    return pes.filter(valid).select(
        "file_id", "pid", "unit", pts.alias("pts"), F.when(flags == 3, unpack_pts(d, 14)).otherwise(pts).alias("dts"), take(d, 9 + uint(d, 8, 1), F.octet_length(d)).alias("payload")
    )


def nal_units(rows: DataFrame, key: str = "file_id", pos: str = "pos", data: str = "data", sized: int = 0) -> DataFrame:
    """NAL units of byte streams with start codes, or with sizes of ``sized`` bytes."""

    def split(b: bytes):
        if sized:
            at = 0
            while at + sized <= len(b):
                n = int.from_bytes(b[at : at + sized], "big")
                if n <= 0 or at + sized + n > len(b):
                    return
                yield b[at + sized : at + sized + n]
                at += sized + n
            return
        at = b.find(b"\0\0\1")
        while at >= 0:
            after = b.find(b"\0\0\1", at + 3)
            unit = b[at + 3 : after if after >= 0 else len(b)]
            if after > 0 and unit.endswith(b"\0"):
                unit = unit[:-1]
            if unit:
                yield unit
            at = after

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for file, p, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for i, unit in enumerate(split(b or b"")):
                    for column, value in zip(out, (file, p, i, unit[0] & 31, unit[0] >> 1 & 63, unit), strict=True):
                        column.append(value)
            kinds = (pa.string(), *[pa.int32()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["file_id", "pos", "idx", "nal_type", "hevc_type", "data"])

    return rows.select(F.col(key).cast("string"), F.col(pos).cast("int"), F.col(data).cast("binary")).mapInArrow(run, NALS)


def adts_frames(rows: DataFrame, key: list[str], data: str = "data", pts: str = "pts", timescale: int = 90000) -> DataFrame:
    """Audio frames of each row's bytes, ``frame`` by ``frame``, with their times:
    the row's, plus a frame's duration for each before it. Bytes that start no
    frame are passed over."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in key) + ", pts bigint, frame int, header binary, body binary"

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(len(key) + 5)]
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(key) + 2)), strict=True):
                b, at, n = row[-1] or b"", 0, 0
                while at + 7 <= len(b):
                    if b[at] != 0xFF or b[at + 1] & 0xF0 != 0xF0:
                        at += 1
                        continue
                    size, head = (b[at + 3] & 3) << 11 | b[at + 4] << 3 | b[at + 5] >> 5, 7 if b[at + 1] & 1 else 9
                    if size < head or at + size > len(b):
                        break
                    for column, value in zip(out, (*row[:-1], n, b[at : at + head], b[at + head : at + size]), strict=False):
                        column.append(value)
                    at, n = at + size, n + 1
            kinds = [batch.schema.field(i).type for i in range(len(key))] + [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=[*key, "pts", "frame", "header", "body"])

    frames = rows.select(*key, F.col(pts).cast("bigint"), F.col(data).cast("binary")).mapInArrow(run, schema)
    head = adts_header(F.col("header"))
    frames = frames.withColumn("sample_rate", head["sample_rate"]).withColumn("channels", head["channels"])
    step = aac_frame_duration(F.col("sample_rate"), timescale)
    return frames.withColumn("duration", step).withColumn("pts", F.col("pts") + F.col("frame") * step).drop("header")


def samples(files: DataFrame, default: int = 3600) -> DataFrame:
    """``SAMPLES`` of each file's streams: a video sample is a unit, with its distance
    to the next as duration; an audio sample is an ADTS frame."""
    from ..operators.ordered import durations_from_next

    rows = packets(files)
    streams = elementary(rows)
    pes = headers(units(rows, streams)).join(streams, ["file_id", "pid"])
    video = pes.filter("kind = 'video'")
    nals = nal_units(video.select(F.concat_ws(":", "file_id", "pid").alias("k"), F.col("unit").cast("int").alias("pos"), "payload"), "k", "pos", "payload")
    first = nals.withColumn("head", uint(F.col("data"), 0, 1)).groupBy("file_id", "pos").agg(F.collect_list("head").alias("heads"))
    video = video.withColumn("k", F.concat_ws(":", "file_id", "pid")).join(first.withColumnRenamed("file_id", "k").withColumnRenamed("pos", "unit"), ["k", "unit"], "left")
    key = F.exists(F.coalesce("heads", F.array().cast("array<bigint>")), lambda h: is_key_frame(F.col("codec"), h))
    video = video.select("k", "unit", "pts", "dts", key.alias("is_key"), F.col("payload").alias("data"))
    video = durations_from_next(video, "pts", ["k"], ["unit"], default)
    audio = pes.filter("kind = 'audio'").select(F.concat_ws(":", "file_id", "pid").alias("k"), "unit", "pts", F.col("payload").alias("data"))
    audio = adts_frames(audio, ["k", "unit"])
    order = Window.partitionBy("k").orderBy("unit", "frame")
    audio = audio.select("k", (F.row_number().over(order) - 1).alias("idx"), "pts", F.col("pts").alias("dts"), "duration", F.lit(True).alias("is_key"), F.col("body").alias("data"))
    video = video.select("k", (F.row_number().over(Window.partitionBy("k").orderBy("unit")) - 1).alias("idx"), "pts", "dts", F.col("duration").cast("bigint"), "is_key", "data")
    return video.unionByName(audio).withColumnRenamed("k", "track_id")


def sized_units(nals: DataFrame, by: list[str]) -> DataFrame:
    """NAL units of each group as one sample with four-byte sizes."""
    parts = nals.withColumn("data", F.concat(F.unhex(F.lpad(F.hex(F.octet_length("data")), 8, "0")), F.col("data")))
    return concatenated(parts, "data", by, ["pos", "idx"])


def parameter_sets(nals: DataFrame, codec: str = "h264") -> DataFrame:
    """The first parameter sets of each file: ``sps``, ``pps`` and for HEVC ``vps``."""
    kinds = {"sps": 7, "pps": 8} if codec == "h264" else {"vps": 32, "sps": 33, "pps": 34}
    kind = "nal_type" if codec == "h264" else "hevc_type"
    of = lambda t: F.min_by(F.when(F.col(kind) == t, F.col("data")), F.when(F.col(kind) == t, F.struct("pos", "idx")))
    return nals.groupBy("file_id").agg(*(of(t).alias(name) for name, t in kinds.items()))


def avc_config(sps: Column, pps: Column) -> Column:
    """Decoder configuration of H.264 parameter sets."""
    size = lambda x: F.unhex(F.lpad(F.hex(F.octet_length(x)), 4, "0"))
    return F.concat(F.lit(b"\x01"), take(sps, 1, 3), F.lit(b"\xff\xe1"), size(sps), sps, F.lit(b"\x01"), size(pps), pps)
