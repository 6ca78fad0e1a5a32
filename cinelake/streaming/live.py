"""Live playlists: snapshots of a playlist are a stream, each address is new once.

Every file under a folder is one snapshot (``wholetext``). Segments of snapshots
go through a stateful deduplication by stream and address, whose state is kept in
the checkpoint, so a restart neither repeats nor loses any. The state grows with
the recording; ``within`` bounds it by a watermark on arrival, which forgets
addresses older than that (and is the one deviation).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import resolve_url

SNAPSHOT_SEGMENTS = "stream_id string, base string, arrived timestamp, pos int, seg_index bigint, duration_s double, ref string, target_s double, ended boolean"


def refresh_seconds(target: Column) -> Column:
    """How long to wait before the next poll: the target duration within 1 to 30 s,
    3 s while it is unknown."""
    return F.when(target.isNull() | (target <= 0), 3.0).otherwise(F.least(F.greatest(target, F.lit(1.0)), F.lit(30.0)))


def snapshots(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 100) -> DataFrame:
    """A stream of playlist texts: ``stream_id`` (the folder), ``base``, ``arrived``."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path)
    file = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("stream_id"), file.alias("base"), F.col("_metadata.file_modification_time").alias("arrived"), F.col("value").alias("body"))


def _segments_of(body: str) -> tuple[list[tuple[int, int, float, str]], float | None, bool]:
    """(position, number, duration, address) of a snapshot's segments; its target
    duration; whether it has ended. A text that is no playlist has none."""
    lines = [x.strip() for x in body.split("\n")]
    out, number, duration, index, target, ended = [], 0, 0.0, 0, None, False
    if lines[0] != "#EXTM3U":
        return [], None, False
    for line in filter(None, lines):
        tag, _, value = line.partition(":")
        if tag == "#EXTINF":
            try:
                duration, index, number = float(value.split(",", 1)[0]), number, number + 1
            except ValueError:
                pass
        elif tag == "#EXT-X-MEDIA-SEQUENCE":
            number = int(value) if value.isdigit() else 0
        elif tag == "#EXT-X-TARGETDURATION":
            try:
                target = float(value)
            except ValueError:
                pass
        elif line == "#EXT-X-ENDLIST":
            ended = True
        elif not line.startswith("#"):
            out.append((len(out), index, duration, line))
            duration, index = 0.0, 0
    return out, target, ended


def segments(rows: DataFrame) -> DataFrame:
    """Segments of snapshots, streaming or not. Unreadable snapshots give none, and
    recording goes on with the next."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(9)]
            for stream, base, at, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found, target, ended = _segments_of(body or "")
                for pos, index, duration, ref in found:
                    for column, value in zip(out, (stream, base, at, pos, index, duration, ref, target, ended), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.float64(), pa.bool_())
            names = ["stream_id", "base", "arrived", "pos", "seg_index", "duration_s", "ref", "target_s", "ended"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    parsed = rows.select("stream_id", "base", "arrived", "body").mapInArrow(run, SNAPSHOT_SEGMENTS)
    return parsed.withColumn("url", resolve_url(F.col("base"), F.col("ref"))).drop("ref", "base")


def new_segments(rows: DataFrame, within: str | None = None) -> DataFrame:
    """Each address of a stream once, when it is first seen."""
    if within is None:
        return rows.dropDuplicates(["stream_id", "url"])
    return rows.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["stream_id", "url"])


def record(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True, every: str = "3 seconds") -> StreamingQuery:
    """Run ``sink(new segments, batch)`` for each batch; batches arrive in order and a
    batch may come again after a failure, with its number."""
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in its own folder, so a repeated batch replaces
    itself; rows carry their order in the recording."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return sink


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """What ``appended`` kept, with running totals in recording order."""
    from pyspark.sql import Window

    rows = spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").drop("batch_id")
    order = Window.partitionBy("stream_id").orderBy("batch", "arrived", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("stream_id").orderBy("batch", "arrived", "pos"))).withColumn("recorded_s", F.sum("duration_s").over(order))


def ended(rows: DataFrame) -> DataFrame:
    """Streams of which a snapshot had the end tag: recording may stop."""
    return rows.filter("ended").select("stream_id").distinct()
