"""Byte ranges of files: by whole-file reads, or by a data source that reads only
the ranges, one partition each."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.bits import take


def segment_bytes(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments with the ``data`` of their ranges in ``files`` (``url``, ``content``);
    without a range the whole file. Ranges beyond the end are cut."""
    rows = segments.join(files.select("url", "content"), "url", "left")
    part = take(F.col("content"), F.coalesce("range_start", F.lit(0)), F.coalesce("range_len", F.octet_length("content")))
    return rows.withColumn("data", part).drop("content")


class Range(InputPartition):
    def __init__(self, part: int, start: int, end: int):
        self.part, self.start, self.end = part, start, end


class ByteRanges(DataSource):
    """``spark.read.format("byte_ranges").option("path", p).option("size", n)
    .option("parts", k)``: one row and one partition for each of k ranges.

    Files are opened with pyarrow's file systems, so the path may be any address
    those know. ``retries`` failed reads of a range are tried again after 0.5, 2,
    4.5 ... seconds before the task fails.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "part int, start bigint, end bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(dict(self.options))


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size, self.parts, self.retries = int(options["size"]), max(int(options.get("parts", 4)), 1), int(options.get("retries", 3))

    def partitions(self) -> list[Range]:
        each = self.size // self.parts
        if each == 0:
            return [Range(0, 0, self.size - 1)] if self.size else []
        return [Range(i, i * each, self.size - 1 if i == self.parts - 1 else (i + 1) * each - 1) for i in range(self.parts)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for attempt in range(1, self.retries + 2):
            try:
                system, path = fs.FileSystem.from_uri(self.path)
                with system.open_input_file(path) as f:
                    f.seek(part.start)
                    data = f.read(part.end - part.start + 1)
                break
            except OSError:
                if attempt > self.retries:
                    raise
                time.sleep(attempt * attempt * 0.5)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.part], pa.int32()), pa.array([part.start]), pa.array([part.end]), pa.array([data], pa.binary())], names=["part", "start", "end", "data"]
        )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteRanges)
