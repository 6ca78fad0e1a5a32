"""Transfer progress over a table of transfers: totals, percent, speed, rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(transfers: DataFrame, tasks: DataFrame, now: Column, window_s: int = 2) -> DataFrame:
    """Progress of each task at ``now``.

    ``tasks``: ``task_id``, ``segments``, ``total_bytes`` (0: unknown), ``started``.
    Speed is that of the last ``window_s`` seconds: bytes since the oldest transfer
    in them, over the time from it. An unknown total is estimated from the mean
    segment; percent is of bytes, or of segments while nothing is known.
    """
    recent = F.col("at") >= now - F.expr(f"interval {window_s} seconds")
    sums = transfers.groupBy("task_id").agg(
        F.sum("bytes").alias("downloaded"), F.count("*").alias("segments_done"),
        F.sum(F.when(recent, F.col("bytes"))).alias("recent"), F.min(F.when(recent, F.col("at"))).alias("oldest"),
    )
    rows = tasks.join(sums, "task_id", "left").fillna(0, ["downloaded", "segments_done"])
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    elapsed, since = seconds(now, F.col("started")), seconds(now, F.col("oldest"))
    rows = rows.withColumn("elapsed", elapsed)
    rows = rows.withColumn("avg_speed", F.when(elapsed > 0, F.floor(F.col("downloaded") / elapsed)).otherwise(0).cast("bigint"))
    rows = rows.withColumn("speed", F.when((F.col("recent") > 0) & (since > 0), F.floor(F.col("recent") / since)).otherwise(0).cast("bigint"))
    guess = F.floor(F.col("downloaded") / F.col("segments_done") * F.col("segments")).cast("bigint")
    total = F.when(F.col("total_bytes") > 0, F.col("total_bytes")).when((F.col("segments_done") > 0) & (F.col("downloaded") > 0), guess).otherwise(0)
    rows = rows.withColumn("total", total.cast("bigint"))
    percent = F.when(F.col("total") > 0, F.least(F.col("downloaded") / F.col("total") * 100, F.lit(100.0))).when(F.col("segments") > 0, F.col("segments_done") / F.col("segments") * 100).otherwise(0.0)
    eta = F.when((F.col("total") > 0) & (F.col("speed") > 0), (F.col("total") - F.col("downloaded")) / F.col("speed")).otherwise(0.0)
    return rows.select("task_id", "downloaded", "total", "segments_done", "segments", "elapsed", "avg_speed", "speed", percent.alias("percent"), eta.alias("eta"))


def trailing(transfers: DataFrame, by: list[str], at: str, value: str, seconds: int, name: str = "recent") -> DataFrame:
    """At each row the sum of values, and the oldest time, of the last seconds."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(at)).rangeBetween(-seconds * 1_000_000, 0)
    return transfers.withColumn(name, F.sum(value).over(w)).withColumn("oldest", F.min(at).over(w))


def resume_percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(done / total * 100)


def movie_duration(samples: DataFrame, by: list[str], track: str) -> DataFrame:
    """The longest track: last time less the first plus the last duration, or the
    count times the last duration where that is negative."""
    tracks = samples.groupBy(*by, track).agg(
        F.min_by("pts", "idx").alias("first"), F.max_by(F.struct("pts", "duration"), "idx").alias("last"), F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes")
    )
    d = F.col("last.pts") - F.col("first") + F.col("last.duration")
    tracks = tracks.withColumn("d", F.when(d < 0, F.col("n") * F.col("last.duration")).otherwise(d))
    return tracks.groupBy(*by).agg(F.max("d").alias("duration"), F.sum("bytes").alias("bytes"))
