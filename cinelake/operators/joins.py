"""Lookups between tables: keys, pending work, playlists, overlays, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which the side of keys is broadcast; above, the planner decides.
KEY_BROADCAST_ROWS = 100_000


def with_keys(segments: DataFrame, keys: DataFrame, small: bool = False) -> DataFrame:
    """Segments with the key of their key address; only 16-byte keys count, and the
    first of several for an address. ``small`` broadcasts the keys, after their
    number has been checked."""
    keys = keys.filter(F.length("key") == 16).groupBy("key_url").agg(F.min("key").alias("found"))
    if small and keys.limit(KEY_BROADCAST_ROWS + 1).count() <= KEY_BROADCAST_ROWS:
        keys = F.broadcast(keys)
    needs = (F.col("enc.method") != "NONE") & (F.col("enc.key_url") != "")
    rows = segments.withColumn("key_url", F.when(needs, F.col("enc.key_url"))).join(keys, "key_url", "left")
    return rows.withColumn("enc", F.when(F.col("enc").isNotNull(), F.col("enc").withField("key", F.coalesce("found", "enc.key")))).drop("key_url", "found")


def missing_keys(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct key addresses without a usable key."""
    asked = segments.filter((F.col("enc.method") != "NONE") & (F.col("enc.key_url") != "")).select(F.col("enc.key_url").alias("key_url")).distinct()
    return asked.join(keys.filter(F.length("key") == 16), "key_url", "left_anti")


def pending(tasks: DataFrame, completed: DataFrame) -> DataFrame:
    """Positions 0 to n - 1 of each task (``task_id``, ``n``) that are not completed."""
    every = tasks.filter("n > 0").select("task_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("pos"))
    return every.join(completed.select("task_id", F.col("pos").cast("bigint").alias("pos")), ["task_id", "pos"], "left_anti")


def complete_parts(parts: DataFrame, files: DataFrame) -> DataFrame:
    """Parts (``part``, ``start``, ``end``) whose file has the expected size."""
    return parts.join(files, "part").filter(F.col("size") == F.col("end") - F.col("start") + 1)


def with_playlists(streams: DataFrame, playlists: DataFrame) -> DataFrame:
    """Streams with the playlist at their address; without one they stay."""
    return streams.join(playlists, "url", "left")


def overlay(base: Column, over: Column) -> Column:
    """Two maps in one; the second's value wins."""
    kind = "map<string,string>"
    empty = F.create_map().cast(kind)
    return F.map_zip_with(F.coalesce(base.cast(kind), empty), F.coalesce(over.cast(kind), empty), lambda _, b, o: F.coalesce(o, b))


def overlay_set(base: Column, over: Column) -> Column:
    """Two texts or numbers: the second unless it is empty, 0 or null."""
    return F.when(over.isNull() | (over.cast("string").isin("", "0", "false")), base).otherwise(over)


def paired(video: DataFrame, audio: DataFrame, by: list[str]) -> DataFrame:
    """One video and one audio stream of each group, as ``video`` and ``audio``."""
    v = video.groupBy(*by).agg(F.max_by(F.struct(*[F.col(c) for c in video.columns if c not in by]), F.struct("bandwidth", -F.col("stream_idx"))).alias("video"))
    a = audio.groupBy(*by).agg(F.max_by(F.struct(*[F.col(c) for c in audio.columns if c not in by]), F.struct("bandwidth", -F.col("stream_idx"))).alias("audio"))
    return v.join(a, by, "left")
