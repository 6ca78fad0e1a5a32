"""Manifest texts as rows, and what format each is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` as one manifest, named and based by its path."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return rows.select(F.col("file").alias("manifest_id"), F.col("file").alias("url"), F.col("value").alias("body"))


def format_of(body: Column, url: Column) -> Column:
    """``hls``, ``dash`` or ``mss``: by content in any case, then by address."""
    text, at = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(text.contains("#extm3u"), "hls")
        .when(text.contains("<mpd") | text.contains("urn:mpeg:dash:schema:mpd"), "dash")
        .when(text.contains("<smoothstreamingmedia"), "mss")
        .when(at.contains(".m3u8"), "hls")
        .when(at.contains(".mpd"), "dash")
        .when(at.contains(".ism"), "mss")
        .otherwise("hls")
    )
