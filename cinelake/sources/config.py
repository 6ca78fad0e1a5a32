"""JSON configuration and resume state as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIG = (
    "thread_num int, retry_count int, max_speed bigint, save_dir string, tmp_dir string, merge string, del_after_done boolean, mux_after_done boolean, "
    "auto_subtitle_fix boolean, ffmpeg_dir string, headers map<string,string>"
)
#: What holds where a document says nothing.
DEFAULTS = {"thread_num": 8, "retry_count": 3, "max_speed": 0, "save_dir": "/downloads", "tmp_dir": "", "merge": "ts2mp4", "del_after_done": True, "mux_after_done": False, "auto_subtitle_fix": True, "ffmpeg_dir": ""}
STATE = "task_id string, url string, total int, completed map<string,string>, started_at timestamp, updated_at timestamp"


def parse(texts: DataFrame, body: str = "body") -> DataFrame:
    """Configurations over the defaults, as columns; a text that is no JSON is all
    defaults."""
    rows = texts.withColumn("_c", F.from_json(body, CONFIG))
    return rows.select(
        *[c for c in texts.columns if c != body],
        *(F.coalesce(F.col(f"_c.{k}"), F.lit(v)).alias(k) for k, v in DEFAULTS.items()),
        F.coalesce("_c.headers", F.create_map().cast("map<string,string>")).alias("headers"),
    )


def to_json(rows: DataFrame) -> Column:
    """A configuration's columns as JSON text."""
    return F.to_json(F.struct(*[c for c in (*DEFAULTS, "headers") if c in rows.columns]))


def first_found(places: DataFrame) -> DataFrame:
    """The document of the first place in order (``place``, ``body``) that has one."""
    return places.filter("body is not null").orderBy("place").limit(1)


def resume_states(texts: DataFrame, body: str = "body") -> DataFrame:
    """``task_id``, ``total`` and the map of completed positions of state documents."""
    return texts.select(F.from_json(body, STATE).alias("s")).select("s.*")


def completed(states: DataFrame) -> DataFrame:
    """``COMPLETED``: one row for each completed position."""
    return states.select("task_id", F.explode("completed").alias("k", "path")).select("task_id", F.col("k").cast("int").alias("pos"), "path")


def state_json(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """``task_id`` and ``body``: state documents of tasks (``task_id``, ``url``,
    ``total``) with their completed positions."""
    maps = done.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("pos").cast("string"), "path")))).alias("completed"))
    rows = tasks.join(maps, "task_id", "left").withColumn("completed", F.coalesce("completed", F.create_map().cast("map<string,string>")))
    return rows.select("task_id", F.to_json(F.struct("task_id", "url", "total", "completed")).alias("body"))
