"""Subtitles: WebVTT and TTML to cues, cues to SRT.

``texts`` has ``doc_id`` and ``body``. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock, clock_us, trimmed, ttml_us
from ..schemas import CUES, TTML

_RAW = "doc_id string, pos int, id string, start string, end string, settings string, text string"


def _blocks(body: str, spec: bool = False) -> Iterator[tuple[str, str, str, str, str]]:
    """Cues of one WebVTT text in order: id, start, end, settings, text.

    A timing line opens a cue that runs to the next blank line; the line before it,
    if it is not itself part of a cue, is the id. A timing line that cannot be
    read is passed over as any other line.
    """
    lines = [x.strip() for x in body.split("\n")]
    at = next((i + 1 for i, x in enumerate(lines) if x.startswith("WEBVTT")), len(lines))
    while at < len(lines):
        name, timing = "", at
        if "-->" not in lines[at]:
            if not lines[at] or at + 1 == len(lines) or "-->" not in lines[at + 1]:
                at += 1
                continue
            name, timing = lines[at], at + 1
        start, _, right = lines[timing].partition("-->")
        right = right.strip()
        until = right.split(" ", 1)[0] if spec else right
        if _clock_like(start) and _clock_like(until):
            end = timing + 1
            while end < len(lines) and lines[end]:
                end += 1
            blank = right.find(" ")
            yield name, start.strip(), until, right[blank:].strip() if blank > 0 else "", "\n".join(lines[timing + 1 : end])
            at = end + 1
        else:
            at += 1


def _clock_like(text: str) -> bool:
    """Two or three parts between colons, numbers at their starts. Settings with a
    colon make a fourth part, and such cues are left out."""
    import re

    parts = text.strip().split(":")
    return len(parts) in (2, 3) and all(re.match(r"\s*[+-]?\d+", p) for p in parts[:-1]) and bool(re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)", parts[-1]))


def vtt_cues(texts: DataFrame, spec: bool = False) -> DataFrame:
    """``CUES`` of WebVTT texts; a text without header has none (see ``vtt_errors``).

    The end time is read from all that follows the arrow, so a cue whose settings
    have a colon is left out; with ``spec`` settings are cut off first and it stays.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for pos, cue in enumerate(_blocks(body or "", spec)):
                    for column, value in zip(out, (doc, pos, cue[0], cue[1], cue[2], cue[3], cue[4]), strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.int32()] + [pa.string()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "pos", "id", "start", "end", "settings", "text"])

    rows = texts.select(F.col("doc_id").cast("string"), "body").mapInArrow(run, _RAW)
    return rows.select("doc_id", "pos", "id", clock_us(F.col("start")).alias("start_us"), clock_us(F.col("end")).alias("end_us"), "text", "settings")


def vtt_errors(texts: DataFrame) -> DataFrame:
    has = F.exists(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: trimmed(x).startswith("WEBVTT"))
    return texts.filter(~has).select(F.col("doc_id").cast("string"), F.lit("missing WEBVTT header").alias("error"))


def ttml_cues(texts: DataFrame) -> DataFrame:
    """``CUES`` of TTML texts: a paragraph's own text, or its spans on a line each;
    paragraphs without text or with times that cannot be read are left out."""
    body = F.regexp_replace(F.col("body"), r"(?s)^.*?(<(?:\w+:)?tt[\s>])", "$1")
    rows = texts.select(F.col("doc_id").cast("string"), F.from_xml(body, TTML).alias("t"))
    rows = rows.select("doc_id", F.posexplode("t.body.div").alias("i", "d")).select("doc_id", "i", F.posexplode("d.p").alias("j", "p"))
    own = trimmed(F.coalesce("p._VALUE", F.lit("")))
    spans = F.array_join(F.transform("p.span", lambda s: trimmed(F.coalesce(s["_VALUE"], F.lit("")))), "\n")
    rows = rows.select("doc_id", "i", "j", ttml_us(F.col("p._begin")).alias("start_us"), ttml_us(F.col("p._end")).alias("end_us"), F.when(own != "", own).otherwise(F.coalesce(spans, F.lit(""))).alias("text"))
    order = Window.partitionBy("doc_id").orderBy("i", "j")
    rows = rows.filter("start_us is not null and end_us is not null and text != ''")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), F.lit("").alias("id"), "start_us", "end_us", "text", F.lit("").alias("settings"))


def shifted(cues: DataFrame, by_us: int) -> DataFrame:
    """Cues moved in time."""
    return cues.withColumn("start_us", F.col("start_us") + by_us).withColumn("end_us", F.col("end_us") + by_us)


def to_srt(cues: DataFrame, comma: bool = False) -> DataFrame:
    """``doc_id`` and ``body``: numbered cues; ``comma`` before milliseconds as the
    format has it, or a point as players also take it."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    line = F.concat(
        F.row_number().over(order).cast("string"), F.lit("\n"), clock(F.col("start_us"), comma), F.lit(" --> "), clock(F.col("end_us"), comma), F.lit("\n"), F.col("text"), F.lit("\n\n")
    )
    parts = cues.select("doc_id", F.struct("pos", line.alias("line")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return parts.select("doc_id", F.array_join(F.transform("x", lambda x: x["line"]), "").alias("body"))


__all__ = ["CUES", "shifted", "to_srt", "ttml_cues", "vtt_cues", "vtt_errors"]
