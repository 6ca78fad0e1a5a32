"""Stream selection: a predicate language compiled to a column, and the n-th best.

``compile_filter('res=1080:codecs="avc":bwmin=2000000:for=best2')`` is a conjunction
of ``key=value`` parts between colons. Patterns are unanchored and in Java's
dialect. Limits of 0 or less, or that are no number, do not apply.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bandwidth_short, fixed, tidy_pipes

#: Keys of patterns, and the column each is matched with.
PATTERNS = {
    "id": "group_id", "lang": "language", "language": "language", "name": "name", "codecs": "codecs", "res": "resolution", "resolution": "resolution",
    "frame": "frame_rate", "framerate": "frame_rate", "ch": "channels", "channels": "channels", "range": "video_range", "url": "url",
}
#: Keys of limits: column, and whether it is the least or the most allowed.
LIMITS = {"segsmin": ("segments_count", "least"), "segsmax": ("segments_count", "most"), "bwmin": ("bandwidth", "least"), "bwmax": ("bandwidth", "most")}


@dataclass(frozen=True)
class StreamFilter:
    """Parsed parts; a key given twice counts as given last."""

    patterns: dict[str, str] = field(default_factory=dict)
    limits: dict[str, int] = field(default_factory=dict)
    role: str = ""
    mode: str = "best"

    def predicate(self, columns: dict[str, str] | None = None) -> Column:
        """The conjunction; ``columns`` renames the streams' columns."""
        at = lambda name: F.col((columns or {}).get(name, name))
        out = F.lit(True)
        for name, pattern in self.patterns.items():
            value = fixed(at(name), 2) if name == "frame_rate" else at(name)
            out = out & F.coalesce(value, F.lit("")).rlike(pattern)
        for key, limit in self.limits.items():
            name, side = LIMITS[key]
            out = out & ((at(name) >= limit) if side == "least" else (at(name) <= limit))
        if self.role:
            out = out & (F.lower(at("role")) == self.role.lower())
        return out

    @property
    def place(self) -> tuple[str, int]:
        """``best``, ``worst`` or ``all``, and the n of the n-th."""
        if self.mode == "all":
            return "all", 0
        side = "worst" if self.mode.startswith("worst") else "best"
        number = self.mode.removeprefix("best").removeprefix("worst").strip()
        n = int(number) if re.fullmatch(r"[+-]?\d+", number) else 1
        return side, max(n, 1)


def compile_filter(text: str) -> StreamFilter:
    patterns, limits, role, mode = {}, {}, "", "best"
    for part in filter(None, map(str.strip, text.split(":"))):
        key, equals, value = (x.strip() for x in part.partition("="))
        if not equals:
            raise ValueError(f"not a key=value part: {part!r}")
        if len(value) >= 2 and value[0] == value[-1] == '"':
            value = value[1:-1]
        key = key.lower()
        if key in PATTERNS:
            patterns[PATTERNS[key]] = value
        elif key in LIMITS:
            limits.pop(key, None)
            if re.fullmatch(r"[+-]?\d+", value) and int(value) > 0:
                limits[key] = int(value)
        elif key == "role":
            role = value
        elif key == "for":
            mode = value.lower()
        else:
            raise ValueError(f"unknown key: {key!r}")
    return StreamFilter(patterns, limits, role, mode)


def matching(streams: DataFrame, text: str, columns: dict[str, str] | None = None) -> DataFrame:
    """The streams that a filter matches."""
    return streams.filter(compile_filter(text).predicate(columns))


def selected(streams: DataFrame, text: str, by: list[str], idx: str = "stream_idx", columns: dict[str, str] | None = None) -> DataFrame:
    """The chosen stream of each group ``by``; all matches, ranked, for ``all``.

    Streams rank by bandwidth, best first, then by ``idx``. An n at or beyond the
    number of matches means the first for ``best`` and the last for ``worst``.
    """
    parsed = compile_filter(text)
    bandwidth = (columns or {}).get("bandwidth", "bandwidth")
    rows = streams.filter(parsed.predicate(columns))
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("rank", F.row_number().over(whole.orderBy(F.desc(bandwidth), idx)))
    side, n = parsed.place
    if side == "all":
        return rows
    rows = rows.withColumn("matches", F.count("*").over(whole))
    if side == "best":
        wanted = F.when(F.col("matches") <= n, 1).otherwise(n)
    else:
        wanted = F.when(F.col("matches") <= n, F.col("matches")).otherwise(F.col("matches") - n + 1)
    return rows.filter(F.col("rank") == wanted).drop("rank", "matches")


def auto_selected(streams: DataFrame, by: list[str], idx: str = "stream_idx", bandwidth: str = "bandwidth", is_video: Column | None = None) -> DataFrame:
    """The first stream, unless a video has a strictly higher bandwidth."""
    is_video = F.col("media_type") == "video" if is_video is None else is_video
    whole = Window.partitionBy(*by)
    first = F.min(idx).over(whole)
    rows = streams.withColumn("first", F.col(idx) == first).filter(F.col("first") | is_video)
    order = whole.orderBy(F.desc(bandwidth), idx)
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("first", "rank")


def split_by_type(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Video and audio; whatever is not audio counts as video."""
    audio = F.col("media_type") == "audio"
    return streams.filter(~audio), streams.filter(audio)


def listed(streams: DataFrame) -> DataFrame:
    """Streams in listing order: video, audio, subtitles; with the place of each,
    the default choice (the first), and the first audio of each language."""
    kind = F.when(F.col("media_type") == "audio", 1).when(F.col("media_type") == "subtitles", 2).otherwise(0)
    rows = streams.withColumn("bucket", kind)
    order = Window.partitionBy("manifest_id").orderBy("bucket", "stream_idx")
    language = Window.partitionBy("manifest_id", "bucket", "language").orderBy("stream_idx")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .withColumn("is_default", F.col("place") == 1)
        .withColumn("first_of_language", (F.col("bucket") == 1) & (F.row_number().over(language) == 1))
    )


def display(streams: DataFrame) -> DataFrame:
    """``full`` and ``short`` descriptions of streams."""
    bar = lambda *parts: F.concat_ws(" | ", *parts)
    bw, rate = bandwidth_short(F.col("bandwidth")), fixed(F.col("frame_rate"), 0)
    audio, subtitles = F.col("media_type") == "audio", F.col("media_type") == "subtitles"
    kind = F.when(audio, "Aud").when(subtitles, "Sub").otherwise("Vid")
    detail = F.when(audio, bar("group_id", bw, "name", "codecs", "language", "channels")).when(subtitles, bar("group_id", "language", "name", "codecs", "role"))
    detail = detail.otherwise(bar("resolution", bw, "group_id", rate, "codecs", "video_range"))
    count = F.col("segments_count")
    detail = F.when(count > 0, F.concat(detail, F.format_string(" | %d %s", count, F.when(count == 1, "Segment").otherwise("Segments")))).otherwise(detail)
    short = F.when(audio, bar(bw, "name", "language", "role")).when(subtitles, bar("language", "name", "role")).otherwise(bar("resolution", bw, rate, "codecs", "video_range"))
    return streams.withColumn("full", F.concat(kind, F.lit(" "), tidy_pipes(detail))).withColumn("short", F.concat(kind, F.lit(" "), short))
