"""Text, number, time and address functions over columns."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INTEGER = r"^[+-]?[0-9]+$"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def to_double(c: Column) -> Column:
    """A decimal number, or null for any other text."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def to_long(c: Column) -> Column:
    """A whole number, or 0 for any other text or null."""
    return F.coalesce(F.when(c.rlike(_INTEGER), c.try_cast("bigint")), F.lit(0).cast("bigint"))


# --- addresses ---------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _join_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    def one(b, r):
        try:
            return urljoin(b or "", r or "")
        except ValueError:
            return r

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)])


def is_absolute(ref: Column) -> Column:
    return ref.startswith("http://") | ref.startswith("https://")


def resolve_url(base: Column, ref: Column) -> Column:
    """RFC 3986 reference resolution; absolute references pass as they are."""
    return F.when(is_absolute(ref), ref).otherwise(_join_url(base, ref))


def join_path(base: Column, ref: Column) -> Column:
    """Plain joining without dot segments: empty gives the base, a leading slash
    replaces the path, else the part after the base's last slash is replaced."""
    origin = F.regexp_extract(base, r"^(.*?://[^/]*)", 1)
    absolute = F.when(origin == "", ref).otherwise(F.concat(origin, ref))
    relative = F.when(F.locate("/", base) > 0, F.concat(F.regexp_replace(base, r"[^/]*$", ""), ref)).otherwise(ref)
    return F.when(ref == "", base).when(is_absolute(ref), ref).when(ref.startswith("/"), absolute).otherwise(relative)


def directory(path: Column) -> Column:
    """Up to and with the last slash; ``/`` if there is none."""
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, r"[^/]*$", "")).otherwise(F.lit("/"))


def base_url(url: Column) -> Column:
    """The directory of an address, without query and fragment."""
    return directory(F.regexp_replace(url, r"[?#].*$", ""))


def fragment_url(base: Column, bitrate: Column, name: Column, time: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/QualityLevels("), bitrate.cast("string"), F.lit(")/Fragments("), name, F.lit("="), time.cast("string"), F.lit(")"))


def fill_template(template: Column, number: Column, time: Column, timescale: Column) -> Column:
    """Number, time and timescale placeholders; the representation's id is empty
    and width formats stay as they are."""
    out = F.replace(template, F.lit("$RepresentationID$"), F.lit(""))
    for name, value in (("$Number$", number), ("$Time$", time), ("$Timescale$", timescale)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def byte_range(c: Column) -> Column:
    """``length@offset`` as a struct; a missing offset is 0."""
    parts = F.split(c, "@", 2)
    return F.struct(to_long(F.get(parts, F.lit(1))).alias("start"), to_long(F.get(parts, F.lit(0))).alias("length"))


# --- times -------------------------------------------------------------------


def iso_duration(c: Column) -> Column:
    """Seconds of ``PT1H2M3.5S``; parts that are no number count 0."""
    parts = F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), "^PT", ""), F.lit(r"([^HMS]*)([HMS])"), 0)
    scale = lambda x: F.when(x.endswith("H"), 3600.0).when(x.endswith("M"), 60.0).otherwise(1.0)
    value = lambda x: F.coalesce(to_double(F.substring(x, F.lit(1), F.length(x) - 1)), F.lit(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + value(x) * scale(x))


def frame_rate(c: Column) -> Column:
    """``30`` or ``30000/1001``; null if it is neither."""
    parts = F.split(c, "/", 2)
    num, den = to_double(F.get(parts, F.lit(0))), to_double(F.get(parts, F.lit(1)))
    return F.when(F.size(parts) == 1, num).when(den != 0, num / den)


def clock_us(c: Column) -> Column:
    """Microseconds of ``MM:SS.mmm`` or ``HH:MM:SS.mmm``; null for other texts."""
    parts = F.split(trimmed(c), ":")
    whole = lambda x: F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1)
    real = lambda x: F.regexp_extract(x, r"^\s*([+-]?[0-9]*\.?[0-9]+|[+-]?[0-9]+\.)", 1)
    h = F.when(F.size(parts) == 3, whole(F.get(parts, F.lit(0)))).otherwise("0")
    m = whole(F.get(parts, F.size(parts) - 2))
    s = real(F.get(parts, F.size(parts) - 1))
    total = (h.try_cast("bigint") * 3600 + m.try_cast("bigint") * 60) * 1_000_000 + F.floor(F.round(s.try_cast("double") * 1e9) / 1000).cast("bigint")
    return F.when(F.size(parts).isin(2, 3) & (h != "") & (m != "") & (s != ""), total)


def ttml_us(c: Column) -> Column:
    """Microseconds of a TTML time: frames at 30 a second, ticks of a microsecond,
    milliseconds, seconds, or a clock with hours; null for other texts."""
    number = F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double"), F.lit(0.0))
    clock = clock_us(c)
    return (
        F.when(c.isNull() | (c == ""), None)
        .when(c.endswith("f"), F.floor(F.floor(number) * 1_000_000 / 30).cast("bigint"))
        .when(c.endswith("t"), F.floor(number).cast("bigint"))
        .when(c.endswith("ms"), F.floor(number * 1000).cast("bigint"))
        .when(c.endswith("s"), F.floor(F.round(number * 1e9) / 1000).cast("bigint"))
        .when(F.size(F.split(c, ":")) == 3, clock)
    )


def clock(us: Column, comma: bool = False) -> Column:
    """``HH:MM:SS.mmm`` of microseconds, which are rounded to milliseconds."""
    ms = F.floor((us + 500) / 1000).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d" + ("," if comma else ".") + "%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    )


# --- display -----------------------------------------------------------------


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals: its exact binary value, half to even.

    format_number rounds so, but groups digits. Beyond 9e15 units of the last
    decimal it would pad the shortest decimal that reads back; there, as doubles
    are no finer, format_string gives the same.
    """
    v = value.cast("double")
    return F.when(F.abs(v) < 9e15 / 10**digits, F.translate(F.format_number(v, digits), ",", "")).when(v.isNotNull(), F.format_string(f"%.{digits}f", v))


def bandwidth_text(bps: Column) -> Column:
    """Mbps with one decimal from a million on, else rounded Kbps."""
    return F.when(bps >= 1_000_000, F.concat(fixed(bps / 1_000_000, 1), F.lit(" Mbps"))).otherwise(F.concat(fixed(bps / 1000, 0), F.lit(" Kbps")))


def bandwidth_short(bps: Column) -> Column:
    """The same with whole Kbps cut, not rounded."""
    return F.when(bps >= 1_000_000, F.concat(fixed(bps / 1_000_000, 1), F.lit(" Mbps"))).otherwise(F.concat(F.floor(bps / 1000).cast("string"), F.lit(" Kbps")))


def size_text(n: Column) -> Column:
    """Bytes, KB, MB or GB by 1024, with two decimals and no blank."""
    out = F.concat(fixed(n, 2), F.lit("B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.concat(fixed(n / 1024**power, 2), F.lit(unit))).otherwise(out)
    return out


def _hms(seconds: Column) -> tuple[Column, Column, Column]:
    s = F.floor(seconds).cast("bigint")
    return F.floor(s / 3600), F.floor(s / 60) % 60, s % 60


def eta_text(seconds: Column) -> Column:
    """``HHhMMmSSs`` or ``MMmSSs``; dashes unless above 0 and at most ten hours."""
    h, m, s = _hms(seconds)
    return F.when((seconds <= 0) | (seconds > 36000), "--m--s").when(h > 0, F.format_string("%02dh%02dm%02ds", h, m, s)).otherwise(F.format_string("%02dm%02ds", m, s))


def duration_text(seconds: Column) -> Column:
    """``1h02m03s``, ``2m03s`` or ``3s``."""
    h, m, s = _hms(seconds)
    return F.when(seconds <= 0, "0s").when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s)).when(m > 0, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))


def speed_bytes(c: Column) -> Column:
    """Bytes a second of ``2M``, ``500K``, ``1G`` or a bare number; else 0."""
    text = F.upper(trimmed(c))
    unit = F.regexp_extract(text, "[KMG]$", 0)
    scale = F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)
    return F.coalesce((to_double(F.regexp_replace(text, "[KMG]$", "")) * scale).cast("bigint"), F.lit(0).cast("bigint"))


def without_escapes(c: Column) -> Column:
    """Without terminal colour sequences."""
    return F.regexp_replace(c, "\u001b\\[[0-9;]*[A-Za-z]", "")


def visible_length(c: Column) -> Column:
    return F.length(without_escapes(c))


def shortened(c: Column, most: int) -> Column:
    """At most so many characters; the last of a cut text is an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("\u2026"))).otherwise(c)


def tidy_pipes(c: Column) -> Column:
    """Parts between bars without the empty ones, and without bars at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[ |]+|[ |]+$", ""), r"\|(  \|)+", "|")


def header(c: Column) -> Column:
    """``Name: value`` as a struct, null without a colon."""
    parts = F.split(c, ":", 2)
    return F.when(F.size(parts) == 2, F.struct(trimmed(F.get(parts, F.lit(0))).alias("name"), trimmed(F.get(parts, F.lit(1))).alias("value")))


def save_name(at: Column) -> Column:
    """A name from a point in time: the day, and seconds since 1970."""
    return F.concat(F.date_format(at, "yyyyMMdd"), F.lit("_"), F.unix_timestamp(at).cast("string"))


def segment_file(pos: Column) -> Column:
    return F.format_string("seg_%d.ts", pos.cast("bigint"))


def retry_delay_ms(attempt: Column) -> Column:
    return attempt * attempt * 500
