"""Names of states and modes, and the file names that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In the order of their numbers.
TASK_STATES = ("pending", "parsing", "downloading", "decrypting", "merging", "muxing", "done", "failed", "cancelled")
MERGE_MODES = ("binary", "ts2mp4", "fmp4", "ffmpeg", "no")


def name_of(number: Column, names: tuple[str, ...]) -> Column:
    """The name at a number; ``unknown`` beyond."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), number.cast("int")), F.lit("unknown"))


def number_of(name: Column, names: tuple[str, ...], default: int) -> Column:
    """The number of a name, or a default."""
    at = F.array_position(F.array(*map(F.lit, names)), name) - 1
    return F.when(at >= 0, at).otherwise(default).cast("int")


def merge_mode(name: Column) -> Column:
    """The mode of a name; ts2mp4 for any other."""
    return F.when(name.isin(*MERGE_MODES), name).otherwise("ts2mp4")


def output_path(folder: Column, name: Column, mode: Column, scratch: Column) -> Column:
    """Where a result goes: by mode a .ts or .mp4 file, or the scratch folder."""
    at = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    base = F.concat(F.regexp_replace(at(folder, F.lit(".")), "/+$", ""), F.lit("/"), at(name, F.lit("output")))
    base = F.regexp_replace(base, r"^\./", "")
    mp4 = F.concat(base, F.lit(".mp4"))
    return F.when(mode == "no", at(scratch, F.concat(base, F.lit("_tmp")))).when(mode.isin("ts2mp4", "fmp4", "ffmpeg"), mp4).otherwise(F.concat(base, F.lit(".ts")))
