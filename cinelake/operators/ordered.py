"""Operators over ordered rows: carried state, runs, clocks, layouts, ranges.

All take ``by``, the columns that keep sequences apart, and ``order``, those that
order the rows of one. Each costs one shuffle by ``by``; where ``by`` has been
dealt out already, none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(by: list[str], order: list[str]):
    w = Window.partitionBy(*by).orderBy(*order)
    return w, w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, value: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """The last non-null value up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(_over(by, order)[1]))


def numbered_from(rows: DataFrame, base: Column, counts: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """Sequence numbers: the last base set so far plus the counted rows since; the
    base may be set again anywhere, and is 0 at first."""
    _, so_far, _ = _over(by, order)
    n = F.count(F.when(counts, 1)).over(so_far)
    rows = rows.withColumn("_n", n)
    last = F.last(F.when(base.isNotNull(), F.struct(base.alias("b"), F.col("_n").alias("n"))), True).over(so_far)
    rows = rows.withColumn("_b", last)
    return rows.withColumn(name, F.coalesce(F.col("_b.b"), F.lit(0)) + F.col("_n") - F.coalesce(F.col("_b.n"), F.lit(0)) - 1).drop("_n", "_b")


def attached(rows: DataFrame, ends: Column, by: list[str], order: list[str], name: str = "grp") -> DataFrame:
    """Groups of rows that end with a marked row: how many marked rows came before."""
    return rows.withColumn(name, F.coalesce(F.sum(ends.cast("int")).over(_over(by, order)[2]), F.lit(0)))


def clocked(rows: DataFrame, duration: Column, by: list[str], order: list[str], reset: Column | None = None, name: str = "start") -> DataFrame:
    """Running start times; a reset time above 0 sets the clock."""
    _, so_far, before = _over(by, order)
    if reset is None:
        return rows.withColumn(name, F.coalesce(F.sum(duration).over(before), F.lit(0)))
    set_ = F.coalesce(reset, F.lit(0)) > 0
    rows = rows.withColumn("_g", F.sum(set_.cast("int")).over(so_far))
    _, within, earlier = _over([*by, "_g"], order)
    base = F.coalesce(F.max(F.when(set_, reset)).over(within), F.lit(0))
    return rows.withColumn(name, base + F.coalesce(F.sum(duration).over(earlier), F.lit(0))).drop("_g")


def expanded(rows: DataFrame, repeats: Column, name: str = "rep") -> DataFrame:
    """Run-length expansion: r repeats make r + 1 rows, a negative r one."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(repeats.cast("bigint"), F.lit(0).cast("bigint")))))


def runs(rows: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Run-length encoding: one row for each run of equal values, with its place,
    length and first row's order columns."""
    w, so_far, _ = _over(by, order)
    rows = rows.withColumn("_new", (~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)).cast("int"))
    rows = rows.withColumn("run", F.sum("_new").over(so_far))
    return rows.groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), *(F.min(c).alias(f"first_{c}") for c in order))


def durations_from_next(rows: DataFrame, pts: str, by: list[str], order: list[str], default: int, name: str = "duration") -> DataFrame:
    """The distance to the next time where it is positive, else a default; the last
    row takes that of the row before."""
    w, _, _ = _over(by, order)
    step = F.lead(pts).over(w) - F.col(pts)
    rows = rows.withColumn(name, F.when(step > 0, step).when(step.isNotNull(), default))
    return rows.withColumn(name, F.coalesce(F.col(name), F.lag(name).over(w), F.lit(default)))


def interleaved(a: DataFrame, b: DataFrame, pts: str, by: list[str], order: list[str], size: str, start: int = 0) -> DataFrame:
    """Two ordered inputs merged by time, ``a`` first on ties, each in its own order;
    with ``place`` and the byte ``offset`` of each row.

    A row waits for all rows before it in its own input, so its time is the running
    maximum there: a plain sort by time would be wrong where times go back.
    """
    _, so_far, _ = _over([*by, "is_b"], order)
    rows = a.withColumn("is_b", F.lit(False)).unionByName(b.withColumn("is_b", F.lit(True)))
    rows = rows.withColumn("_t", F.max(pts).over(so_far))
    w, _, before = _over(by, ["_t", "is_b", *order])
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("offset", F.lit(start) + F.coalesce(F.sum(size).over(before), F.lit(0)))
    return rows.drop("_t")


def alternated(a: DataFrame, b: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Two ordered inputs in turn, ``a`` first, then the rest of the longer one."""
    rows = a.withColumn("is_b", F.lit(False)).unionByName(b.withColumn("is_b", F.lit(True)))
    own, _, _ = _over([*by, "is_b"], order)
    rows = rows.withColumn("turn", F.row_number().over(own))
    w, _, _ = _over(by, ["turn", "is_b"])
    return rows.withColumn("sequence", F.row_number().over(w)).drop("turn")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w, _, _ = _over(keys, order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def marked_indexes(rows: DataFrame, mark: Column, by: list[str], order: list[str], name: str = "index") -> DataFrame:
    """1-based indexes of marked rows; of all rows where none of a sequence is."""
    w, _, _ = _over(by, order)
    whole = Window.partitionBy(*by)
    rows = rows.withColumn(name, F.row_number().over(w)).withColumn("_any", F.max(mark).over(whole))
    return rows.filter(mark | ~F.col("_any")).drop("_any")


def chunk_of(entries: DataFrame, chunks: DataFrame, by: list[str], first: str, chunk: str, pos: str | None = None) -> DataFrame:
    """Range lookup: each chunk (1-based ``chunk``) with the entry whose first chunk
    is the last at or before it; of equal firsts the last by ``pos`` wins (the
    greatest entry without one).

    Entries are a short run table; chunks take theirs by the running last of both
    in one order, which needs no range join.
    """
    entry = F.struct(*[c for c in entries.columns if c not in (*by, first)])
    e = entries.groupBy(*by, first).agg(F.max_by(entry, F.col(pos) if pos else entry).alias("entry"))
    rows = e.select(*by, F.col(first).alias(chunk), "entry", F.lit(0).alias("_side")).unionByName(
        chunks.select(*by, chunk, F.lit(None).cast(e.schema["entry"].dataType).alias("entry"), F.lit(1).alias("_side"), *[F.col(c) for c in chunks.columns if c not in (*by, chunk)]),
        allowMissingColumns=True,
    )
    _, so_far, _ = _over(by, [chunk, "_side"])
    return rows.withColumn("entry", F.last("entry", True).over(so_far)).filter("_side = 1 and entry is not null").drop("_side")


def split_ranges(rows: DataFrame, size: Column, parts: int) -> DataFrame:
    """Byte ranges of equal size, the last with the remainder; one range where there
    are fewer bytes than parts."""
    n = F.lit(max(parts, 1)).cast("bigint")
    each = F.floor(size / n).cast("bigint")
    count = F.when(each == 0, F.lit(1).cast("bigint")).otherwise(n)
    each = F.when(each == 0, size.cast("bigint")).otherwise(each)
    ranges = F.transform(
        F.sequence(F.lit(0).cast("bigint"), count - 1),
        lambda i: F.struct(i.alias("part"), (i * each).alias("start"), F.when(i == count - 1, size.cast("bigint") - 1).otherwise((i + 1) * each - 1).alias("end")),
    )
    return rows.withColumn("range", F.explode(ranges)).select(*rows.columns, "range.*")


def concatenated(rows: DataFrame, data: str, by: list[str], order: list[str], init: str | None = None) -> DataFrame:
    """Bytes of each sequence joined in order, after its ``init`` bytes if given."""
    parts = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(data).alias("_d")))).alias("p"), *([F.first(init, True).alias("_i")] if init else []))
    start = F.coalesce(F.col("_i"), F.lit(b"")) if init else F.lit(b"")
    return parts.select(*by, F.aggregate("p", start.cast("binary"), lambda acc, x: F.concat(acc, F.coalesce(x["_d"], F.lit(b"")))).alias("data"))


def joined_text(rows: DataFrame, text: str, by: list[str], order: list[str], separator: str = "\n") -> DataFrame:
    """Texts of each sequence joined in order."""
    parts = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))).alias("p"))
    return parts.select(*by, F.array_join(F.transform("p", lambda x: x["_t"]), separator).alias(text))
