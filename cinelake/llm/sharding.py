"""Contiguous shards of near-equal bytes: the smallest feasible capacity.

Documents with equal texts form an atomic group; groups are ordered by the hash
of their text. The smallest capacity with which the ordered group sizes fit into
the given number of shards is found by binary search, each capacity checked
greedily, and the order is cut there. Where one large group sets the capacity,
there is slack, and the cuts are moved to even out the other shards, never above
the capacity.

The search needs prefix sums over all groups, of which there may be billions, so
it works on ranges of hashes. It starts with a fixed number of ranges. A range of
several groups counts as divisible, which gives a lower bound for the capacity;
the few ranges in which the greedy check of that bound would cut are split
further by one aggregate each round, until every cut falls between two groups.
The bound is then feasible, hence smallest. The driver holds a bounded number of
range sums, never groups. A row's shard follows from comparing its hash with the
cuts: no join, and no group is ever gathered in a task.

Everything is built from DataFrame functions. Defined results: a null text is as
an empty one (16 bytes, checksum 0) and in its group; repeated rows each get a
slot; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

ROW_OVERHEAD = 16
FIRST_BITS, MORE_BITS = 14, 8
#: Rows of a shard are numbered in this many lanes side by side.
LANES = 256


def text_hash(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def text_size(text_col: str = "text") -> Column:
    return F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long") + ROW_OVERHEAD


@dataclass(order=True)
class Range:
    """Groups whose hashes share their first ``bits`` bits."""

    first: int  # smallest hash in it
    bits: int
    groups: int
    size: int


class Ranges:
    """Ordered ranges with prefix sums, and the greedy checks on them."""

    def __init__(self, ranges: list[Range], largest: int, shards: int):
        self.ranges, self.largest, self.shards = sorted(ranges), largest, shards
        self.upto = [0]
        for r in self.ranges:
            self.upto.append(self.upto[-1] + r.size)
        self.total = self.upto[-1]

    def walk(self, capacity: int) -> list[int] | None:
        """Greedy cuts if ranges of several groups were divisible; None if the
        shards don't suffice."""
        at, cuts = 0, []
        while at + capacity < self.total:
            if len(cuts) == self.shards - 1:
                return None
            to = at + capacity
            i = bisect_right(self.upto, to) - 1
            at = to if self.ranges[i].groups > 1 else self.upto[i]
            cuts.append(at)
        return cuts

    def least(self) -> int:
        """The smallest capacity with which ``walk`` succeeds."""
        lo, hi = max(self.largest, -(-self.total // self.shards)), max(self.total, self.largest)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.walk(mid) is not None else (mid + 1, hi)
        return lo

    def undecided(self, cuts: list[int]) -> list[Range]:
        """Ranges inside which a cut falls."""
        inside = {bisect_right(self.upto, c) - 1 for c in cuts if self.upto[bisect_left(self.upto, c)] != c}
        return [self.ranges[i] for i in sorted(inside)]

    def even_cuts(self, capacity: int) -> list[int]:
        """Indexes of ranges that start shards 1, 2, ...: no shard above the
        capacity or empty before the ranges end, each as near to an equal share
        of the rest as that allows."""
        ends = [len(self.ranges)]  # from the right: where the last k shards may start at the earliest
        for _ in range(self.shards - 1):
            ends.append(bisect_left(self.upto, self.upto[ends[-1]] - capacity))
        at, out = 0, []
        for k in range(self.shards - 1, 0, -1):
            want = self.upto[at] + (self.total - self.upto[at]) / (k + 1)
            i = bisect_left(self.upto, want)
            if i > at and (i >= len(self.upto) or want - self.upto[i - 1] <= self.upto[i] - want):
                i -= 1
            most = bisect_right(self.upto, self.upto[at] + capacity) - 1
            at = max(min(at + 1, len(self.ranges)), min(max(i, ends[k]), most))
            out.append(at)
        return out


def _sums(groups: DataFrame, bits: int, within: list[int] | None = None) -> list[Range]:
    """Range sums at a number of bits, within ranges of fewer bits if given."""
    if within is not None:
        groups = groups.filter(F.shiftright("h", 64 - (bits - MORE_BITS)).isin(within))
    rows = groups.groupBy(F.shiftright("h", 64 - bits).alias("r")).agg(F.min("h").alias("first"), F.count("*").alias("n"), F.sum("size").alias("s")).collect()
    return [Range(r.first, bits, r.n, r.s) for r in rows]


def plan(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the hashes at which shards 1, 2, ... start.

    ``groups`` has one row for each group: ``h`` and ``size``.
    """
    largest = groups.agg(F.max("size")).first()[0] or 0
    at = Ranges(_sums(groups, FIRST_BITS), largest, shards)
    while True:
        capacity = at.least()
        split = at.undecided(at.walk(capacity))
        if not split:
            break
        rest = [r for r in at.ranges if r not in split]
        for bits in sorted({r.bits for r in split}):
            to = min(bits + MORE_BITS, 64)
            rest += _sums(groups, to, [r.first >> (64 - to + MORE_BITS) for r in split if r.bits == bits])
        at = Ranges(rest, largest, shards)
    return capacity, [at.ranges[i].first for i in at.even_cuts(capacity) if i < len(at.ranges)]


def shard_of(h: Column, cuts: list[int]) -> Column:
    """The shard of a hash: how many cuts are not above it."""
    out = F.lit(0)
    for c in cuts:
        out = out + (h >= F.lit(c)).cast("int")
    return out


def add_shard(docs: DataFrame, shards: int, text_col: str = "text") -> DataFrame:
    """``docs`` with its ``shard``, for writing with ``partitionBy("shard")``."""
    groups = staged(docs.groupBy(text_hash(text_col).alias("h")).agg(F.sum(text_size(text_col)).alias("size")), "groups")
    return docs.withColumn("shard", shard_of(text_hash(text_col), plan(groups, shards)[1]))


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row of ``docs``, with size and checksum.

    Slots are gapless from 0 in each shard: rows are numbered within lanes of a
    shard, and each lane starts after the rows of the lanes before it.
    """
    slim = staged(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            text_size(text_col).alias("size"),
            F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("text_crc32"),
            text_hash(text_col).alias("h"),
            F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).cast("int").alias("lane"),
        ),
        "sizes",
    )
    groups = staged(slim.groupBy("h").agg(F.sum("size").alias("size")), "groups")
    rows = slim.withColumn("shard", shard_of(F.col("h"), plan(groups, shards)[1])).drop("h")
    lanes = rows.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    lanes = lanes.select("shard", "lane", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "size", "text_crc32")) - 1
    return (
        rows.withColumn("within", within)
        .join(F.broadcast(lanes), ["shard", "lane"])  # at most shards * LANES rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
