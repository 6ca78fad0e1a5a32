"""Connected groups at scale: components of an edge table, and bounded units of
work for comparing the members of groups.

Nothing here gathers a group. ``components`` runs alternating large-star and
small-star rounds (joins and aggregates); ``units`` cuts a large group into
blocks and pairs of blocks, so that every pair of members meets in one unit of
bounded size, in some task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import lean, partitions, staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node) of each component of ``a``, ``b``.

    Nodes may be of any ordered type. Each round is two stars: a node's larger
    neighbours are linked to its least neighbour, then its smaller ones. A hot
    node is one row on the side of the least neighbours, so its edges can be
    split over tasks. Rounds end when no edge changes; a component of n nodes
    takes a number of rounds in the order of log n.
    """
    e = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        seen = Observation()
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        e = staged(small.filter("a != b").distinct().observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("h")), "edges")
        now = seen.get
        if now == state or not now["n"]:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def units(members: DataFrame, group: str, node: str, size: str, budget: int) -> DataFrame:
    """``members`` with ``unit`` and ``side``, repeated for each unit they are in.

    A group whose sizes sum to more than ``budget`` is dealt by hash into blocks
    of about that size; a unit is a block, or a pair of blocks. ``blocks`` is the
    number of blocks of the group. Only large groups are joined with their number,
    from a table of their own, so that the join may be split or broadcast by size.
    """
    large = staged(members.groupBy(group).agg(F.ceil(F.sum(size) / budget).cast("int").alias("blocks")).filter("blocks > 1"), "large")
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    return (
        members.join(large, group, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("unit", F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")))
        .withColumn("side", F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2))
        .drop("block", "other")
    )


def each_unit(rows: DataFrame, compare: Callable, schema: str, together: int = 0) -> DataFrame:
    """``compare`` on the columns of every unit; units are streamed, many a task.
    With ``together``, it gets a list of units, with so many rows or characters
    (of ``norm``) at most besides one unit."""
    names = rows.columns
    at = names.index("unit")
    target = _arrow(rows.sparkSession, schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        wait: list[dict[str, list]] = []
        out: list[dict[str, list]] = []
        load = 0

        def flush():
            merged = {k: [x for o in out for x in o[k]] for k in out[0]}
            out.clear()
            return _batch(merged, target)

        def finish():
            nonlocal load
            if together:
                wait.append(held)
                load += sum(map(len, held["norm"])) + len(held["norm"])
                if load >= together:
                    out.append(compare(wait))
                    wait.clear()
                    load = 0
            else:
                out.append(compare(held))

        for batch in batches:
            unit = batch.column(at).to_numpy()
            cut = np.flatnonzero(np.diff(unit)) + 1
            columns = {n: c.to_pylist() for n, c in zip(names, batch.columns, strict=True)}
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(unit)], strict=True):
                part = {n: c[lo:hi] for n, c in columns.items()}
                if held and held["unit"][0] == part["unit"][0]:
                    for n, c in part.items():
                        held[n] += c
                    continue
                if held:
                    finish()
                held = part
            if out and (together or len(out) > 500):
                yield flush()
        if held:
            finish()
        if wait:
            out.append(compare(wait))
        if out:
            yield flush()

    dealt = rows.repartition(partitions(rows.sparkSession), "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(lean(run), schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def merge_labels(links: DataFrame, node: str, root: str, blocks: str) -> DataFrame:
    """Final ``node`` and ``root`` from units' own roots: groups of one block are
    done; those of several blocks are joined up through ``components``."""
    one = links.filter(F.col(blocks) == 1).select(F.col(node).alias("node"), F.col(root).alias("root"))
    more = links.filter((F.col(blocks) > 1) & (F.col(node) != F.col(root))).select(F.col(node).alias("a"), F.col(root).alias("b"))
    return one.unionByName(components(more))


class Forest:
    """Labels of a unit's members, merged as links are found."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        found = np.unique(np.append(self.label[others], self.label[i]))
        self.label[np.isin(self.label, found)] = found[0]
