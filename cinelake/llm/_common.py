"""Helpers shared by the training-data operators: staging, byte views, columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are cut into pieces of about this many bytes inside a Python worker,
#: always between documents, so that temporary arrays stay small.
CHUNK_BYTES = 1 << 20
#: Large caches that a worker keeps from task to task; those of other operators go
#: when a worker comes to ``lean`` work.
HEAVY: list[Callable] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (local tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir()
        if named is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="cinelake-"))
            named = sc.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    A lost executor then costs a reread of files, not a recomputation. The
    tables stay until ``release`` is called, since results are read lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cinelake-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``staged`` wrote in this application."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cinelake-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let_go(caches: bool) -> None:
    """Give memory that is not in use back to the system: what allocators keep, and
    what is in the caches of ``HEAVY``."""
    if caches:
        for cached in HEAVY:
            cached.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable, caches: bool = True) -> Callable:
    """``run`` (of ``mapInArrow``) for workers that are used again by other stages:
    it starts without their caches, unless it needs them itself, and leaves no
    freed memory behind."""

    def alone(batches):
        if caches:
            let_go(True)
        try:
            yield from run(batches)
        finally:
            let_go(False)

    return alone


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of rows with about ``most`` bytes each; a longer row is alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set bytes of ``mask`` in each row."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(id_col: str = "doc_id", text_col: str = "text"):
    """A key that equal rows share and that is never null."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{text_col}`").isNull())


def marks(df: DataFrame, key: str, bits: int = 23) -> np.ndarray:
    """A bitmap of 2**bits bits over a long column's values: a fixed size of 1 MB.

    Built by Spark's bitmap aggregates; at most 2**bits / 32768 rows reach the
    driver whatever the input. It may say yes for a value that is not there,
    never no for one that is; so it only spares a later exact join some rows.
    """
    place = F.pmod(F.col(key), F.lit(1 << bits))
    rows = (
        df.select(place.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
        .collect()
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in rows:
        # bucket b holds values (b-1)*32768+1 .. b*32768, and bucket 0 the value 0
        part = np.frombuffer(bytes(row.m), np.uint8)
        whole = np.unpackbits(part, bitorder="little")
        at = np.flatnonzero(whole) + (row.b - 1) * 32768 + 1 if row.b > 0 else np.zeros(1, np.int64)
        at = at[(at >= 0) & (at < 1 << bits)]
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the long keys may be in the bitmap."""
    at = keys.astype(np.int64) % np.int64(len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def may_hold(bitmap):
    """A vectorised test of a long column against a broadcast ``marks`` bitmap."""

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(marked(bitmap.value, keys.to_numpy()))

    return test
