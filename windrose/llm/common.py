"""Shared helpers: stored intermediates, Arrow column builders, 64-bit mixing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.session import scratch_path

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def salt(k: int) -> np.uint64:
    """A fixed 64-bit value for each k."""
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Written once to the shared checkpoint folder and read back: later reads survive lost executors and carry no lineage.

    The shuffle files of the writing job go as soon as it is done.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


BLOOM_BITS = 24


def _slots(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.uint64((1 << bits) - 1)
    return (x & keep).astype(np.int64), ((x >> np.uint64(32)) & keep).astype(np.int64)


def bloom_filter(df: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of 2**bits bits (at any size of ``df``; 2 MB by default) of a column of well mixed longs, two bits a value."""
    low = (1 << bits) - 1
    slot = F.explode(F.array(F.col(column).bitwiseAND(F.lit(low)), F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(low))))
    cells = df.select(slot.alias("b")).groupBy(F.shiftright("b", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toPandas()       # at most 2**(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def may_contain(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of the uint64 values ``x`` that the filter may hold."""
    one, two = _slots(x, len(bits).bit_length() + 2)
    hit = np.flatnonzero((bits[one >> 3] >> (one & 7).astype(np.uint8)) & 1)
    two = two[hit]
    return hit[((bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each row."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with at most ``block`` bytes of text (one longer row stands alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(text).fill_null("").cast(pa.large_string())
        off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block, "right")) - 1)
            hi = min(hi, b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


def crc_part(doc_id: str, mod: int):
    """crc32 of the decimal doc_id modulo ``mod``; a null id counts as the text "" (crc 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod
