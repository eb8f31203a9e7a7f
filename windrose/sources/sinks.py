"""Sinks: partitioned parquet tables, strict JSON, memory store, blind/verification documents, run registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrose import constants as C
from windrose.functions import scalar as S


def forbidden_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(C.FORBIDDEN_PREFIXES)]


def guard_forbidden(df: DataFrame) -> DataFrame:
    """Refuse a frame that carries verification columns; decided on the schema, before any job runs."""
    bad = forbidden_columns(df.columns)
    if bad:
        raise ValueError(f"verification columns in a forecast-only frame: {bad}")
    return df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",), mode: str = "overwrite") -> str:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def scan_table(spark: SparkSession, path: str, columns: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Column-pruned, partition-pruned read."""
    return spark.read.parquet(path).where(F.col("split").isin(*splits)).select(*columns)


def strict_json(df: DataFrame) -> DataFrame:
    """NaN and infinities -> NULL in every double column and array of doubles (JSON has no NaN)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = S.nan_to_null(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, S.nan_to_null)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_json(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    w = strict_json(df).write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)
    return path


def write_memory(cases: DataFrame, path: str, space: Sequence[str]) -> str:
    """Memory store of verified cases: float32 similarity columns, zstd, partitioned by lead and sorted so that a
    (region, valid time) range is a contiguous run of row groups.

    Rows are distributed by ranges of (lead, region, valid time), so a region with very many cases fills several files
    instead of one task."""
    keys = ["case_id", "init_time", "valid_time", "region_id", "split", "bust", "norm_error", "sig_class"]
    (cases.select(*keys, "lead_day", *[F.col(c).cast("float").alias(c) for c in space])
     .repartitionByRange("lead_day", "region_id", "valid_time").sortWithinPartitions("lead_day", "region_id", "valid_time")
     .write.mode("overwrite").partitionBy("lead_day").option("compression", "zstd").parquet(path))
    return path


def blind_documents(rows: DataFrame) -> DataFrame:
    """One forecast document per (init, region): ordered days, no verification column (guarded)."""
    day = guard_forbidden(rows.select("lead_day", "p", "spread_m", "alert"))
    return rows.groupBy("init_time", "region_id").agg(
        F.sort_array(F.collect_list(F.struct(*day.columns))).alias("days"))


def verification_documents(rows: DataFrame) -> DataFrame:
    """The matching document that is only opened after the forecast is judged."""
    return rows.groupBy("init_time", "region_id").agg(
        F.sort_array(F.collect_list(F.struct("lead_day", "error_m", "observed"))).alias("days"))


def append_registry(runs: DataFrame, path: str) -> str:
    """Experiment registry: every run appends a row, nothing is rewritten."""
    runs.write.mode("append").json(path)
    return path
