"""Scans: pruned reads of forecast, reference and climatology tables, and source-convention clean-up.

Filters are plain column predicates, so partition pruning (``init_date``, ``level``) and parquet pushdown apply;
the functions take a DataFrame (normally ``spark.read.parquet``) and return a DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.functions import scalar as S

# column names used by other providers -> canonical names (fixed values)
CANONICAL_NAMES = {"latitude": "lat", "longitude": "lon", "number": "member", "prediction_timedelta": "lead_hours",
                   "step": "lead_hours", "isobaricInhPa": "level", "time": "init_time"}


def scan_members(df: DataFrame, leads: Sequence[int], levels: Sequence[int], box: Mapping[str, float],
                 lead: str = "lead_hours", inits: Sequence[str] | None = None) -> DataFrame:
    """Forecast members of the wanted leads, levels, box (and inits)."""
    out = df.where(F.col("level").isin(*levels) & F.col(lead).isin(*leads) & S.in_box("lat", "lon", box))
    return out if inits is None else out.where(F.col("init_time").isin(*[F.lit(t).cast("timestamp") for t in inits]))


def scan_reference(df: DataFrame, start: str, end: str) -> DataFrame:
    """Reference analysis of a closed valid-time slice."""
    return df.where(F.col("valid_time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def scan_reduced(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Extra variables reduced over members at load time: mean and sample std, combined on the map side."""
    stats: list[Column] = []
    for v in variables:
        stats += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")]
    return df.groupBy(*by).agg(*stats, F.count(F.lit(1)).alias("n_members"))


def scan_init(df: DataFrame, init: str) -> DataFrame:
    """One initialisation of a provider: an equality on the partition column."""
    return df.where(F.col("init_time") == F.lit(init).cast("timestamp"))


def normalise_coordinates(df: DataFrame, names: Mapping[str, str] = CANONICAL_NAMES) -> DataFrame:
    """Provider column names -> canonical names, longitudes into [0, 360)."""
    out = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    return out.withColumn("lon", S.wrap_longitude("lon"))


def provenance(members: DataFrame, providers: DataFrame, lead: str = "lead_hours") -> DataFrame:
    """One row per (provider, init): members, leads, valid-time span, with the provider's static facts.

    The collected sets hold leads and levels, whose number is fixed by the forecast layout."""
    per_init = members.groupBy("provider", "init_time").agg(
        F.count_distinct("member").alias("n_members"),
        F.array_join(F.sort_array(F.collect_set(lead)).cast("array<string>"), ",").alias("leads"),
        F.array_join(F.sort_array(F.collect_set("level")).cast("array<string>"), ",").alias("levels"),
        F.min("valid_time").alias("first_valid"), F.max("valid_time").alias("last_valid"))
    return per_init.join(providers, "provider", "left")


def dataset_manifest(cases: DataFrame) -> DataFrame:
    return cases.groupBy("split").agg(F.min("init_time").alias("first_init"), F.max("init_time").alias("last_init"),
                                      F.count_distinct("init_time").alias("n_inits"), F.count(F.lit(1)).alias("n_rows"))


def missing_blocks(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Block keys still to be loaded: in ``wanted`` but not in ``present``."""
    return wanted.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")
