"""Joins of forecasts with verification, climatology, earlier cycles and fitted parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.operators.ordered import ordered_totals


def missing_reference(forecast: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Valid times (and cells) that have no verification."""
    return forecast.select(*keys).distinct().join(reference.select(*keys), list(keys), "left_anti")


def align_reference(forecast: DataFrame, reference: DataFrame, keys: Sequence[str], missing: str = "raise") -> DataFrame:
    """Verification looked up at valid time.  ``missing``: 'raise', 'drop' (block not yet verified) or 'keep'.

    With 'raise' the join itself fails at the first forecast row without a reference: no pass of its own looks for one."""
    if missing != "raise":
        return forecast.join(reference, list(keys), "left" if missing == "keep" else "inner")
    j = forecast.join(reference.withColumn("_hit", F.lit(True)), list(keys), "left")
    text = F.concat(F.lit("verification reference missing, e.g. "), F.to_json(F.struct(*keys)))
    return j.where(F.when(F.col("_hit").isNull(), F.raise_error(text).cast("boolean")).otherwise(F.lit(True))).drop("_hit")


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, with an error at run time when a key occurs twice.  The grouping shuffles on the join keys,
    a partitioning the following join reuses."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_r"))
    guarded = F.when(F.col("_n") > 1, F.raise_error(F.lit("merge keys are not unique")).cast("int")).otherwise(1)
    return g.where(guarded == 1).select(*keys, "_r.*")


def one_to_one_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return unique(left, keys).join(unique(right, keys), list(keys), "left")


def previous_cycle(df: DataFrame, cell_keys: Sequence[str], values: Sequence[str], previous_init: Column) -> DataFrame:
    """Attach ``prev_*``: the earlier cycle's forecast for the same cell and the same valid time."""
    prev = df.select(*cell_keys, "valid_time", F.col("init_time").alias("_init"), *[F.col(v).alias(f"prev_{v}") for v in values])
    return df.withColumn("_init", previous_init).join(prev, [*cell_keys, "valid_time", "_init"], "left").drop("_init")


def eligible_counts(queries: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of candidates of the same key verified no later than each query's init time.

    Both sides are stacked on one time axis and counted by a distributed prefix sum: no candidate pair is formed."""
    axis = (candidates.select(*keys, F.unix_micros("valid_time").alias("t"), F.lit(1).alias("n"))
            .unionByName(queries.select(*keys, F.unix_micros("init_time").alias("t"), F.lit(0).alias("n"))))
    t = ordered_totals(axis, keys, "t", {"n": F.col("n")})
    seen = t.select(*keys, "t", (F.col("below_n") + F.col("n")).cast("long").alias("n_eligible"))
    return (queries.withColumn("t", F.unix_micros("init_time")).join(seen, [*keys, "t"], "left")
            .withColumn("n_eligible", F.coalesce("n_eligible", F.lit(0).cast("long"))).drop("t"))


def rolling_cases(cases: DataFrame, window_days: int) -> DataFrame:
    """(fit_day, case) for every case verified in (fit_day - window, fit_day].

    A case announces the ``window_days`` fit days that may use it (0 UTC days at or after its verification), which
    turns the interval join into a plain grouping key."""
    first = F.to_date(F.col("valid_time") + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '0.000001' SECOND"))
    return cases.withColumn("fit_day", F.explode(F.sequence(first, F.date_add(first, window_days - 1))))


def parameter_lookup(rows: DataFrame, params: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parameters of the row's init day; a day or group without a fit stays NULL and is never imputed."""
    return rows.withColumn("fit_day", F.to_date("init_time")).join(params, ["fit_day", *keys], "left")


def member_rows(rows: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Case rows with their member array; an uncovered row is an error."""
    j = rows.join(members.withColumn("_covered", F.lit(True)), list(keys), "left")
    covered = F.when(F.col("_covered").isNull(), F.raise_error(F.lit("case row not covered by the member archive")).cast("boolean")
                     ).otherwise(F.lit(True))
    return j.where(covered).drop("_covered")


def evaluation_frame(labels: DataFrame, *others: DataFrame) -> DataFrame:
    """Labels with features and predictions, inner on case_id."""
    out = labels
    for o in others:
        out = out.join(o, "case_id")
    return out
