"""Grouped summaries of case tables: audits, profiles, frequency tables, overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.operators.ordered import grouped_quantiles

from windrose import constants as C


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def rate_where(value: str, condition: Column) -> Column:
    return F.avg(F.when(condition, F.col(value).cast("double")))


def target_audit(df: DataFrame) -> DataFrame:
    """Prevalences, conditional shares, positive and invalid counts and correlation quantiles of the pattern-aware target per split."""
    valid = F.col("pattern_bust").isNotNull()
    pos = F.col("pattern_bust") == 1
    g = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), share(F.col("local_acc").isNotNull()).alias("acc_coverage"),
        F.avg("pattern_bust").alias("pattern_rate"), F.avg("bust").alias("magnitude_rate"),
        F.avg("pattern_failure").alias("failure_rate"),
        rate_where("pattern_bust", F.col("bust") == 1).alias("pattern_share_of_magnitude"),
        rate_where("bust", F.col("pattern_failure") == 1).alias("magnitude_share_of_failures"),
        F.count(F.when(pos, 1)).alias("positive_rows"), F.count_distinct(F.when(pos, F.col("init_time"))).alias("positive_inits"),
        F.count_distinct("init_time").alias("n_inits"), F.count(F.when(F.col("hidden_pattern_bust") == 1, 1)).alias("hidden_rows"),
        F.count(F.when(valid, 1)).alias("valid_rows"), F.count(F.when(~valid, 1)).alias("invalid_rows"))
    acc = grouped_quantiles(df, ["split"], "local_acc", {"acc_q05": 0.05, "acc_q10": 0.10, "acc_q50": 0.50, "acc_q90": 0.90})
    return g.join(acc, "split", "left").withColumn("joint_vs_independence", F.col("pattern_rate") / (F.col("magnitude_rate") * F.col("failure_rate")))


def positives_by(df: DataFrame, by: str, keys: DataFrame, label: str = "pattern_bust") -> DataFrame:
    """Positive rows per (split, key) including keys without any (zero-fill over the key dimension)."""
    pos = df.where(F.col(label) == 1).groupBy("split", by).agg(F.count(F.lit(1)).alias("n_pos"))
    return keys.join(pos, ["split", by], "left").select("split", by, F.coalesce("n_pos", F.lit(0).cast("long")).alias("n_pos"))


def value_shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Normalised value counts; the window runs over the (small) table of counts."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*(list(by) or [F.lit(0)])))
    return counts.withColumn("share", F.col("n") / total)


def lead_summary(cases: DataFrame, p: str, threshold: float, by: Sequence[str] = ("init_time", "lead_day")) -> DataFrame:
    return cases.groupBy(*by).agg(F.avg(p).alias("mean_p"), F.max(p).alias("max_p"),
                                  F.count(F.when(F.col(p) >= threshold, 1)).alias("n_alerts"))


def region_overview(cases: DataFrame, p: str, threshold: float) -> DataFrame:
    """Per (init, region): peak day (first maximum), peak value, alert days; a trajectory has one row per lead."""
    alert = F.when(F.col(p) >= threshold, F.col("lead_day"))
    g = cases.groupBy("init_time", "region_id").agg(
        F.max(F.struct(F.col(p).alias("p"), (-F.col("lead_day")).alias("d"))).alias("_m"),
        F.sort_array(F.collect_list(alert)).alias("_a"))
    return g.select("init_time", "region_id", (-F.col("_m.d")).alias("peak_day"), F.col("_m.p").alias("peak_p"),
                    F.array_join(F.col("_a").cast("array<string>"), ",").alias("alert_days"),
                    F.array_min("_a").alias("first_alert_day"))


def trajectory(cases: DataFrame, p: str) -> DataFrame:
    """Lead-ordered array per (init, region); at most one element per lead."""
    g = cases.groupBy("init_time", "region_id").agg(F.sort_array(F.collect_list(F.struct("lead_day", p))).alias("t"))
    return g.withColumn("trajectory", F.col(f"t.{p}")).drop("t")


def case_summary(cases: DataFrame, alert: Column, label: str = "bust", by: Sequence[str] = ("init_time",)) -> DataFrame:
    a, y = alert, F.col(label) == 1
    n = lambda c: F.count(F.when(c, 1))                              # noqa: E731
    g = cases.groupBy(*by).agg(n(a).alias("alerts"), n(a & y).alias("hits"), n(y).alias("busts"),
                               n(F.col("hidden_bust") == 1).alias("hidden_busts"), n(a | y).alias("_union"))
    return g.withColumn("jaccard", F.col("hits") / F.greatest("_union", F.lit(1))).drop("_union")


def feature_profile(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("split",)) -> DataFrame:
    """Missing share, population std and distinct count per feature; features become rows before one grouping."""
    long = df.unpivot(list(by), list(features), "feature", "value") if len(features) > 1 else df.select(
        *by, F.lit(features[0]).alias("feature"), F.col(features[0]).alias("value"))
    return long.groupBy(*by, "feature").agg(share(F.col("value").isNull()).alias("missing_share"),
                                            F.stddev_pop("value").alias("std"), F.count_distinct("value").alias("n_unique"))


def prevalence(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("bust").alias("bust_rate"), F.avg("hidden_bust").alias("hidden_rate"),
        F.avg("low_spread").alias("low_spread_share"),
        F.try_divide(F.sum("hidden_bust").cast("double"), F.sum("bust").cast("double")).alias("hidden_share_of_busts"),
        rate_where("bust", F.col("low_spread") == 1).alias("bust_rate_low_spread"),
        rate_where("bust", F.col("low_spread") == 0).alias("bust_rate_other"))


def standardise(df: DataFrame, columns: Sequence[str], out: str = "vector") -> DataFrame:
    """z-scores with TRAIN mean and std (std 0 -> 1), missing -> 0, as one array column."""
    stats = df.where("split = 'train'").agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)])
    packed = stats.select(F.struct(*stats.columns).alias("p")).scalar()
    z = [F.coalesce((F.col(c) - F.col(f"_p.m{i}")) / F.when(F.col(f"_p.s{i}") == 0, 1.0).otherwise(F.col(f"_p.s{i}")), F.lit(0.0))
         for i, c in enumerate(columns)]
    return df.withColumn("_p", packed).withColumn(out, F.array(*z)).drop("_p")


def standardise_vector(df: DataFrame, vector: str, out: str = "z") -> DataFrame:
    """The same scaling for an existing array column, fitted on TRAIN rows per dimension."""
    dims = (df.where("split = 'train'").select(F.posexplode(vector).alias("i", "x")).groupBy("i")
            .agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")))
    params = dims.agg(F.sort_array(F.collect_list(F.struct("i", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))
                                   ).alias("p")).scalar()        # one element per dimension
    return df.withColumn("_p", params).withColumn(
        out, F.zip_with(vector, "_p", lambda x, p: F.coalesce((x - p["m"]) / p["s"], F.lit(0.0)))).drop("_p")


GROUP = list(C.GROUP)
