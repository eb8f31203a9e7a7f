"""Train-only normalisation, thresholds and exceedance labels.

Everything fitted here reads TRAIN rows only; the fitted tables are small (one row per group) and are joined
back to the cases by equi-joins that Catalyst broadcasts while they stay under the broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.functions import scalar as S
from windrose.operators.ordered import grouped_quantiles, reference_percentile
from windrose.session import stored_once

GROUP = list(C.GROUP)
#: Quotients and interpolated quantiles carry rounding errors: what is nearer to a threshold than this is equal to it.
TIE = 1e-9


def is_train(split: str = "split"):
    return F.col(split) == "train"


def fit_normalisation(cases: DataFrame, anomaly: str = "ref_anom_m", order: Sequence[str] = ("init_time", "lead_day"),
                      ) -> DataFrame:
    """Scale(region, season) = sample std of the reference anomaly over distinct TRAIN (region, valid time).

    One verification is shared by many (init, lead) rows; the first in canonical order represents it, chosen
    with a struct minimum so the reduction is combined on the map side."""
    first = (cases.where(is_train()).groupBy("region_id", "valid_time")
             .agg(F.min(F.struct(*order, "season", anomaly)).alias("f")))
    scale = first.groupBy("region_id", F.col("f.season").alias("season")).agg(
        F.stddev_samp(f"f.{anomaly}").alias("scale_m"))
    return scale.withColumn("fitted_on", F.lit("train"))


def require_positive_scale(scale: DataFrame) -> DataFrame:
    bad = F.col("scale_m").isNull() | (F.col("scale_m") <= 0)
    return scale.withColumn("scale_m", F.when(bad, F.raise_error(F.lit("degenerate normalisation scale")).cast("double"))
                            .otherwise(F.col("scale_m")))


def attach(cases: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join of a fitted table; rows of an unseen group keep NULL parameters."""
    return cases.join(fitted, list(keys), "left")


def fit_thresholds(cases: DataFrame, error: str = "norm_error", spread: str = "spread_m") -> DataFrame:
    """Error and spread quantiles of TRAIN per group; both measures share one ordered pass."""
    train = cases.where(is_train())
    both = train.select(*GROUP, F.explode(F.array(
        F.struct(F.lit("error").alias("measure"), F.col(error).cast("double").alias("v")),
        F.struct(F.lit("spread").alias("measure"), F.col(spread).cast("double").alias("v")))).alias("m")).select(*GROUP, "m.*")
    probs = {"q_primary": C.PRIMARY_QUANTILE, "q_sensitivity": C.SENSITIVITY_QUANTILE, "spread_low": C.LOW_SPREAD_QUANTILE}
    q = grouped_quantiles(both, [*GROUP, "measure"], "v", probs)
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(c)          # noqa: E731
    wide = q.groupBy(*GROUP).agg(of("error", "q_primary"), of("error", "q_sensitivity"), of("spread", "spread_low"))
    n = train.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_train"))
    return n.join(wide, GROUP, "left").select(*GROUP, "q_primary", "q_sensitivity", "spread_low", "n_train", F.lit("train").alias("fitted_on"))


def exceedance_labels(df: DataFrame) -> DataFrame:
    """bust / bust_q95 use a strict >, low_spread uses <=, both up to ``TIE``; without a threshold all flags are 0."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")      # noqa: E731
    bust = F.col("norm_error") > F.col("q_primary") + TIE
    low = F.col("spread_m") <= F.col("spread_low") + TIE
    return df.withColumns({
        "bust": flag(bust), "bust_q95": flag(F.col("norm_error") > F.col("q_sensitivity") + TIE),
        "low_spread": flag(low), "hidden_bust": flag(bust & low)})


def spread_percentile(cases: DataFrame, out: str = "spread_pct") -> DataFrame:
    return reference_percentile(cases, GROUP, "spread_m", is_train(), out)


def label_cases(cases: DataFrame, anomaly: str = "ref_anom_m", order: Sequence[str] = ("init_time", "lead_day"),
                n_members: float = C.ENSEMBLE_SIZE, percentile: bool = False) -> DataFrame:
    """Case rows with split -> normalised error, thresholds, labels and the spread inputs.

    The scale is written once: a second evaluation may add in another order and differ in its last bit, and then errors equal to
    their threshold (most thresholds are an observed value) fall on either side of it."""
    scale = stored_once(fit_normalisation(cases, anomaly, order).drop("fitted_on"), "scale")
    scaled = attach(cases, scale, ["region_id", "season"]).withColumn(
        "norm_error", S.normalized_error("error_m", "scale_m"))
    th = fit_thresholds(scaled).drop("n_train", "fitted_on")
    out = exceedance_labels(attach(scaled, th, GROUP))
    out = out.withColumn("spread_thr_ratio", S.spread_threshold_ratio("spread_m", "q_primary", "scale_m", n_members))
    return spread_percentile(out) if percentile else out


def fit_acc_thresholds(cases: DataFrame, acc: str = "local_acc", q: float = C.ACC_QUANTILE) -> DataFrame:
    return grouped_quantiles(cases.where(is_train()), GROUP, acc, {"acc_q10": q})


def pattern_labels(cases: DataFrame, acc: str = "local_acc") -> DataFrame:
    """Pattern-aware label: magnitude AND pattern failure; NULL where the correlation or its threshold is missing."""
    d = attach(cases, fit_acc_thresholds(cases, acc), GROUP)
    pattern = (F.col(acc) < F.col("acc_q10")).cast("int")        # NULL when either side is NULL
    joint = F.when(pattern.isNull(), None).otherwise(((F.col("bust") == 1) & (pattern == 1)).cast("int"))
    hidden = F.when(pattern.isNull(), None).otherwise(
        ((F.col("bust") == 1) & (pattern == 1) & (F.col("low_spread") == 1)).cast("int"))
    return d.withColumns({"magnitude_failure": F.col("bust"), "pattern_failure": pattern, "pattern_bust": joint,
                          "hidden_pattern_bust": hidden})


def climatology_rates(cases: DataFrame, label: str = "bust", keys: Sequence[str] = C.GROUP) -> DataFrame:
    """TRAIN rate per group together with the global TRAIN rate (row with NULL keys), one grouping-sets pass."""
    keys = list(keys)
    return (cases.where(is_train()).rollup(*keys).agg(F.avg(label).alias("rate"), F.count(label).alias("n"),
                                                      F.grouping_id().alias("_g"))
            .where(F.col("_g").isin(0, 2 ** len(keys) - 1)).drop("_g"))


def predict_climatology(cases: DataFrame, rates: DataFrame, keys: Sequence[str] = C.GROUP, out: str = "p_b0") -> DataFrame:
    """Group rate, or the global rate for a group without TRAIN rows."""
    keys = list(keys)
    per_group = rates.where(F.col(keys[0]).isNotNull()).select(*keys, F.col("rate").alias("_rate"))
    overall = rates.where(F.col(keys[0]).isNull()).select("rate").scalar()
    return cases.join(per_group, keys, "left").withColumn(out, F.coalesce("_rate", overall)).drop("_rate")


def split_summary(cases: DataFrame) -> DataFrame:
    return cases.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("bust").alias("bust_rate"), F.avg("bust_q95").alias("bust_q95_rate"),
        F.avg("hidden_bust").alias("hidden_rate"), F.count_distinct("init_time").alias("n_inits"),
        F.min("init_time").alias("first_init"), F.max("init_time").alias("last_init"))
