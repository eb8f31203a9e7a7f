"""Ensemble statistics per cell and their regional aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.functions import scalar as S


def mean_spread(members: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample std (NULL below two members) and valid-member count; NaN members are excluded."""
    v = S.nan_to_null(F.col(value).cast("double"))
    return members.groupBy(*by).agg(F.avg(v).alias("ens_mean"), F.stddev_samp(v).alias("ens_std"), F.count(v).alias("n_members"))


def member_statistics(members: DataFrame, by: Sequence[str], value: str = "value", clim: str | None = None,
                      ref: str | None = None) -> DataFrame:
    """All member statistics in one aggregation: mean, std, IQR, P10-P90, corrected skewness, sign agreement, rank.

    The group is one cell of one forecast, so its size is the ensemble size.  The sign agreement needs the ensemble
    mean, but not a second pass: the counts of positive, zero and negative member anomalies are enough."""
    v = S.nan_to_null(F.col(value).cast("double"))
    aggs = [F.avg(v).alias("ens_mean"), F.stddev_samp(v).alias("ens_std"), F.count(v).alias("n_members"),
            F.percentile(v, [0.10, 0.25, 0.75, 0.90]).alias("_q"), F.skewness(v).alias("_g1")]
    if clim:
        d = v - F.col(clim)
        aggs += [F.first(clim, ignorenulls=True).alias("_clim"),
                 *[F.count(F.when(F.signum(d) == s, 1)).alias(f"_s{i}") for i, s in enumerate((-1, 0, 1))]]
    if ref:
        aggs += [F.count(F.when(v < F.col(ref), 1)).alias("_below"), F.first(ref, ignorenulls=True).alias("_ref")]
    g = members.groupBy(*by).agg(*aggs)
    n = F.col("n_members")
    cols = ["ens_mean", "ens_std", "n_members", (F.col("_q")[2] - F.col("_q")[1]).alias("m_iqr"),
            (F.col("_q")[3] - F.col("_q")[0]).alias("m_p10p90"),
            F.when((n > 2) & (F.col("ens_std") > 0), F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("m_skew")]
    if clim:
        sign = F.signum(F.col("ens_mean") - F.col("_clim"))
        same = F.when(sign > 0, F.col("_s2")).when(sign < 0, F.col("_s0")).when(sign == 0, F.col("_s1"))
        cols.append((same / n).alias("m_sign_agree"))
    if ref:
        cols.append(F.when(F.col("_ref").isNotNull(), F.col("_below")).alias("ref_rank"))
    return g.select(*by, *cols)


def regional_errors(cells: DataFrame, bridge: DataFrame, by: Sequence[str], spacing: float, forecast: str = "ens_mean",
                    reference: str = "ref", spread: str = "ens_std", clim: str | None = None, lat: str = "lat",
                    lon: str = "lon") -> DataFrame:
    """Per region: area-weighted RMSE (missing cells leave numerator and weight), bias, mean, RMS spread, anomaly."""
    f, r, w = F.col(forecast), F.col(reference), S.area_weight(lat, spacing)
    se = (f - r) * (f - r)
    aggs = [F.sqrt(F.sum(w * se) / F.sum(F.when(se.isNotNull(), w))).alias("error_m"), F.avg(f - r).alias("bias_m"),
            F.avg(f).alias("mean_m"), F.sqrt(F.avg(F.col(spread) * F.col(spread))).alias("spread_m")]
    if clim:
        aggs.append(F.avg(r - F.col(clim)).alias("ref_anom_m"))
    return cells.join(bridge, [lat, lon]).groupBy(*by, "region_id").agg(*aggs)


def spread_skill(cases: DataFrame, n_members: float, by: Sequence[str] = ("lead_day",)) -> DataFrame:
    g = cases.groupBy(*by).agg(F.avg(F.col("error_m") * F.col("error_m")).alias("_mse"),
                               F.avg(F.col("spread_m") * F.col("spread_m")).alias("_var"),
                               F.corr("spread_m", "error_m").alias("corr_spread_error"))
    return g.select(*by, F.sqrt("_mse").alias("rmse_m"), F.sqrt("_var").alias("spread_m"),
                    (F.sqrt(F.lit((n_members + 1) / n_members) * F.col("_var")) / F.sqrt("_mse")).alias("spread_skill_ratio"),
                    "corr_spread_error")


def rank_histogram(ranks: DataFrame, by: str = "lead_day", rank: str = "ref_rank", members: str = "n_members") -> DataFrame:
    """Counts per (lead, rank 0..M) with empty bins; M is the largest member count of the lead."""
    frame = ranks.groupBy(by).agg(F.max(members).cast("int").alias("_m")).select(by, F.explode(F.sequence(F.lit(0), F.coalesce("_m", F.lit(0)))).alias("rank"))
    counts = ranks.where(F.col(rank).isNotNull()).groupBy(by, F.col(rank).cast("int").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counts, [by, "rank"], "left").select(by, "rank", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
