"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.functions import scalar as S
from windrose.operators import ensemble as E
from windrose.operators import grid as G
from windrose.operators import labels as L
from windrose.operators import ordered as O
from windrose.operators import stencils as ST
from windrose.operators import summaries as SU
from windrose.plans import bridge as B
from windrose.plans.joins import FINE, N, REGIONS, fine, regions
from windrose.plans.registry import query
from windrose.session import cut_lineage

CELL = ["init_time", "lead_day", "cell"]


@query("ensemble_mean_spread", ctes=B.MEMBERS, doubles="ens_mean ens_std", sql="""
  SELECT init_time, lead_day, cell, avg(value) AS ens_mean, stddev_samp(value) AS ens_std, count(value) AS n_members FROM members GROUP BY ALL""")
def ensemble_mean_spread(spark: SparkSession, sf: str) -> DataFrame:
    return E.mean_spread(B.members(spark, sf), CELL)


def member_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = (B.members(spark, sf).withColumn("month_n", F.month("valid_time"))
         .join(B.climatology(spark, sf).select("month_n", "cell", "clim_value"), ["month_n", "cell"], "left")
         .join(B.reference(spark, sf), ["valid_time", "cell"], "left"))
    return E.member_statistics(m, CELL, clim="clim_value", ref="ref_value")


@query("member_quantiles", ctes=B.MEMBERS, doubles="m_iqr m_p10p90", sql="""
  SELECT init_time, lead_day, cell, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS m_iqr,
         quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS m_p10p90 FROM members GROUP BY ALL""")
def member_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return E.member_statistics(B.members(spark, sf), CELL).select(*CELL, "m_iqr", "m_p10p90")


@query("member_skew", ctes=B.MEMBERS, doubles="m_skew", sql="""
  SELECT init_time, lead_day, cell, CASE WHEN count(value) > 2 AND stddev_samp(value) > 0 THEN skewness(value) END AS m_skew FROM members GROUP BY ALL""")
def member_skew(spark: SparkSession, sf: str) -> DataFrame:
    return E.member_statistics(B.members(spark, sf), CELL).select(*CELL, "m_skew")


_WITH_CLIM = B.MEMBERS + "," + B.REFERENCE + "," + B.CLIMATOLOGY


@query("member_sign_agree", ctes=_WITH_CLIM, doubles="m_sign_agree", sql="""
  SELECT init_time, lead_day, cell, avg(CASE WHEN sign(value - clim_value) = sign(mean - clim_value) THEN 1e0 ELSE 0e0 END) AS m_sign_agree
  FROM (SELECT m.*, c.clim_value, avg(m.value) OVER (PARTITION BY m.init_time, m.lead_day, m.cell) AS mean
        FROM members m JOIN climatology c ON c.month_n = month(m.valid_time) AND c.cell = m.cell) GROUP BY ALL""")
def member_sign_agree(spark: SparkSession, sf: str) -> DataFrame:
    return member_stats(spark, sf).select(*CELL, "m_sign_agree")


@query("rank_of_reference", ctes=_WITH_CLIM, sql="""
  SELECT init_time, lead_day, m.cell, CASE WHEN max(ref_value) IS NOT NULL THEN count(*) FILTER (value < ref_value) END AS ref_rank
  FROM members m LEFT JOIN reference r ON r.valid_time = m.valid_time AND r.cell = m.cell GROUP BY ALL""")
def rank_of_reference(spark: SparkSession, sf: str) -> DataFrame:
    return member_stats(spark, sf).select(*CELL, "ref_rank")


# --- regional aggregation on the refined grid ---------------------------------------------------------------------

def fine_states(spark: SparkSession, sf: str) -> DataFrame:
    f = fine(spark, sf).groupBy("init_time", "cell", F.col("flat").alias("lat"), F.col("flon").alias("lon")).agg(
        F.avg("value").alias("ens_mean"), F.stddev_samp("value").alias("ens_std"))
    ref = B.reference(spark, sf).select(F.col("valid_time").alias("init_time"), "cell", F.col("ref_value").alias("ref"))
    clim = B.climatology(spark, sf).select("month_n", "cell", "clim_value")
    return (f.join(ref, ["init_time", "cell"], "left").withColumn("month_n", F.month("init_time"))
            .join(clim, ["month_n", "cell"], "left").drop("month_n"))


FINE_STATES = _WITH_CLIM + "," + REGIONS + "," + FINE + """,
fine_states AS (
  SELECT f.init_time, f.cell, flat, flon, avg(value) AS f, stddev_samp(value) AS sd, max(ref_value) AS r, max(clim_value) AS c
  FROM fine f LEFT JOIN reference a ON a.valid_time = f.init_time AND a.cell = f.cell
  LEFT JOIN climatology k ON k.month_n = month(f.init_time) AND k.cell = f.cell GROUP BY ALL),
regional AS (
  SELECT s.*, region_id, sin(radians(flat + 5e0 / 6)) - sin(radians(flat - 5e0 / 6)) AS w FROM fine_states s
  JOIN regions g ON flat >= lat_lo AND flat < lat_hi AND flon >= lon_lo AND flon < lon_hi)"""


@B.memo
def region_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """(region, cell), derived once from the distinct cells of the refined grid."""
    cells = cut_lineage(fine(spark, sf).select("flat", "flon").distinct())
    return cut_lineage(G.region_cells(regions(spark, sf), cells, "flat", "flon").withColumnsRenamed({"flat": "lat", "flon": "lon"}))


def regional(spark: SparkSession, sf: str) -> DataFrame:
    s, bridge = fine_states(spark, sf), region_bridge(spark, sf)
    return E.regional_errors(s, bridge, ["init_time"], 5.0 / 3, clim="clim_value")


@query("regional_mean", ctes=FINE_STATES, doubles="mean_m", sql="SELECT init_time, region_id, avg(f) AS mean_m FROM regional GROUP BY ALL")
def regional_mean(spark: SparkSession, sf: str) -> DataFrame:
    return regional(spark, sf).select("init_time", "region_id", "mean_m")


@query("rms_spread", ctes=FINE_STATES, doubles="spread_m", sql="SELECT init_time, region_id, sqrt(avg(sd * sd)) AS spread_m FROM regional GROUP BY ALL")
def rms_spread(spark: SparkSession, sf: str) -> DataFrame:
    return regional(spark, sf).select("init_time", "region_id", "spread_m")


@query("weighted_rmse", ctes=FINE_STATES, doubles="error_m", sql="""
  SELECT init_time, region_id, sqrt(sum(w * (f - r) * (f - r)) / sum(w) FILTER (f IS NOT NULL AND r IS NOT NULL)) AS error_m
  FROM regional GROUP BY ALL""")
def weighted_rmse(spark: SparkSession, sf: str) -> DataFrame:
    return regional(spark, sf).select("init_time", "region_id", "error_m")


@query("regional_bias", ctes=FINE_STATES, doubles="bias_m ref_anom_m", sql="""
  SELECT init_time, region_id, avg(f - r) AS bias_m, avg(r - c) AS ref_anom_m FROM regional GROUP BY ALL""")
def regional_bias(spark: SparkSession, sf: str) -> DataFrame:
    return regional(spark, sf).select("init_time", "region_id", "bias_m", "ref_anom_m")


@query("box_mean", ctes=B.MEMBERS + "," + FINE, doubles="box_mean", sql="""
  SELECT init_time, CAST(floor((flat + 10 + 2.5) / 5) AS INTEGER) AS row_n, CAST(floor((flon - 60 + 2.5) / 5) AS INTEGER) AS col_n,
         sum(cos(radians(flat)) * value) / sum(cos(radians(flat))) AS box_mean, count(*) AS n_points
  FROM fine WHERE floor((flat + 10 + 2.5) / 5) BETWEEN 0 AND 4 AND floor((flon - 60 + 2.5) / 5) BETWEEN 0 AND 4 GROUP BY ALL""")
def box_mean(spark: SparkSession, sf: str) -> DataFrame:
    return G.conservative_box_mean(fine(spark, sf), ["init_time"], "value", "flat", "flon", -10.0, 5.0, 60.0, 5.0, N, N)


_W = "sin(radians(b.lat + 2.5)) - sin(radians(b.lat - 2.5))"


@query("failure_signature", ctes=B.GRID, doubles="sig_phase_share sig_amp_share sig_bias_m sig_corr sig_mse", sql=f"""
  WITH pairs AS (
    SELECT b.init_time, b.lead_day, CAST(ar.row_n AS INTEGER) AS row_n, CAST(ac.col_n AS INTEGER) AS col_n, b.z AS f, b.ref_value AS r, {_W} AS w
    FROM grid b JOIN (SELECT unnest(range(5)) AS row_n) ar ON abs(ar.row_n - b.row_n) <= 3
    JOIN (SELECT unnest(range(5)) AS col_n) ac ON abs(ac.col_n - b.col_n) <= 3
    WHERE b.z IS NOT NULL AND b.ref_value IS NOT NULL),
  means AS (SELECT *, sum(w * f) OVER k / sum(w) OVER k AS mf, sum(w * r) OVER k / sum(w) OVER k AS ma FROM pairs
            WINDOW k AS (PARTITION BY init_time, lead_day, row_n, col_n)),
  mom AS (SELECT init_time, lead_day, row_n, col_n, any_value(mf) AS mf, any_value(ma) AS ma, sum(w * (f - mf) * (f - mf)) / sum(w) AS vf0,
                 sum(w * (r - ma) * (r - ma)) / sum(w) AS va0, sum(w * (f - mf) * (r - ma)) / sum(w) AS cov,
                 sum(w * f * f) / sum(w) AS qf, sum(w * r * r) / sum(w) AS qa FROM means GROUP BY ALL),
  flat AS (SELECT *, CASE WHEN vf0 > 1e-12 * qf THEN vf0 ELSE 0 END AS vf, CASE WHEN va0 > 1e-12 * qa THEN va0 ELSE 0 END AS va FROM mom),
  corr AS (SELECT *, CASE WHEN vf > 0 AND va > 0 THEN cov / (sqrt(vf) * sqrt(va)) ELSE 1e0 END AS sig_corr FROM flat),
  parts AS (SELECT *, 2 * sqrt(vf) * sqrt(va) * (1 - sig_corr) AS phase, (mf - ma) * (mf - ma) + pow(sqrt(vf) - sqrt(va), 2) AS amp FROM corr),
  shares AS (SELECT *, CASE WHEN phase + amp > 0 THEN phase / (phase + amp) ELSE 0e0 END AS ps FROM parts)
  SELECT init_time, lead_day, row_n, col_n, CASE WHEN ps >= 0.6 THEN 'POSITION_PHASE' WHEN 1 - ps >= 0.6 THEN 'AMPLITUDE_STRUCTURE'
         ELSE 'RESIDUAL_MIXED' END AS sig_class, ps AS sig_phase_share, 1 - ps AS sig_amp_share, mf - ma AS sig_bias_m, sig_corr,
         phase + amp AS sig_mse FROM shares""")
def failure_signature(spark: SparkSession, sf: str) -> DataFrame:
    return ST.failure_signature(B.grid(spark, sf), "z", "ref_value", S.area_weight("lat", 5.0), ["init_time", "lead_day"], N, N, half=3)


@query("local_acc", ctes=B.GRID, doubles="local_acc", sql=f"""
  WITH pairs AS (
    SELECT b.init_time, b.lead_day, CAST(ar.row_n AS INTEGER) AS row_n, CAST(ac.col_n AS INTEGER) AS col_n, b.z - b.clim_value AS f,
           b.ref_value - b.clim_value AS r, {_W} AS w
    FROM grid b JOIN (SELECT unnest(range(5)) AS row_n) ar ON abs(ar.row_n - b.row_n) <= 1
    JOIN (SELECT unnest(range(5)) AS col_n) ac ON abs(ac.col_n - b.col_n) <= 1 WHERE b.z IS NOT NULL AND b.ref_value IS NOT NULL),
  means AS (SELECT *, sum(w * f) OVER k / sum(w) OVER k AS mf, sum(w * r) OVER k / sum(w) OVER k AS ma FROM pairs
            WINDOW k AS (PARTITION BY init_time, lead_day, row_n, col_n))
  SELECT init_time, lead_day, row_n, col_n, CASE WHEN count(*) = 9 THEN
         sum(w * (f - mf) * (r - ma)) / sqrt(sum(w * (f - mf) * (f - mf)) * sum(w * (r - ma) * (r - ma))) END AS local_acc
  FROM means GROUP BY ALL""")
def local_acc(spark: SparkSession, sf: str) -> DataFrame:
    g = B.grid(spark, sf).withColumns({"fa": F.col("z") - F.col("clim_value"), "ra": F.col("ref_value") - F.col("clim_value")})
    return ST.local_correlation(g, "fa", "ra", S.area_weight("lat", 5.0), ["init_time", "lead_day"], N, N)


# --- fitted tables and labels ---------------------------------------------------------------------------------------

@query("fit_normalisation", ctes=B.LABELLED, doubles="scale_m", sql="SELECT region_id, season, scale_m, 'train' AS fitted_on FROM scale")
def fit_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    return L.fit_normalisation(B.cases(spark, sf), "bias_m", ("init_time", "lead_day", "case_id"))


@query("fit_thresholds", ctes=B.LABELLED, doubles="q_primary q_sensitivity spread_low", sql="""
  SELECT *, 'train' AS fitted_on FROM thresholds""")
def fit_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return L.fit_thresholds(B.labelled_plan(spark, sf))


def pattern_sql(labelled: str) -> str:
    return labelled + """,
acc AS (SELECT *, CASE WHEN spread_m > 3 THEN 2 * p_b - 1 END AS local_acc FROM labelled),
acc_thr AS (SELECT region_id, lead_day, season, quantile_cont(local_acc, 0.1) AS acc_q10 FROM acc WHERE split = 'train' AND local_acc IS NOT NULL GROUP BY ALL),
pattern AS (
  SELECT a.*, t.acc_q10, bust AS magnitude_failure, CAST(local_acc < acc_q10 AS INTEGER) AS pattern_failure,
         CASE WHEN local_acc < acc_q10 IS NULL THEN NULL ELSE CAST(bust = 1 AND local_acc < acc_q10 AS INTEGER) END AS pattern_bust,
         CASE WHEN local_acc < acc_q10 IS NULL THEN NULL ELSE CAST(bust = 1 AND low_spread = 1 AND local_acc < acc_q10 AS INTEGER) END AS hidden_pattern_bust
  FROM acc a LEFT JOIN acc_thr t USING (region_id, lead_day, season))"""


PATTERN = pattern_sql(B.LABELLED)


@B.memo
def pattern(spark: SparkSession, sf: str) -> DataFrame:
    acc = B.labelled(spark, sf).withColumn("local_acc", F.when(F.col("spread_m") > 3, 2 * F.col("p_b") - 1))
    return L.pattern_labels(acc)


@query("pattern_labels", ctes=pattern_sql(B.LABELLED_TIES), doubles="local_acc acc_q10", sql="""
  SELECT case_id, local_acc, acc_q10, magnitude_failure, pattern_failure, pattern_bust, hidden_pattern_bust FROM pattern""")
def pattern_labels(spark: SparkSession, sf: str) -> DataFrame:
    return pattern(spark, sf).select("case_id", "local_acc", "acc_q10", "magnitude_failure", "pattern_failure", "pattern_bust",
                                     "hidden_pattern_bust")


@query("b0_fit", ctes=B.LABELLED, doubles="rate", sql="""
  SELECT region_id, lead_day, season, avg(bust) AS rate, count(*) AS n FROM labelled WHERE split = 'train' GROUP BY region_id, lead_day, season
  UNION ALL SELECT NULL, NULL, NULL, avg(bust), count(*) FROM labelled WHERE split = 'train'""")
def b0_fit(spark: SparkSession, sf: str) -> DataFrame:
    return L.climatology_rates(B.labelled(spark, sf))


@query("target_audit", ctes=PATTERN, doubles="acc_coverage pattern_rate magnitude_rate failure_rate pattern_share_of_magnitude magnitude_share_of_failures joint_vs_independence acc_q05 acc_q10 acc_q50 acc_q90", sql="""
  SELECT split, count(*) AS n_rows, avg(CASE WHEN local_acc IS NOT NULL THEN 1e0 ELSE 0e0 END) AS acc_coverage, avg(pattern_bust) AS pattern_rate,
         avg(bust) AS magnitude_rate, avg(pattern_failure) AS failure_rate, avg(pattern_bust) FILTER (bust = 1) AS pattern_share_of_magnitude,
         avg(bust) FILTER (pattern_failure = 1) AS magnitude_share_of_failures, count(*) FILTER (pattern_bust = 1) AS positive_rows,
         count(DISTINCT init_time) FILTER (pattern_bust = 1) AS positive_inits, count(DISTINCT init_time) AS n_inits,
         count(*) FILTER (hidden_pattern_bust = 1) AS hidden_rows, count(pattern_bust) AS valid_rows,
         count(*) - count(pattern_bust) AS invalid_rows, quantile_cont(local_acc, 0.05) AS acc_q05, quantile_cont(local_acc, 0.10) AS acc_q10,
         quantile_cont(local_acc, 0.50) AS acc_q50, quantile_cont(local_acc, 0.90) AS acc_q90, avg(pattern_bust) / (avg(bust) * avg(pattern_failure)) AS joint_vs_independence
  FROM pattern GROUP BY split""")
def target_audit(spark: SparkSession, sf: str) -> DataFrame:
    return SU.target_audit(pattern(spark, sf))


@query("target_audit_leads", ctes=PATTERN, sql="""
  SELECT split, lead_day, count(*) FILTER (pattern_bust = 1) AS n_pos FROM pattern GROUP BY ALL""")
def target_audit_leads(spark: SparkSession, sf: str) -> DataFrame:
    p = pattern(spark, sf)
    return SU.positives_by(p, "lead_day", p.select("split", "lead_day").distinct())


@query("target_audit_regions", ctes=PATTERN, doubles="median_pos", sql="""
  SELECT split, min(n) AS min_pos, median(n) AS median_pos, max(n) AS max_pos FROM (
    SELECT split, region_id, count(*) FILTER (pattern_bust = 1) AS n FROM pattern GROUP BY ALL) GROUP BY split""")
def target_audit_regions(spark: SparkSession, sf: str) -> DataFrame:
    p = pattern(spark, sf)
    pos = SU.positives_by(p, "region_id", p.select("split", "region_id").distinct())
    return pos.groupBy("split").agg(F.min("n_pos").alias("min_pos"), F.percentile("n_pos", 0.5).alias("median_pos"),
                                    F.max("n_pos").alias("max_pos"))


@query("quantile_grid", ctes=B.CASES, doubles="quantile", sql="""
  WITH long AS (SELECT 'error_m' AS feature, error_m AS x FROM cases WHERE split = 'train' UNION ALL SELECT 'spread_m', spread_m FROM cases WHERE split = 'train')
  SELECT feature, CAST(i AS INTEGER) AS grid_index, q[CAST(i + 1 AS INTEGER)] AS quantile FROM (
    SELECT feature, quantile_cont(x, [k / 1000e0 FOR k IN range(0, 1001)]) AS q FROM long GROUP BY feature), range(0, 1001) t(i)""")
def quantile_grid(spark: SparkSession, sf: str) -> DataFrame:
    long = B.cases(spark, sf).where("split = 'train'").unpivot(["case_id"], ["error_m", "spread_m"], "feature", "x")
    return O.quantile_grid(long, ["feature"], "x")


@query("standardise", ctes=B.CASES, doubles="z_error z_ratio", sql="""
  WITH d AS (SELECT case_id, split, error_m, CASE WHEN spread_m > 5 THEN p_b END AS r FROM cases),
  s AS (SELECT avg(error_m) AS m1, stddev_samp(error_m) AS s1, avg(r) AS m2, stddev_samp(r) AS s2 FROM d WHERE split = 'train')
  SELECT case_id, (error_m - m1) / s1 AS z_error, coalesce((r - m2) / s2, 0) AS z_ratio FROM d, s""")
def standardise(spark: SparkSession, sf: str) -> DataFrame:
    d = B.cases(spark, sf).withColumn("r", F.when(F.col("spread_m") > 5, F.col("p_b")))
    return SU.standardise(d, ["error_m", "r"]).select("case_id", F.col("vector")[0].alias("z_error"), F.col("vector")[1].alias("z_ratio"))


@query("spread_skill", ctes=B.LABELLED, doubles="rmse_m spread_m spread_skill_ratio corr_spread_error", sql="""
  SELECT lead_day, sqrt(avg(error_m * error_m)) AS rmse_m, sqrt(avg(spread_m * spread_m)) AS spread_m,
         sqrt(51e0 / 50 * avg(spread_m * spread_m)) / sqrt(avg(error_m * error_m)) AS spread_skill_ratio, corr(spread_m, error_m) AS corr_spread_error
  FROM labelled WHERE split = 'test' GROUP BY lead_day""")
def spread_skill(spark: SparkSession, sf: str) -> DataFrame:
    return E.spread_skill(B.labelled(spark, sf).where("split = 'test'"), 50)


@query("rank_histogram", ctes=_WITH_CLIM, sql="""
  WITH r AS (SELECT init_time, lead_day, m.cell, CASE WHEN max(ref_value) IS NOT NULL THEN count(*) FILTER (value < ref_value) END AS k, count(value) AS size
             FROM members m LEFT JOIN reference r ON r.valid_time = m.valid_time AND r.cell = m.cell GROUP BY ALL)
  SELECT d.lead_day, CAST(d.rank AS INTEGER) AS rank, count(r.k) AS n FROM (SELECT lead_day, unnest(range(0, top + 1)) AS rank FROM (SELECT lead_day, max(size) AS top FROM r GROUP BY lead_day)) d
  LEFT JOIN r ON r.lead_day = d.lead_day AND r.k = d.rank GROUP BY ALL""")
def rank_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return E.rank_histogram(member_stats(spark, sf))


@query("signature_frequencies", ctes=B.LABELLED_TIES, doubles="share", sql="""
  SELECT split, sig_class, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY split) AS share
  FROM labelled WHERE bust = 1 GROUP BY split, sig_class""")
def signature_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return SU.value_shares(B.labelled(spark, sf).where("bust = 1"), "sig_class", ["split"])


@query("lead_summary", ctes=B.CASES, doubles="mean_p max_p", sql="""
  SELECT init_time, lead_day, avg(p_a) AS mean_p, max(p_a) AS max_p, count(*) FILTER (p_a >= 0.5) AS n_alerts FROM cases GROUP BY ALL""")
def lead_summary(spark: SparkSession, sf: str) -> DataFrame:
    return SU.lead_summary(B.cases(spark, sf), "p_a", B.ALERT)


@query("region_overview", ctes=B.TRAJECTORIES, doubles="peak_p", sql="""
  SELECT init_time, region_id, CAST(arg_min(lead_day, struct_pack(a := -p_a, b := lead_day)) AS INTEGER) AS peak_day, max(p_a) AS peak_p,
         coalesce(array_to_string(list_sort(list(lead_day) FILTER (p_a >= 0.5)), ','), '') AS alert_days, min(lead_day) FILTER (p_a >= 0.5) AS first_alert_day
  FROM trajectories GROUP BY ALL""")
def region_overview(spark: SparkSession, sf: str) -> DataFrame:
    return SU.region_overview(B.trajectories(spark, sf), "p_a", B.ALERT)


@query("trajectory", ctes=B.TRAJECTORIES, doubles="p", sql="""
  SELECT init_time, region_id, CAST(row_number() OVER (PARTITION BY init_time, region_id ORDER BY lead_day) - 1 AS INTEGER) AS step, p_a AS p FROM trajectories""")
def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    t = SU.trajectory(B.trajectories(spark, sf), "p_a")
    return t.select("init_time", "region_id", F.posexplode("trajectory").alias("step", "p"))


@query("case_summary", ctes=B.LABELLED, doubles="jaccard", sql="""
  SELECT init_time, count(*) FILTER (p_a >= 0.5) AS alerts, count(*) FILTER (p_a >= 0.5 AND bust = 1) AS hits, count(*) FILTER (bust = 1) AS busts,
         count(*) FILTER (hidden_bust = 1) AS hidden_busts, count(*) FILTER (p_a >= 0.5 AND bust = 1) / greatest(count(*) FILTER (p_a >= 0.5 OR bust = 1), 1) AS jaccard
  FROM labelled GROUP BY init_time""")
def case_summary(spark: SparkSession, sf: str) -> DataFrame:
    return SU.case_summary(B.labelled(spark, sf), F.col("p_a") >= B.ALERT)


@query("param_stability", ctes=B.LABELLED, doubles="p05 p50 p95", sql="""
  SELECT lead_day, quantile_cont(q_primary, 0.05) AS p05, quantile_cont(q_primary, 0.5) AS p50, quantile_cont(q_primary, 0.95) AS p95
  FROM thresholds GROUP BY lead_day""")
def param_stability(spark: SparkSession, sf: str) -> DataFrame:
    th = L.fit_thresholds(B.labelled(spark, sf))
    return O.grouped_quantiles(th, ["lead_day"], "q_primary", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


@query("feature_profile", ctes=B.LABELLED, doubles="missing_share std", sql="""
  WITH long AS (
    SELECT split, 'spread_m' AS feature, spread_m AS v FROM labelled UNION ALL SELECT split, 'spread_thr_ratio', spread_thr_ratio FROM labelled
    UNION ALL SELECT split, 'part', CASE WHEN spread_m > 20 THEN p_b END FROM labelled)
  SELECT split, feature, avg(CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END) AS missing_share, stddev_pop(v) AS std,
         count(DISTINCT CASE WHEN feature = 'spread_thr_ratio' THEN round(v, 6) ELSE v END) AS n_unique
  FROM long GROUP BY split, feature""")
def feature_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = B.labelled(spark, sf).withColumn("part", F.when(F.col("spread_m") > 20, F.col("p_b")))
    p = SU.feature_profile(d, ["spread_m", "part"])
    r = SU.feature_profile(d.withColumn("spread_thr_ratio", F.round("spread_thr_ratio", 6)), ["spread_thr_ratio"])
    exact = SU.feature_profile(d, ["spread_thr_ratio"]).drop("n_unique").join(r.select("split", "feature", "n_unique"), ["split", "feature"])
    return p.unionByName(exact)


@query("physics_corr", ctes=B.GRID, doubles="corr_z_u corr_z_mslp z_min z_max", sql="""
  SELECT lead_day, corr(z, u) AS corr_z_u, corr(z, mslp) AS corr_z_mslp, min(z) AS z_min, max(z) AS z_max FROM grid GROUP BY lead_day""")
def physics_corr(spark: SparkSession, sf: str) -> DataFrame:
    return B.grid(spark, sf).groupBy("lead_day").agg(F.corr("z", "u").alias("corr_z_u"), F.corr("z", "mslp").alias("corr_z_mslp"),
                                                     F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@query("prevalence", ctes=B.LABELLED, doubles="bust_rate hidden_rate low_spread_share hidden_share_of_busts bust_rate_low_spread bust_rate_other", sql="""
  SELECT split, count(*) AS n_rows, avg(bust) AS bust_rate, avg(hidden_bust) AS hidden_rate, avg(low_spread) AS low_spread_share,
         sum(hidden_bust) / sum(bust) AS hidden_share_of_busts, avg(bust) FILTER (low_spread = 1) AS bust_rate_low_spread,
         avg(bust) FILTER (low_spread = 0) AS bust_rate_other FROM labelled GROUP BY split""")
def prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return SU.prevalence(B.labelled(spark, sf))
