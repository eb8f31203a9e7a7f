"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.operators import labels as L
from windrose.operators import quality as Q
from windrose.plans import bridge as B
from windrose.plans.registry import query
from windrose.sources.scans import scan_reduced


@query("dq_contract", ctes=B.MEMBERS, sql="""
  SELECT 'units' AS check, 'gpm' AS detail
  UNION ALL SELECT 'members', CAST(count(DISTINCT member) AS VARCHAR) FROM members HAVING count(DISTINCT member) < 100000""")
def dq_contract(spark: SparkSession, sf: str) -> DataFrame:
    return Q.forecast_contract(B.members(spark, sf), "gpm", min_members=100000)


@query("dq_extras", ctes=B.MEMBERS + "," + B.REFERENCE, sql="""
  WITH e AS (SELECT valid_time, cell, avg(u) AS u_mean, stddev_samp(u) AS u_std, avg(mslp) AS mslp_mean, count(*) AS n FROM members GROUP BY ALL)
  SELECT coalesce(e.valid_time, r.valid_time) AS valid_time, coalesce(e.cell, r.cell) AS cell,
    CASE WHEN e.cell IS NULL THEN 'missing' WHEN r.cell IS NULL THEN 'orphan' ELSE p END AS problems
  FROM (SELECT *, concat_ws('; ', CASE WHEN u_mean < -10 OR u_mean > 10 THEN 'u_mean: range' END, CASE WHEN u_std IS NULL THEN 'u_std: missing' END,
               CASE WHEN mslp_mean < 85000 OR mslp_mean > 110000 THEN 'mslp_mean: range' END, CASE WHEN n < 10 THEN 'n_members' END) AS p FROM e) e
  FULL JOIN reference r ON r.valid_time = e.valid_time AND r.cell = e.cell
  WHERE e.cell IS NULL OR r.cell IS NULL OR p <> ''""")
def dq_extras(spark: SparkSession, sf: str) -> DataFrame:
    e = scan_reduced(B.members(spark, sf), ["valid_time", "cell"], ["u", "mslp"])
    ranges = {"u_mean": (-10.0, 10.0), "u_std": (0.0, 60.0), "mslp_mean": (85000.0, 110000.0)}
    return Q.extras_integrity(e, B.reference(spark, sf), ["valid_time", "cell"], ranges, 10)


@query("dq_retrieval", ctes=B.MEMBERS, doubles="missing_share", sql="""
  SELECT 1 AS members_present, 1 AS leads_complete, 1 AS domain_covered, 1 AS longitude_range, CAST(avg(value) BETWEEN 10 AND 90 AS INTEGER) AS plausible_mean,
         CAST(stddev_samp(value) >= 0 AS INTEGER) AS spread_computed, CAST(avg(value) BETWEEN 10 AND 90 AND stddev_samp(value) >= 0 AS INTEGER) AS all_passed,
         0e0 AS missing_share FROM members""")
def dq_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return Q.retrieval_checks(B.members(spark, sf), range(1, 8), {"lat_min": -10, "lat_max": 10, "lon_min": 60, "lon_max": 80}, 5.0, (10.0, 90.0))


@query("dq_labels", ctes=B.LABELLED, doubles="max_threshold_diff", sql="""
  SELECT count(*) AS n_rows, count(*) FILTER (coalesce(norm_error > q_primary, false) <> (bust = 1)) AS bad_bust, 0e0 AS max_threshold_diff,
         count(*) FILTER (valid_time <> init_time + INTERVAL 1 DAY * lead_day) AS bad_valid_time,
         count(*) FILTER (split = 'train' AND valid_time > TIMESTAMP '2024-01-16') AS late_train_rows, count(*) FILTER (hidden_bust <> bust * low_spread) AS bad_hidden FROM labelled""")
def dq_labels(spark: SparkSession, sf: str) -> DataFrame:
    lab = B.labelled(spark, sf)
    return Q.label_integrity(lab, L.fit_thresholds(lab), B.TRAIN_END)


@query("dq_parity", ctes=B.LABELLED, doubles="max_abs_diff", sql="""
  SELECT split, count(*) AS n_rows, max(abs(p_a - round(p_a, 1))) AS max_abs_diff FROM labelled GROUP BY split""")
def dq_parity(spark: SparkSession, sf: str) -> DataFrame:
    lab = B.labelled(spark, sf)
    return Q.prediction_parity(lab.select("case_id", "split", "p_a"), lab.select("case_id", F.round("p_a", 1).alias("p_a")), "p_a", ["split"])


@query("dq_fitted_on", ctes=B.LABELLED, doubles="scale_m", sql="SELECT region_id, season, scale_m FROM scale")
def dq_fitted_on(spark: SparkSession, sf: str) -> DataFrame:
    scale = L.fit_normalisation(B.cases(spark, sf), "bias_m", ("init_time", "lead_day", "case_id"))
    return Q.require_fitted_on(scale, "train").drop("fitted_on")


_FAULTY = B.LABELLED + """,
faulty AS (SELECT * REPLACE (CASE WHEN case_id % 7 = 0 THEN 1 - bust ELSE bust END AS bust, CASE WHEN case_id % 13 = 0 THEN q_primary + 0.25 ELSE q_primary END AS q_primary,
  CASE WHEN case_id % 11 = 0 THEN valid_time + INTERVAL 1 HOUR ELSE valid_time END AS valid_time) FROM labelled)"""


@query("dq_labels_faults", ctes=_FAULTY, doubles="max_threshold_diff", sql="""
  SELECT count(*) AS n_rows, count(*) FILTER (coalesce(f.norm_error > f.q_primary, false) <> (f.bust = 1)) AS bad_bust,
         max(abs(f.q_primary - l.q_primary)) AS max_threshold_diff, count(*) FILTER (f.valid_time <> f.init_time + INTERVAL 1 DAY * f.lead_day) AS bad_valid_time,
         count(*) FILTER (f.split = 'train' AND f.valid_time > TIMESTAMP '2024-01-16') AS late_train_rows,
         count(*) FILTER (f.hidden_bust <> f.bust * f.low_spread) AS bad_hidden FROM faulty f JOIN labelled l USING (case_id)""")
def dq_labels_faults(spark: SparkSession, sf: str) -> DataFrame:
    """The label audit on rows with faults: flipped labels, shifted thresholds and valid times."""
    lab = B.labelled(spark, sf)
    hit = lambda m: F.col("case_id") % m == 0                        # noqa: E731
    faulty = lab.withColumns({"bust": F.when(hit(7), 1 - F.col("bust")).otherwise(F.col("bust")),
                              "q_primary": F.when(hit(13), F.col("q_primary") + 0.25).otherwise(F.col("q_primary")),
                              "valid_time": F.when(hit(11), F.col("valid_time") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("valid_time"))})
    return Q.label_integrity(faulty, L.fit_thresholds(lab), B.TRAIN_END)
