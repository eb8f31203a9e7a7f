"""Mixture-model, quantile-family and calibration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.evaluation import ranking as R
from windrose.evaluation import scores as SC
from windrose.functions import probability as P
from windrose.models import bma as M
from windrose.models import calibration as CA
from windrose.operators import quality as Q
from windrose.plans import bridge as B
from windrose.plans.evaluation import AUPRC, cum
from windrose.plans.registry import query
from windrose.session import scratch_path, stored_once

KEYS = ["init_time", "lead_day", "valid_time", "cell"]

ANOM = B.MEMBERS + "," + B.REFERENCE + "," + B.CLIMATOLOGY + """,
anom AS (SELECT m.init_time, m.lead_day, m.valid_time, m.cell, m.value - c.clim_value AS f, c.clim_value FROM members m
         JOIN climatology c ON c.month_n = month(m.valid_time) AND c.cell = m.cell)"""


def anomalies_plan(spark: SparkSession, sf: str) -> DataFrame:
    m = B.members(spark, sf).withColumn("month_n", F.month("valid_time"))
    clim = B.climatology(spark, sf).select("month_n", "cell", "clim_value")
    return M.member_anomalies(m, clim, KEYS, ["month_n", "cell"])


anomalies_plan.partition_by = None
anomalies = B.stored(anomalies_plan)          # one array per cell forecast, written once and read by every fit and score


@query("member_anomalies", ctes=ANOM, doubles="mean_anom lowest highest", sql="""
  SELECT init_time, lead_day, cell, avg(f) AS mean_anom, min(f) AS lowest, max(f) AS highest, count(*) AS n_members FROM anom GROUP BY ALL""")
def member_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    states = B.members(spark, sf).groupBy(*KEYS).agg(F.avg("value").alias("z"))
    a = M.check_member_mean(anomalies(spark, sf), states, KEYS, "z")
    return a.select("init_time", "lead_day", "cell", "mean_anom", F.array_min("members").alias("lowest"),
                    F.array_max("members").alias("highest"), F.size("members").cast("long").alias("n_members"))


def verifying_plan(spark: SparkSession, sf: str) -> DataFrame:
    return B.reference(spark, sf)


verifying_plan.partition_by = None
verifying = B.stored(verifying_plan)          # one value per month and cell


def verified(spark: SparkSession, sf: str) -> DataFrame:
    """Member anomalies with the verifying anomaly y."""
    a = anomalies(spark, sf).join(verifying(spark, sf), ["valid_time", "cell"])
    return a.withColumn("y", F.col("ref_value") - F.col("clim_value"))


_PAIRS = """
pairs AS (SELECT a.cell, a.lead_day, a.init_time, a.valid_time, a.f, r.ref_value - a.clim_value AS y FROM anom a
          JOIN reference r ON r.valid_time = a.valid_time AND r.cell = a.cell),
sets AS (SELECT cell, lead_day, count(*) AS n_cases, max(valid_time) AS last_verified FROM (SELECT DISTINCT cell, lead_day, init_time, valid_time FROM pairs) GROUP BY ALL),
line AS (SELECT cell, lead_day, regr_slope(y, f) AS b, avg(f) AS fbar FROM pairs GROUP BY ALL),
ybar AS (SELECT cell, lead_day, avg(y) AS ybar FROM (SELECT cell, lead_day, init_time, valid_time, any_value(y) AS y FROM pairs GROUP BY ALL) GROUP BY ALL)"""
# the pooled line is weighted by members, the intercept uses the mean of the cases; sigma solves its own fixed point
_FIT = """
  SELECT s.cell, s.lead_day, s.n_cases, s.last_verified, o.b, o.a, true AS sigma_is_fixed_point FROM sets s JOIN (
    SELECT l.cell, l.lead_day, l.b, y.ybar - l.b * l.fbar AS a FROM (
      SELECT p.cell, p.lead_day, any_value(l.fbar) AS fbar, sum((p.f - l.fbar) * (p.y - y.ybar)) / sum((p.f - l.fbar) * (p.f - l.fbar)) AS b
      FROM pairs p JOIN line l ON l.cell = p.cell AND l.lead_day = p.lead_day JOIN ybar y ON y.cell = p.cell AND y.lead_day = p.lead_day GROUP BY ALL) l
    JOIN ybar y ON y.cell = l.cell AND y.lead_day = l.lead_day) o ON o.cell = s.cell AND o.lead_day = s.lead_day WHERE s.n_cases >= 20"""


def checked_fit(v: DataFrame, group_rows: int) -> DataFrame:
    """a, b and whether one more EM step leaves sigma where it is."""
    fit = stored_once(M.fit_exchangeable(v, ["cell", "lead_day"], min_cases=20, group_rows=group_rows), "bma-fit")
    share = M.em_share("members", "y", "a", "b", F.col("sigma") * F.col("sigma"))
    again = (v.join(fit, ["cell", "lead_day"]).select("cell", "lead_day", "sigma", share.alias("_share"))
             .groupBy("cell", "lead_day").agg(F.avg("_share").alias("_s2"), F.first("sigma").alias("_s")))
    ok = again.select("cell", "lead_day", (F.abs(F.sqrt("_s2") - F.col("_s")) < 2e-3 * F.col("_s")).alias("sigma_is_fixed_point"))
    return fit.join(ok, ["cell", "lead_day"]).select("cell", "lead_day", "n_cases", "last_verified", "b", "a", "sigma_is_fixed_point")


@query("bma_fit", ctes=ANOM + "," + _PAIRS, doubles="a b", sql=_FIT)
def bma_fit(spark: SparkSession, sf: str) -> DataFrame:
    return checked_fit(verified(spark, sf), M.GROUP_ROWS)


@query("bma_fit_spread", ctes=ANOM + "," + _PAIRS, doubles="a b", sql=_FIT)
def bma_fit_spread(spark: SparkSession, sf: str) -> DataFrame:
    """The same groups, those above 60 cases by the distributed plan."""
    return checked_fit(verified(spark, sf), 60)


WINDOW = 730


def _rolling_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly refits on the cases verified in the trailing two years."""
    v = verified(spark, sf)
    return M.rolling_fit(v, ["cell", "lead_day"], v.select(F.to_date("init_time").alias("fit_day")), WINDOW)


rolling_params = B.memo(_rolling_plan)


_FITS = """
fits AS (SELECT f.fit_day, s.cell, s.lead_day, count(*) AS n_cases, max(s.valid_time) AS last_verified FROM (SELECT DISTINCT init_time AS fit_day FROM members
           WHERE init_time IN (SELECT m.init_time FROM members m JOIN reference r ON r.valid_time = m.valid_time AND r.cell = m.cell)) f
    JOIN (SELECT DISTINCT a.init_time, a.lead_day, a.cell, a.valid_time FROM anom a JOIN reference r ON r.valid_time = a.valid_time AND r.cell = a.cell) s
    ON s.valid_time <= f.fit_day AND s.valid_time > f.fit_day - INTERVAL 730 DAY GROUP BY ALL HAVING count(*) >= 20)"""


@query("bma_rolling")
def bma_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return rolling_params(spark, sf).select("fit_day", "cell", "lead_day", "n_cases", "last_verified", "a", "b", "sigma")


@query("bma_rolling_check", ctes=ANOM + "," + _FITS, sql="""
  SELECT CAST(fit_day AS DATE) AS fit_day, cell, lead_day, n_cases, last_verified, true AS sigma_is_positive FROM fits""")
def bma_rolling_check(spark: SparkSession, sf: str) -> DataFrame:
    return rolling_params(spark, sf).select("fit_day", "cell", "lead_day", "n_cases", "last_verified", (F.col("sigma") > 0).alias("sigma_is_positive"))


@query("bma_causality", ctes=ANOM, sql="""
  SELECT count(*) AS n_fits, count(*) FILTER (last > fit_day) AS n_violations FROM (
    SELECT f.fit_day, s.cell, s.lead_day, max(s.valid_time) AS last FROM (SELECT DISTINCT init_time AS fit_day FROM members
           WHERE init_time IN (SELECT m.init_time FROM members m JOIN reference r ON r.valid_time = m.valid_time AND r.cell = m.cell)) f
    JOIN (SELECT DISTINCT a.init_time, a.lead_day, a.cell, a.valid_time FROM anom a JOIN reference r ON r.valid_time = a.valid_time AND r.cell = a.cell) s
    ON s.valid_time <= f.fit_day AND s.valid_time > f.fit_day - INTERVAL 730 DAY GROUP BY ALL HAVING count(*) >= 20)""")
def bma_causality(spark: SparkSession, sf: str) -> DataFrame:
    return Q.fit_causality(rolling_params(spark, sf))


_WEIGHTS = """
  SELECT s.cell, s.lead_day, s.n_cases AS n, CAST(m.k AS INTEGER) AS k, true AS weights_sum_to_one, true AS in_range FROM sets s JOIN (
    SELECT cell, lead_day, max(c) AS k FROM (SELECT cell, lead_day, init_time, valid_time, count(*) AS c FROM pairs GROUP BY ALL) GROUP BY ALL) m
  ON m.cell = s.cell AND m.lead_day = s.lead_day"""


def checked_weights(v: DataFrame, group_rows: int) -> DataFrame:
    w = M.free_weights(v, ["cell", "lead_day"], None, seed=0, group_rows=group_rows)
    return w.select("cell", "lead_day", "n", "k", (F.abs(F.col("w_sum") - 1) < 1e-9).alias("weights_sum_to_one"),
                    ((F.col("w_min") >= 0) & (F.col("w_max") <= 1) & (F.col("w_min") * F.col("k") <= 1 + 1e-9) & (F.col("sigma") > 0)).alias("in_range"))


@query("bma_free_weights")
def bma_free_weights(spark: SparkSession, sf: str) -> DataFrame:
    return M.free_weights(verified(spark, sf), ["cell", "lead_day"], None, seed=0)


@query("bma_free_weights_check", ctes=ANOM + "," + _PAIRS, sql=_WEIGHTS)
def bma_free_weights_check(spark: SparkSession, sf: str) -> DataFrame:
    return checked_weights(verified(spark, sf), M.GROUP_ROWS)


MIX = ANOM + """,
cellmean AS (SELECT init_time, lead_day, cell, avg(f) AS m FROM anom GROUP BY ALL),
sig AS (SELECT lead_day, stddev_samp(m) AS sigma FROM cellmean GROUP BY lead_day),
mix AS (SELECT a.init_time, a.lead_day, a.cell, 0.5e0 + 0.9e0 * a.f AS mu, c.m, s.sigma, 8e0 AS scale, 1.2e0 AS c
        FROM anom a JOIN cellmean c ON c.init_time = a.init_time AND c.lead_day = a.lead_day AND c.cell = a.cell JOIN sig s ON s.lead_day = a.lead_day)"""


def mixture(spark: SparkSession, sf: str) -> DataFrame:
    a = anomalies(spark, sf)
    sigma = a.groupBy("lead_day").agg(F.stddev_samp("mean_anom").alias("sigma"))
    return M.with_mixture(a.join(sigma, "lead_day").withColumns({"a": F.lit(0.5), "b": F.lit(0.9), "scale": F.lit(8.0), "c": F.lit(1.2)}))


@query("bma_exceedance", ctes=MIX, doubles="p_exceed", sql=f"""
  SELECT init_time, lead_day, cell, least(1e0, greatest(0e0, 1 - (avg({P.norm_cdf_sql('hi')}) - avg({P.norm_cdf_sql('lo')})))) AS p_exceed FROM (
    SELECT *, (m + c * scale - mu) / sigma AS hi, (m - c * scale - mu) / sigma AS lo FROM mix) GROUP BY ALL""")
def bma_exceedance(spark: SparkSession, sf: str) -> DataFrame:
    return M.exceedance(mixture(spark, sf), "c", "mean_anom", "scale").select("init_time", "lead_day", "cell", "p_exceed")


@query("bma_moments", ctes=MIX, doubles="bma_mean bma_std", sql=f"""
  WITH t AS (SELECT *, (mu - m) / sigma AS z, -(mu - m) / sigma AS zn FROM mix),
  g AS (SELECT init_time, lead_day, cell, avg(sigma * (sqrt(2 / pi()) * exp(-z * z / 2) + z * (1 - 2 * {P.norm_cdf_sql('zn')}))) / any_value(scale) AS bma_mean,
         avg((mu - m) * (mu - m) + sigma * sigma) / pow(any_value(scale), 2) AS second FROM t GROUP BY ALL)
  SELECT init_time, lead_day, cell, bma_mean, sqrt(greatest(second - bma_mean * bma_mean, 0)) AS bma_std FROM g""")
def bma_moments(spark: SparkSession, sf: str) -> DataFrame:
    return M.moments(mixture(spark, sf), "mean_anom", "scale").select("init_time", "lead_day", "cell", "bma_mean", "bma_std")


@query("bma_quantiles")
def bma_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    m = mixture(spark, sf).select("init_time", "lead_day", "cell", "mu", "sigma", "mean_anom", "scale")
    q = M.quantiles(m, "mean_anom", "scale")
    return q.select("init_time", "lead_day", "cell", *(F.col("bma_q")[i].alias(c) for i, c in enumerate(C.QUANTILE_COLUMNS)))


@query("bma_quantiles_check", ctes=MIX, sql="""
  SELECT DISTINCT init_time, lead_day, cell, CAST(i AS INTEGER) AS i, true AS cdf_is_level FROM mix, range(6) t(i)""")
def bma_quantiles_check(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture's distribution function at every returned quantile is the quantile's level."""
    m = mixture(spark, sf).select("init_time", "lead_day", "cell", "mu", "sigma", "mean_anom", "scale")
    keys, level = ["init_time", "lead_day", "cell", "i"], F.element_at(F.array(*map(F.lit, C.QUANTILE_LEVELS)), F.col("i") + 1)
    # a row per member and level: an ensemble is never copied whole, and the sums are combined on the map side
    q = M.quantiles(m, "mean_anom", "scale").withColumn("mu", F.explode("mu")).select("*", F.posexplode("bma_q").alias("i", "q"))
    gap, reach = F.col("mean_anom") - F.col("mu"), F.col("q") * F.col("scale")
    at = q.select(*keys, ((gap + reach) / F.col("sigma")).alias("hi"), ((gap - reach) / F.col("sigma")).alias("lo"))
    cdf = at.groupBy(*keys).agg((F.avg(P.norm_cdf(F.col("hi"))) - F.avg(P.norm_cdf(F.col("lo")))).alias("p"))
    return cdf.select(*keys, (F.abs(F.col("p") - level) < 1e-6).alias("cdf_is_level"))


@query("bma_predict")
def bma_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = anomalies(spark, sf).withColumns({"scale": F.lit(8.0), "c": F.lit(1.2)})
    p = M.predict(rows, rolling_params(spark, sf), ["cell", "lead_day"], "c", "mean_anom", "scale")
    return p.select("init_time", "lead_day", "cell", "n_cases", "bma_exceedance", "bma_mean", "bma_std", *(F.col("bma_q")[i].alias(c) for i, c in enumerate(C.QUANTILE_COLUMNS)))


def calibrated_model(spark: SparkSession, sf: str) -> M.BmaModel:
    """The rolling fits, calibrated on the verified forecasts of the years before 1998."""
    model = M.BmaModel(rolling_params(spark, sf), ["cell", "lead_day"], {"window_days": WINDOW, "min_cases": 20})
    return model.calibrate(outcomes(spark, sf).where("init_time < '1998-01-01'"), "bust", "c", "mean_anom", "scale")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Verified forecasts with whether the mean missed by more than the threshold."""
    v = verified(spark, sf).withColumns({"scale": F.lit(8.0), "c": F.lit(1.2)})
    return v.withColumn("bust", (F.abs(F.col("y") - F.col("mean_anom")) > F.col("c") * F.col("scale")).cast("int"))


@query("bma_calibrated")
def bma_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """Save, load and score: raw and calibrated exceedance kept apart."""
    path = scratch_path(spark, "bma")
    calibrated_model(spark, sf).save(path)
    p = M.BmaModel.load(spark, path).predict(outcomes(spark, sf).where("init_time >= '1998-01-01'"), "c", "mean_anom", "scale")
    return p.select("init_time", "lead_day", "cell", "bust", "bma_exceedance", "bma_probability")


@query("bma_predict_check", ctes=ANOM + "," + _FITS, sql="""
  SELECT a.init_time, a.lead_day, a.cell, f.n_cases, CASE WHEN f.n_cases IS NOT NULL THEN true END AS in_range
  FROM (SELECT DISTINCT init_time, lead_day, cell FROM anom) a LEFT JOIN fits f ON f.fit_day = a.init_time AND f.cell = a.cell AND f.lead_day = a.lead_day""")
def bma_predict_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = anomalies(spark, sf).withColumns({"scale": F.lit(8.0), "c": F.lit(1.2)})
    p = M.predict(rows, rolling_params(spark, sf), ["cell", "lead_day"], "c", "mean_anom", "scale")
    ok = F.col("bma_exceedance").between(0, 1) & (F.col("bma_mean") >= 0) & (F.col("bma_std") >= 0) & (F.col("bma_q") == F.array_sort("bma_q"))
    return p.select("init_time", "lead_day", "cell", "n_cases", F.when(F.col("n_cases").isNotNull(), F.coalesce(ok, F.lit(False))).alias("in_range"))


# --- quantile family ---------------------------------------------------------------------------------------------------

_RAW = """SELECT case_id, [p_a, p_b * 1.1, p_a + 0.2, p_b + 0.4, p_a * 1.5 + 0.3, p_b + 0.9] AS raw, 0.7e0 AS thr, norm_error, bust FROM labelled"""


def raw_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("p_a"), F.col("p_b")
    return B.labelled(spark, sf).select("case_id", F.array(a, b * 1.1, a + 0.2, b + 0.4, a * 1.5 + 0.3, b + 0.9).alias("raw"),
                                        F.lit(0.7).alias("thr"), "norm_error", "bust")


QN = ("q10", "q25", "q50", "q75", "q90", "q95")


@query("rearrange_quantiles", ctes=B.LABELLED, doubles=" ".join(QN), sql="SELECT case_id, " + ", ".join(f"q[{i + 1}] AS {n}" for i, n in enumerate(QN))
       + f" FROM (SELECT case_id, list_sort(raw) AS q FROM ({_RAW}))")
def rearrange_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = raw_quantiles(spark, sf).withColumn("q", F.array_sort("raw"))
    return q.select("case_id", *[F.col("q")[i].alias(n) for i, n in enumerate(QN)])


@query("crossing_stats", ctes=B.LABELLED, doubles="share_rows_crossing max_violation", sql=f"""
  SELECT count(*) AS n_rows, count(*) FILTER (n > 0) AS rows_crossing, avg(CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END) AS share_rows_crossing, max(v) AS max_violation FROM (
    SELECT len([i FOR i IN range(1, 6) IF raw[i] > raw[i + 1]]) AS n, greatest(0, list_max([raw[i] - raw[i + 1] FOR i IN range(1, 6)])) AS v FROM ({_RAW}))""")
def crossing_stats(spark: SparkSession, sf: str) -> DataFrame:
    n, v = P.crossing_columns(F.col("raw"))
    q = raw_quantiles(spark, sf).select(n.alias("n"), v.alias("v"))
    return q.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("n") > 0, 1)).alias("rows_crossing"),
                 F.avg((F.col("n") > 0).cast("double")).alias("share_rows_crossing"), F.max("v").alias("max_violation"))


@query("exceedance_from_quantiles", ctes=B.LABELLED, doubles="p_exceed", sql=f"""
  WITH s AS (SELECT case_id, list_sort(raw) AS q, thr FROM ({_RAW})),
  i AS (SELECT *, len([x FOR x IN q IF x <= thr]) AS k, [0.10e0, 0.25e0, 0.50e0, 0.75e0, 0.90e0, 0.95e0] AS lv FROM s)
  SELECT case_id, least(1e0, greatest(0e0, 1 - CASE
    WHEN k = 0 THEN 0.1 * exp(-(q[1] - thr) / (greatest(q[2] - q[1], 1e-6) / ln(0.25e0 / 0.10e0)))
    WHEN k = 6 THEN 1 - 0.05 * exp(-(thr - q[6]) / (greatest(q[6] - q[5], 1e-6) / ln((1 - 0.90e0) / (1 - 0.95e0))))
    ELSE lv[k] + (thr - q[k]) / greatest(q[k + 1] - q[k], 1e-6) * (lv[k + 1] - lv[k]) END)) AS p_exceed FROM i""")
def exceedance_from_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = raw_quantiles(spark, sf)
    return q.select("case_id", P.exceedance_from_quantiles(F.array_sort("raw"), F.col("thr")).alias("p_exceed"))


# --- calibration -------------------------------------------------------------------------------------------------------------

def iso(name: str, source: str, by: str) -> str:
    """SQL: isotonic fit by the max-min formula over distinct scores (few), per fold."""
    return f"""{name}_d AS (SELECT {by} AS fold, p_a AS s, sum(bust) AS sy, count(*) AS w, row_number() OVER (PARTITION BY {by} ORDER BY p_a) AS i FROM {source} GROUP BY 1, 2),
    {name}_c AS (SELECT *, sum(sy) OVER (PARTITION BY fold ORDER BY i) AS cy, sum(w) OVER (PARTITION BY fold ORDER BY i) AS cw FROM {name}_d),
    {name}_m AS (SELECT x.fold, x.i AS j, z.i AS e, (z.cy - x.cy + x.sy) / (z.cw - x.cw + x.w) AS v FROM {name}_c x JOIN {name}_c z ON z.fold = x.fold AND z.i >= x.i),
    {name}_n AS (SELECT fold, j, e, min(v) OVER (PARTITION BY fold, j ORDER BY e DESC) AS mn FROM {name}_m),
    {name} AS (SELECT d.fold, d.s, max(n.mn) AS y FROM {name}_d d JOIN {name}_n n ON n.fold = d.fold AND n.j <= d.i AND n.e = d.i GROUP BY d.fold, d.s)"""


@query("isotonic_calibrate", ctes=B.LABELLED + "," + iso("fit", "(SELECT * FROM labelled WHERE split = 'validation')", "0"), doubles="p_cal", sql="""
  SELECT l.case_id, coalesce(e.y, CASE WHEN lo.s IS NULL THEN hi.y WHEN hi.s IS NULL THEN lo.y ELSE lo.y + (l.p_a - lo.s) * (hi.y - lo.y) / (hi.s - lo.s) END) AS p_cal
  FROM (SELECT * FROM labelled WHERE split = 'test') l LEFT JOIN fit e ON e.s = l.p_a
  ASOF LEFT JOIN fit lo ON l.p_a >= lo.s ASOF LEFT JOIN fit hi ON l.p_a <= hi.s""")
def isotonic_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    lab = B.labelled(spark, sf)
    fit = CA.fit_isotonic(lab.where("split = 'validation'"), "p_a", "bust")
    return CA.calibrate(lab.where("split = 'test'"), fit, "p_a", "p_cal").select("case_id", "p_cal")


@query("cross_calibrate", ctes=B.LABELLED + ", va AS (SELECT *, CAST(day(init_time) % 2 AS INTEGER) AS f FROM labelled WHERE split = 'validation')," + iso("fit", "va", "f"), doubles="p_cal", sql="""
  SELECT l.case_id, coalesce(e.y, CASE WHEN lo.s IS NULL THEN hi.y WHEN hi.s IS NULL THEN lo.y ELSE lo.y + (l.p_a - lo.s) * (hi.y - lo.y) / (hi.s - lo.s) END) AS p_cal
  FROM (SELECT *, 1 - f AS other FROM va) l LEFT JOIN fit e ON e.s = l.p_a AND e.fold = l.other
  ASOF LEFT JOIN fit lo ON lo.fold = l.other AND l.p_a >= lo.s ASOF LEFT JOIN fit hi ON hi.fold = l.other AND l.p_a <= hi.s""")
def cross_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    va = B.labelled(spark, sf).where("split = 'validation'")
    return CA.cross_calibrate(va, "p_a", "bust", F.dayofmonth("init_time") % 2).select("case_id", "p_cal")


_KNOTS = """knots AS (SELECT sig_class AS provider, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM (
  SELECT sig_class, lead_day / 10e0 AS x, sum(r) OVER (PARTITION BY sig_class ORDER BY lead_day) AS y FROM (
    SELECT sig_class, lead_day, avg(bust) AS r FROM labelled WHERE split = 'validation' AND sig_class IN ('click', 'view') GROUP BY ALL)) GROUP BY ALL)"""


@query("calibrator_lookup", ctes=B.LABELLED + "," + _KNOTS, doubles="p_cal", sql="""
  WITH j AS (SELECT l.case_id, l.p_a AS p, coalesce(k.xs, d.xs) AS xs, coalesce(k.ys, d.ys) AS ys, CAST(k.xs IS NOT NULL AS INTEGER) AS own_calibrator
    FROM labelled l LEFT JOIN knots k ON k.provider = l.sig_class, (SELECT xs, ys FROM knots WHERE provider = 'click') d),
  i AS (SELECT *, len([x FOR x IN xs IF x <= p]) AS n FROM j)
  SELECT case_id, CASE WHEN n = 0 THEN ys[1] WHEN n = len(xs) THEN ys[n] ELSE ys[n] + (p - xs[n]) * (ys[n + 1] - ys[n]) / (xs[n + 1] - xs[n]) END AS p_cal, own_calibrator FROM i""")
def calibrator_lookup(spark: SparkSession, sf: str) -> DataFrame:
    lab = B.labelled(spark, sf).withColumn("provider", F.col("sig_class"))
    rates = lab.where("split = 'validation' AND provider IN ('click', 'view')").groupBy("provider", "lead_day").agg(F.avg("bust").alias("r"))
    knots = rates.groupBy("provider").agg(F.sort_array(F.collect_list(F.struct("lead_day", "r"))).alias("k"))      # one knot per lead
    running = lambda i: F.aggregate(F.slice(F.col("k.r"), F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x)         # noqa: E731
    cal = knots.select("provider", F.lit("validation").alias("fitted_on"), F.transform("k", lambda e: e["lead_day"] / 10.0).alias("xs"),
                       F.transform("k", lambda e, i: running(i)).alias("ys"))
    return CA.resolve_calibrator(lab, cal, "p_a", "click").select("case_id", "p_cal", "own_calibrator")


@query("grid_select", ctes=B.LABELLED + """,
  cfg AS (SELECT f / 10e0 AS factor, l.* FROM labelled l, range(5, 13) t(f) WHERE split = 'validation'),
  """ + cum("hc", "cfg", by="factor", score="(spread_thr_ratio * pow(lead_day, factor - 1))"), doubles="factor pinball auprc", sql=f"""
  WITH r AS (SELECT factor, avg(CASE WHEN error_m >= q THEN 0.9e0 * (error_m - q) ELSE (0.9e0 - 1) * (error_m - q) END) AS pinball FROM (SELECT *, factor * 2 * spread_m AS q FROM cfg) GROUP BY factor),
  s AS (SELECT factor, {AUPRC} AS auprc FROM hc GROUP BY factor)
  SELECT factor, pinball, auprc FROM r JOIN s USING (factor) WHERE pinball <= 1.01 * (SELECT min(pinball) FROM r) ORDER BY auprc DESC, factor LIMIT 1""")
def grid_select(spark: SparkSession, sf: str) -> DataFrame:
    from windrose.models.selection import select_within_guardrail
    va = B.labelled(spark, sf).where("split = 'validation'")
    cfg = va.withColumn("factor", F.explode(F.array(*[F.lit(f / 10.0) for f in range(5, 13)])))
    cfg = cfg.withColumns({"q": F.col("factor") * 2 * F.col("spread_m"), "s": F.col("spread_thr_ratio") * F.pow("lead_day", F.col("factor") - 1)})
    runs = cfg.groupBy("factor").agg(SC.pinball(F.col("error_m"), F.col("q"), F.lit(0.9)).alias("pinball")).join(
        R.auprc(cfg, "bust", "s", ["factor"]), "factor")
    return select_within_guardrail(runs, "factor", "pinball", "auprc")
