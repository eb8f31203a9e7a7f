"""Window, stencil, ordering and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.evaluation import ranking as R
from windrose.operators import features as FE
from windrose.operators import grid as G
from windrose.operators import labels as L
from windrose.operators import recent as RE
from windrose.operators import stencils as ST
from windrose.plans import bridge as B
from windrose.plans.joins import N
from windrose.plans.registry import query
from windrose.products import selection as SEL

MAP, POS = FE.MAP, FE.POSITION
LEADS = (1, 7)


def previous_init():
    return F.add_months("init_time", -1).cast("timestamp")


@query("train_percentile", ctes=B.LABELLED, doubles="spread_pct", sql="""
  SELECT l.case_id, count(t.case_id) FILTER (t.spread_m <= l.spread_m) / nullif(count(t.case_id), 0) AS spread_pct
  FROM labelled l LEFT JOIN (SELECT * FROM labelled WHERE split = 'train') t
  ON t.region_id = l.region_id AND t.lead_day = l.lead_day AND t.season = l.season GROUP BY l.case_id""")
def train_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return L.spread_percentile(B.labelled(spark, sf)).select("case_id", "spread_pct")


_RECENT = """
  facts AS (SELECT region_id, valid_time, norm_error, bias_m, bust FROM labelled WHERE lead_day <= 3),
  inits AS (SELECT DISTINCT init_time FROM labelled), regs AS (SELECT DISTINCT region_id, row_n, col_n FROM labelled),
  own AS (SELECT i.init_time, r.region_id, r.row_n, r.col_n, avg(norm_error) AS rec_err, avg(bias_m) AS rec_bias, avg(bust) AS rec_bust_rate,
                 CAST(count(f.region_id) AS DOUBLE) AS rec_n
          FROM inits i CROSS JOIN regs r LEFT JOIN facts f ON f.region_id = r.region_id AND f.valid_time <= i.init_time
               AND f.valid_time > i.init_time - INTERVAL 5 DAY GROUP BY ALL),
  dom AS (SELECT i.init_time, avg(norm_error) AS rec_err_domain FROM inits i LEFT JOIN facts f ON f.valid_time <= i.init_time
               AND f.valid_time > i.init_time - INTERVAL 5 DAY GROUP BY ALL),
  nb AS (SELECT a.init_time, a.region_id, avg(b.rec_err) AS rec_err_nbhd FROM own a JOIN own b ON a.init_time = b.init_time
               AND abs(a.row_n - b.row_n) <= 1 AND abs(a.col_n - b.col_n) <= 1 GROUP BY ALL)"""


@B.memo
def recent(spark: SparkSession, sf: str) -> DataFrame:
    lab = B.labelled(spark, sf)
    regions = lab.select("region_id", "row_n", "col_n").distinct()
    return RE.recent_error_features(lab, regions, G.neighbours(regions, 1, "region_id"))


@query("recent_error", ctes=B.LABELLED + "," + _RECENT, doubles="rec_err rec_bias rec_bust_rate rec_n", sql="""
  SELECT init_time, region_id, rec_err, rec_bias, rec_bust_rate, rec_n FROM own
  WHERE (init_time, region_id) IN (SELECT (init_time, region_id) FROM labelled)""")
def recent_error(spark: SparkSession, sf: str) -> DataFrame:
    return recent(spark, sf).select("init_time", "region_id", "rec_err", "rec_bias", "rec_bust_rate", "rec_n")


@query("recent_error_nbhd", ctes=B.LABELLED + "," + _RECENT, doubles="rec_err_nbhd rec_err_domain", sql="""
  SELECT nb.init_time, region_id, rec_err_nbhd, rec_err_domain FROM nb JOIN dom USING (init_time)
  WHERE (nb.init_time, region_id) IN (SELECT (init_time, region_id) FROM labelled)""")
def recent_error_nbhd(spark: SparkSession, sf: str) -> DataFrame:
    return recent(spark, sf).select("init_time", "region_id", "rec_err_nbhd", "rec_err_domain")


# a cell's neighbours by self-join: the SQL form of the stencils
_NB = """
  FROM grid g LEFT JOIN grid e ON e.init_time = g.init_time AND e.lead_day = g.lead_day AND e.row_n = g.row_n AND e.col_n = g.col_n + 1
  LEFT JOIN grid w ON w.init_time = g.init_time AND w.lead_day = g.lead_day AND w.row_n = g.row_n AND w.col_n = g.col_n - 1
  LEFT JOIN grid n ON n.init_time = g.init_time AND n.lead_day = g.lead_day AND n.row_n = g.row_n + 1 AND n.col_n = g.col_n
  LEFT JOIN grid s ON s.init_time = g.init_time AND s.lead_day = g.lead_day AND s.row_n = g.row_n - 1 AND s.col_n = g.col_n"""


def _dx(v: str) -> str:
    return f"(CASE WHEN g.col_n = 0 THEN e.{v} - g.{v} WHEN g.col_n = 4 THEN g.{v} - w.{v} ELSE (e.{v} - w.{v}) / 2 END)"


def _dy(v: str) -> str:
    return f"(CASE WHEN g.row_n = 0 THEN n.{v} - g.{v} WHEN g.row_n = 4 THEN g.{v} - s.{v} ELSE (n.{v} - s.{v}) / 2 END)"


_KX, _KY = "(radians(5e0) * 6371e0 * cos(radians(g.lat)))", "(radians(5e0) * 6371e0)"
_EDGE = "g.col_n IN (0, 4) OR g.row_n IN (0, 4)"
_LAP = f"CASE WHEN {_EDGE} THEN NULL ELSE e.z + w.z + n.z + s.z - 4 * g.z END"


@query("gradients", ctes=B.GRID, doubles="grad_x grad_y grad_mag", sql=f"""
  SELECT *, sqrt(grad_x * grad_x + grad_y * grad_y) AS grad_mag FROM (
    SELECT g.init_time, g.lead_day, g.row_n, g.col_n, {_dx('z')} / {_KX} * 100 AS grad_x, {_dy('z')} / {_KY} * 100 AS grad_y {_NB})""")
def gradients(spark: SparkSession, sf: str) -> DataFrame:
    return ST.gradients(B.grid(spark, sf), "z", MAP, N, N, 5.0, 5.0).select(*POS, "grad_x", "grad_y", "grad_mag")


@query("laplacian", ctes=B.GRID, doubles="lap500", sql=f"SELECT g.init_time, g.lead_day, g.row_n, g.col_n, {_LAP} AS lap500 {_NB}")
def laplacian(spark: SparkSession, sf: str) -> DataFrame:
    return ST.gradients(B.grid(spark, sf), "z", MAP, N, N, 5.0, 5.0, laplacian="lap500").select(*POS, "lap500")


def _ucos(v: str) -> str:
    return f"((n.{v} * cos(radians(n.lat)) - s.{v} * cos(radians(s.lat))) / 2 / radians(5e0))"


def _kin(u: str, v: str) -> tuple[str, str]:
    scale = "(6.371e6 * cos(radians(g.lat))) * 1e5"
    ux, vx = f"((e.{u} - w.{u}) / 2 / radians(5e0))", f"((e.{v} - w.{v}) / 2 / radians(5e0))"
    return (f"CASE WHEN {_EDGE} THEN NULL ELSE ({vx} - {_ucos(u)}) / {scale} END",
            f"CASE WHEN {_EDGE} THEN NULL ELSE ({ux} + {_ucos(v)}) / {scale} END")


_VORT, _DIV = _kin("u", "v")
_VORT8, _DIV8 = _kin("u850", "v850")


@query("kinematics", ctes=B.GRID, doubles="vort500 div500", sql=f"""
  SELECT g.init_time, g.lead_day, g.row_n, g.col_n, {_VORT} AS vort500, {_DIV} AS div500 {_NB}""")
def kinematics(spark: SparkSession, sf: str) -> DataFrame:
    return ST.kinematics(B.grid(spark, sf), {"500": ("u", "v")}, MAP, N, N, 5.0, 5.0).select(*POS, "vort500", "div500")


_TJOIN = """LEFT JOIN src a ON a.init_time = g.init_time AND a.row_n = g.row_n AND a.col_n = g.col_n AND a.lead_day = g.lead_day + 1
  LEFT JOIN src b ON b.init_time = g.init_time AND b.row_n = g.row_n AND b.col_n = g.col_n AND b.lead_day = g.lead_day - 1"""


def _dt(v: str) -> str:
    return f"abs(CASE WHEN g.lead_day = 1 THEN a.{v} - g.{v} WHEN g.lead_day = 7 THEN g.{v} - b.{v} ELSE (a.{v} - b.{v}) / 2 END)"


@query("tendency", ctes=B.GRID, doubles="z500_tend mslp_tend", sql=f"""
  WITH src AS (SELECT init_time, lead_day, row_n, col_n, z, mslp / 100 AS p FROM grid)
  SELECT g.init_time, g.lead_day, g.row_n, g.col_n, {_dt('z')} AS z500_tend, {_dt('p')} AS mslp_tend FROM src g {_TJOIN}""")
def tendency(spark: SparkSession, sf: str) -> DataFrame:
    g = B.grid(spark, sf).withColumn("p", F.col("mslp") / 100)
    return ST.tendencies(g, {"z500_tend": "z", "mslp_tend": "p"}, ["init_time", "row_n", "col_n"], *LEADS).select(*POS, "z500_tend", "mslp_tend")


@query("mslp_gradient", ctes=B.GRID, doubles="mslp_grad", sql=f"""
  SELECT init_time, lead_day, row_n, col_n, sqrt(gx * gx + gy * gy) AS mslp_grad FROM (
    SELECT g.init_time, g.lead_day, g.row_n, g.col_n, {_dx('mslp')} / 100 / {_KX} * 100 AS gx, {_dy('mslp')} / 100 / {_KY} * 100 AS gy {_NB})""")
def mslp_gradient(spark: SparkSession, sf: str) -> DataFrame:
    g = B.grid(spark, sf).withColumn("p", F.col("mslp") / 100)
    return ST.gradients(g, "p", MAP, N, N, 5.0, 5.0, prefix="mslp").select(*POS, F.col("mslp_mag").alias("mslp_grad"))


@query("spread_growth", ctes=B.GRID, doubles="spread_growth", sql="""
  SELECT g.init_time, g.lead_day, g.row_n, g.col_n, g.z_std / CASE WHEN f.z_std IS NOT NULL THEN greatest(f.z_std, 1e-6) END AS spread_growth
  FROM grid g LEFT JOIN grid f ON f.init_time = g.init_time AND f.cell = g.cell AND f.lead_day = 1""")
def spread_growth(spark: SparkSession, sf: str) -> DataFrame:
    return ST.spread_growth(B.grid(spark, sf), "z_std", ["init_time", "row_n", "col_n"], 1).select(*POS, "spread_growth")


@query("spread_rel_domain", ctes=B.GRID, doubles="domain_spread spread_rel_domain", sql="""
  SELECT g.init_time, g.lead_day, row_n, col_n, d AS domain_spread, z_std / greatest(d, 1e-6) AS spread_rel_domain FROM grid g
  JOIN (SELECT init_time, lead_day, sqrt(avg(z_std * z_std)) AS d FROM grid GROUP BY ALL) k ON k.init_time = g.init_time AND k.lead_day = g.lead_day""")
def spread_rel_domain(spark: SparkSession, sf: str) -> DataFrame:
    return ST.spread_relative_to_domain(B.grid(spark, sf), "z_std").select(*POS, "domain_spread", "spread_rel_domain")


@query("nbhd_stats", ctes=B.GRID, doubles="nbhd_mean nbhd_std nbhd_rms", sql="""
  SELECT b.init_time, b.lead_day, CAST(r.k AS INTEGER) AS row_n, CAST(c.k AS INTEGER) AS col_n, avg(z_std) AS nbhd_mean,
         CASE WHEN count(z_std) > 1 THEN stddev_pop(z_std) ELSE 0e0 END AS nbhd_std, sqrt(avg(z_std * z_std)) AS nbhd_rms, count(z_std) AS nbhd_n
  FROM grid b JOIN (SELECT unnest(range(5)) AS k) r ON abs(r.k - b.row_n) <= 1 JOIN (SELECT unnest(range(5)) AS k) c ON abs(c.k - b.col_n) <= 1
  WHERE z_std IS NOT NULL GROUP BY ALL""")
def nbhd_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ST.neighbourhood_stats(B.grid(spark, sf), "z_std", MAP, N, N)


_EVO = """
  prev AS (SELECT g.init_time, g.lead_day, g.row_n, g.col_n, g.z - p.z AS dz, g.z_std - p.z_std AS rev_spread FROM grid g
           LEFT JOIN grid p ON p.cell = g.cell AND p.valid_time = g.valid_time AND p.init_time = g.init_time - INTERVAL 1 MONTH),
  evo AS (SELECT a.init_time, a.lead_day, a.row_n, a.col_n, abs(any_value(a.dz)) AS rev_region,
                 CASE WHEN any_value(a.dz) IS NOT NULL THEN sqrt(avg(b.dz * b.dz)) END AS rev_nbhd, any_value(a.rev_spread) AS rev_spread,
                 CAST(any_value(a.dz) IS NOT NULL AS INTEGER) AS rev_available
          FROM prev a JOIN prev b ON a.init_time = b.init_time AND a.lead_day = b.lead_day AND abs(a.row_n - b.row_n) <= 1 AND abs(a.col_n - b.col_n) <= 1
          GROUP BY ALL)"""


@query("evolution", ctes=B.GRID + "," + _EVO, doubles="rev_region rev_nbhd rev_spread", sql="SELECT * FROM evo")
def evolution(spark: SparkSession, sf: str) -> DataFrame:
    return FE.evolution(B.grid(spark, sf), previous_init(), N, N)


_GF = """anom500 abs_anom500 anom700 anom850 thick_anom grad_x grad_y grad_mag lap500 spread_m spread700 spread850 spread_growth domain_spread
spread_rel_domain nbhd_anom500 spread_nbhd spread_hetero rev_region rev_nbhd rev_spread"""


@query("grid_features", ctes=B.GRID + "," + _EVO, doubles=_GF, sql=f"""
  WITH base AS (SELECT g.init_time, g.lead_day, g.row_n, g.col_n, g.z - g.clim_value AS anom500, abs(g.z - g.clim_value) AS abs_anom500,
      g.z700 - g.clim_value AS anom700, g.z850 - g.clim_value AS anom850, g.z - g.z850 AS thick_anom, {_dx('z')} / {_KX} * 100 AS grad_x,
      {_dy('z')} / {_KY} * 100 AS grad_y, {_LAP} AS lap500, g.z_std AS spread_m, g.z700_std AS spread700, g.z850_std AS spread850 {_NB}),
  dom AS (SELECT init_time, lead_day, sqrt(avg(spread_m * spread_m)) AS d FROM base GROUP BY ALL),
  nb AS (SELECT a.init_time, a.lead_day, a.row_n, a.col_n, avg(b.anom500) AS nbhd_anom500, avg(b.spread_m) AS spread_nbhd,
                CASE WHEN count(b.spread_m) > 1 THEN stddev_pop(b.spread_m) WHEN count(b.spread_m) = 1 THEN 0e0 END / greatest(avg(b.spread_m), 1e-6) AS spread_hetero
         FROM base a JOIN base b ON a.init_time = b.init_time AND a.lead_day = b.lead_day AND abs(a.row_n - b.row_n) <= 1 AND abs(a.col_n - b.col_n) <= 1
         GROUP BY ALL)
  SELECT x.*, sqrt(x.grad_x * x.grad_x + x.grad_y * x.grad_y) AS grad_mag, x.spread_m / CASE WHEN f.spread_m IS NOT NULL THEN greatest(f.spread_m, 1e-6) END AS spread_growth,
         d AS domain_spread, x.spread_m / greatest(d, 1e-6) AS spread_rel_domain, nbhd_anom500, spread_nbhd, spread_hetero,
         rev_region, rev_nbhd, rev_spread, rev_available
  FROM base x LEFT JOIN base f ON f.init_time = x.init_time AND f.row_n = x.row_n AND f.col_n = x.col_n AND f.lead_day = 1
  JOIN dom ON dom.init_time = x.init_time AND dom.lead_day = x.lead_day
  JOIN nb ON nb.init_time = x.init_time AND nb.lead_day = x.lead_day AND nb.row_n = x.row_n AND nb.col_n = x.col_n
  JOIN evo ON evo.init_time = x.init_time AND evo.lead_day = x.lead_day AND evo.row_n = x.row_n AND evo.col_n = x.col_n""")
def grid_features(spark: SparkSession, sf: str) -> DataFrame:
    return FE.grid_features(B.grid(spark, sf), N, N, 5.0, 5.0, 1, previous_init())


_DF = """u500_anom v500_anom ws500 ws850 shear_500_850 vort500 vort850 div500 div850 mslp_anom mslp_grad wspread500 mslp_spread z500_tend mslp_tend vort500_tend"""


@query("dyn_features", ctes=B.GRID, doubles=_DF, sql=f"""
  WITH src AS (SELECT g.init_time, g.lead_day, g.row_n, g.col_n, g.u - g.u_clim AS u500_anom, g.v - g.v_clim AS v500_anom,
      sqrt(g.u * g.u + g.v * g.v) AS ws500, sqrt(g.u850 * g.u850 + g.v850 * g.v850) AS ws850,
      sqrt(pow(g.u - g.u850, 2) + pow(g.v - g.v850, 2)) AS shear_500_850, {_VORT} AS vort500, {_VORT8} AS vort850, {_DIV} AS div500, {_DIV8} AS div850,
      (g.mslp - g.mslp_clim) / 100 AS mslp_anom, sqrt(pow({_dx('mslp')} / {_KX}, 2) + pow({_dy('mslp')} / {_KY}, 2)) AS mslp_grad,
      sqrt(g.u_std * g.u_std + g.v_std * g.v_std) AS wspread500, g.mslp_std / 100 AS mslp_spread, g.z, g.mslp / 100 AS p {_NB})
  SELECT g.* EXCLUDE (z, p), {_dt('z')} AS z500_tend, {_dt('p')} AS mslp_tend, {_dt('vort500')} AS vort500_tend FROM src g {_TJOIN}""")
def dyn_features(spark: SparkSession, sf: str) -> DataFrame:
    return FE.wind_features(B.grid(spark, sf), N, N, 5.0, 5.0, *LEADS)


# --- selection, ordering, sampling -------------------------------------------------------------------------------------

@query("stress_cases", ctes=B.LABELLED, sql="""
  SELECT init_time, CAST(sum(hidden_bust) AS BIGINT) AS n_hidden FROM labelled WHERE split = 'test' AND lead_day BETWEEN 3 AND 7
  GROUP BY init_time ORDER BY n_hidden DESC, init_time LIMIT 4""")
def stress_cases(spark: SparkSession, sf: str) -> DataFrame:
    return SEL.stress_inits(B.labelled(spark, sf).where("split = 'test'"))


@query("random_cases", ctes=B.LABELLED, sql="""
  SELECT init_time FROM (SELECT DISTINCT init_time FROM labelled WHERE split = 'test') WHERE init_time NOT IN (
    SELECT init_time FROM labelled WHERE split = 'test' AND lead_day BETWEEN 3 AND 7 GROUP BY init_time ORDER BY sum(hidden_bust) DESC, init_time LIMIT 4)
  ORDER BY md5('20260928-' || strftime(init_time, '%Y%m%d%H')) LIMIT 8""")
def random_cases(spark: SparkSession, sf: str) -> DataFrame:
    return SEL.random_inits(B.labelled(spark, sf).where("split = 'test'"), seed=20260928)


@query("representative_cases", ctes=B.LABELLED, sql="""
  WITH t AS (SELECT DISTINCT init_time, season FROM labelled WHERE split = 'test'),
  stress AS (SELECT init_time FROM labelled WHERE split = 'test' AND lead_day BETWEEN 3 AND 7 GROUP BY init_time ORDER BY sum(hidden_bust) DESC, init_time LIMIT 4)
  SELECT min(init_time) AS init_time, season, 'representative' AS role FROM t WHERE init_time NOT IN (SELECT init_time FROM stress) GROUP BY season
  UNION ALL (SELECT init_time, season, 'stress' FROM t WHERE init_time = (SELECT min(init_time) FROM stress))""")
def representative_cases(spark: SparkSession, sf: str) -> DataFrame:
    te = B.labelled(spark, sf).where("split = 'test'")
    seasons = te.select("init_time", "season").distinct()
    return SEL.representative_cases(SEL.random_pool(te).join(seasons, "init_time"), SEL.stress_inits(te).join(seasons, "init_time"))


@query("priority_queue", ctes=B.CASES, doubles="score", sql="""
  SELECT init_time, case_id, p_a * pow(0.5e0, (lead_day - 1) / 5e0) AS score, CAST(row_number() OVER (PARTITION BY init_time
         ORDER BY p_a * pow(0.5e0, (lead_day - 1) / 5e0) DESC, case_id) AS INTEGER) AS rank FROM cases
  QUALIFY row_number() OVER (PARTITION BY init_time ORDER BY p_a * pow(0.5e0, (lead_day - 1) / 5e0) DESC, case_id) <= 20""")
def priority_queue(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("init_time").orderBy(F.desc("score"), "case_id")
    score = F.col("p_a") * F.pow(F.lit(0.5), (F.col("lead_day") - 1) / 5.0)
    return (B.cases(spark, sf).select("init_time", "case_id", score.alias("score")).withColumn("rank", F.row_number().over(w))
            .where("rank <= 20"))


@query("worst_regions", ctes=B.CASES, doubles="rmse", sql="""
  SELECT region_id, sqrt(avg(error_m * error_m)) AS rmse FROM cases GROUP BY region_id ORDER BY rmse DESC, region_id LIMIT 5""")
def worst_regions(spark: SparkSession, sf: str) -> DataFrame:
    g = B.cases(spark, sf).groupBy("region_id").agg(F.sqrt(F.avg(F.col("error_m") * F.col("error_m"))).alias("rmse"))
    return g.orderBy(F.desc("rmse"), "region_id").limit(5)


@query("sample_rows", ctes=B.CASES, sql="""
  SELECT case_id, region_id, lead_day FROM cases WHERE split = 'validation' ORDER BY md5('7-' || CAST(case_id AS VARCHAR)), case_id LIMIT 500""")
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return SEL.sample_rows(B.cases(spark, sf).where("split = 'validation'").select("case_id", "region_id", "lead_day"), 500, seed=7)


_CUM = """
  h AS (SELECT p_a AS s, sum(bust) AS pos, count(*) - sum(bust) AS neg FROM labelled WHERE split = 'test' GROUP BY p_a),
  c AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM h)"""


@query("pr_curve", ctes=B.LABELLED + "," + _CUM, doubles="recall precision", sql="""
  WITH pts AS (SELECT tp / p AS recall, tp / (tp + fp) AS precision, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS m FROM c
               UNION ALL SELECT 0e0, 1e0, (SELECT count(*) FROM c), (SELECT count(*) FROM c)),
  keep AS (SELECT DISTINCT CAST(floor(k * (SELECT count(*) FROM c) / 59e0) AS BIGINT) AS i FROM range(0, 60) t(k))
  SELECT pts.i AS position, recall, precision FROM pts JOIN keep ON keep.i = pts.i""")
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return R.pr_curve(B.labelled(spark, sf).where("split = 'test'"), "bust", "p_a")
