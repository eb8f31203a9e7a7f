"""Join and set-operation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.operators import alignment as A
from windrose.operators import grid as G
from windrose.operators import labels as L
from windrose.plans import bridge as B
from windrose.plans.registry import query
from windrose.session import cut_lineage

DOMAIN = {"lat_min": -5.0, "lat_max": 40.0, "lon_min": 60.0, "lon_max": 105.0}
N = 5   # the bridge grid is N x N

_STATE = """SELECT init_time, lead_day, valid_time, cell, avg(value) AS z, stddev_samp(value) AS z_std FROM members GROUP BY ALL"""


def states(spark: SparkSession, sf: str) -> DataFrame:
    return B.members(spark, sf).groupBy("init_time", "lead_day", "valid_time", "cell").agg(
        F.avg("value").alias("z"), F.stddev_samp("value").alias("z_std"))


@query("align_reference", ctes=B.MEMBERS + "," + B.REFERENCE, doubles="z ref_value", sql=f"""
  SELECT init_time, lead_day, cell, z, ref_value FROM ({_STATE}) JOIN reference USING (valid_time, cell)""")
def align_reference(spark: SparkSession, sf: str) -> DataFrame:
    return A.align_reference(states(spark, sf), B.reference(spark, sf), ["valid_time", "cell"], missing="drop").select(
        "init_time", "lead_day", "cell", "z", "ref_value")


@query("missing_reference", ctes=B.MEMBERS + "," + B.REFERENCE, sql="""
  SELECT DISTINCT valid_time, cell FROM members m WHERE NOT EXISTS (
    SELECT 1 FROM reference r WHERE r.valid_time = m.valid_time AND r.cell = m.cell)""")
def missing_reference(spark: SparkSession, sf: str) -> DataFrame:
    return A.missing_reference(B.members(spark, sf), B.reference(spark, sf), ["valid_time", "cell"])


@query("climatology_join", ctes=B.MEMBERS + "," + B.CLIMATOLOGY, doubles="anomaly", sql=f"""
  SELECT init_time, lead_day, s.cell, z - clim_value AS anomaly FROM ({_STATE}) s
  JOIN climatology c ON c.month_n = month(valid_time) AND c.cell = s.cell""")
def climatology_join(spark: SparkSession, sf: str) -> DataFrame:
    s = states(spark, sf).withColumn("month_n", F.month("valid_time"))
    return A.align_reference(s, B.climatology(spark, sf), ["month_n", "cell"], missing="drop").select(
        "init_time", "lead_day", "cell", (F.col("z") - F.col("clim_value")).alias("anomaly"))


@query("climatology_join_gaps", ctes=B.MEMBERS + "," + B.CLIMATOLOGY, doubles="anomaly", sql=f"""
  SELECT init_time, lead_day, s.cell, z - clim_value AS anomaly FROM ({_STATE}) s
  LEFT JOIN (SELECT * FROM climatology WHERE month_n <> 6) c ON c.month_n = month(valid_time) AND c.cell = s.cell""")
def climatology_join_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a month without climatology are kept, their anomaly is NULL."""
    s = states(spark, sf).withColumn("month_n", F.month("valid_time"))
    return A.align_reference(s, B.climatology(spark, sf).where("month_n <> 6"), ["month_n", "cell"], missing="keep").select(
        "init_time", "lead_day", "cell", (F.col("z") - F.col("clim_value")).alias("anomaly"))


REGIONS = """
regions AS (
  SELECT 'R' || lpad(CAST(row_n AS VARCHAR), 2, '0') || lpad(CAST(col_n AS VARCHAR), 2, '0') AS region_id, row_n, col_n, lat, lon,
         lat - dlat / 2 AS lat_lo, lat + dlat / 2 AS lat_hi, lon - dlon / 2 AS lon_lo, lon + dlon / 2 AS lon_hi
  FROM (SELECT lat, CAST(row_number() OVER (ORDER BY lat) - 1 AS INTEGER) AS row_n FROM (SELECT DISTINCT lat FROM members WHERE lat BETWEEN -5 AND 40)),
       (SELECT lon, CAST(row_number() OVER (ORDER BY lon) - 1 AS INTEGER) AS col_n FROM (SELECT DISTINCT lon FROM members WHERE lon BETWEEN 60 AND 105)),
       (SELECT median(d) AS dlat FROM (SELECT lead(lat) OVER (ORDER BY lat) - lat AS d FROM (SELECT DISTINCT lat FROM members))),
       (SELECT median(d) AS dlon FROM (SELECT lead(lon) OVER (ORDER BY lon) - lon AS d FROM (SELECT DISTINCT lon FROM members))))"""


@B.memo
def regions(spark: SparkSession, sf: str) -> DataFrame:
    """The region dimension, derived once from the distinct cells."""
    cells = cut_lineage(B.members(spark, sf).select("lat", "lon").distinct())
    return cut_lineage(G.build_regions(cells, DOMAIN))


@query("build_regions", ctes=B.MEMBERS + "," + REGIONS, doubles="lat lon lat_lo lat_hi lon_lo lon_hi", sql="""
  SELECT *, CASE WHEN lat >= 5 AND lat < 22 AND lon >= 55 AND lon < 72 THEN 'Arabian Sea'
    WHEN lat >= 5 AND lat < 22 AND lon >= 80.5 AND lon < 95 THEN 'Bay of Bengal'
    WHEN lat >= -10 AND lat < 5 AND lon >= 55 AND lon < 100 THEN 'Equatorial Indian Ocean'
    WHEN lat >= 8 AND lat < 17 AND lon >= 72 AND lon < 80.5 THEN 'South Indian Peninsula'
    ELSE 'Surrounding region' END AS name FROM regions""")
def build_regions(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf)


# a 3 x 3 refinement of the grid: the member number picks the fine point
def fine(spark: SparkSession, sf: str) -> DataFrame:
    step = 5.0 / 3
    return B.members(spark, sf).withColumns({
        "flat": F.col("lat") + (F.col("member") % 3 - 1) * step,
        "flon": F.col("lon") + (F.floor(F.col("member") / 3) % 3 - 1) * step})


FINE = """
fine AS (SELECT *, lat + (member % 3 - 1) * (5e0 / 3) AS flat, lon + ((member // 3) % 3 - 1) * (5e0 / 3) AS flon FROM members)"""


@query("region_cells", ctes=B.MEMBERS + "," + REGIONS + "," + FINE, doubles="flat flon", sql="""
  SELECT DISTINCT region_id, flat, flon FROM fine f JOIN regions r
  ON f.flat >= r.lat_lo AND f.flat < r.lat_hi AND f.flon >= r.lon_lo AND f.flon < r.lon_hi""")
def region_cells(spark: SparkSession, sf: str) -> DataFrame:
    return G.region_cells(regions(spark, sf), fine(spark, sf), "flat", "flon")


@query("neighbourhood", ctes=B.MEMBERS + "," + REGIONS, sql="""
  SELECT a.region_id, count(*) AS n_neighbours, min(b.row_n) AS row_lo, max(b.row_n) AS row_hi, min(b.col_n) AS col_lo, max(b.col_n) AS col_hi
  FROM regions a JOIN regions b ON abs(a.row_n - b.row_n) <= 3 AND abs(a.col_n - b.col_n) <= 3 GROUP BY a.region_id""")
def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    return (G.neighbours(regions(spark, sf), 3, "region_id").groupBy("region_id").agg(
        F.count(F.lit(1)).alias("n_neighbours"), F.min("nb_row").alias("row_lo"), F.max("nb_row").alias("row_hi"),
        F.min("nb_col").alias("col_lo"), F.max("nb_col").alias("col_hi")))


@query("region_neighbours", ctes=B.MEMBERS + "," + REGIONS, sql="""
  SELECT a.region_id, b.region_id AS nb_region_id FROM regions a JOIN regions b
  ON abs(a.row_n - b.row_n) <= 1 AND abs(a.col_n - b.col_n) <= 1""")
def region_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbours(regions(spark, sf), 1, "region_id").select("region_id", "nb_region_id")


@query("attach_thresholds", ctes=B.LABELLED, doubles="scale_m q_primary", sql="SELECT case_id, scale_m, q_primary FROM labelled")
def attach_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    c = B.cases(spark, sf)
    scale = L.require_positive_scale(L.fit_normalisation(c, "bias_m", ("init_time", "lead_day", "case_id")))
    scaled = L.attach(c, scale, ["region_id", "season"]).withColumn("norm_error", F.col("error_m") / F.col("scale_m"))
    th = L.fit_thresholds(scaled).drop("fitted_on")
    return L.attach(scaled, th, L.GROUP).select("case_id", "scale_m", "q_primary")


@query("one_to_one_merge", ctes=B.TRAJECTORIES, doubles="error_m p_a", sql="""
  SELECT init_time, region_id, lead_day, error_m, p_a FROM trajectories""")
def one_to_one_merge(spark: SparkSession, sf: str) -> DataFrame:
    t, keys = B.trajectories(spark, sf), ["init_time", "region_id", "lead_day"]
    return A.one_to_one_merge(t.select(*keys, "error_m"), t.select(*keys, "p_a"), keys)


@query("previous_cycle", ctes=B.MEMBERS, doubles="z prev_z", sql=f"""
  WITH s AS ({_STATE})
  SELECT c.init_time, c.lead_day, c.cell, c.z, p.z AS prev_z FROM s c LEFT JOIN s p
  ON p.cell = c.cell AND p.valid_time = c.valid_time AND p.init_time = c.init_time - INTERVAL 1 MONTH""")
def previous_cycle(spark: SparkSession, sf: str) -> DataFrame:
    s = states(spark, sf)
    return A.previous_cycle(s, ["cell"], ["z"], F.add_months("init_time", -1).cast("timestamp")).select(
        "init_time", "lead_day", "cell", "z", "prev_z")


@query("causal_candidates", ctes=B.VECTORS, sql="""
  SELECT q.case_id, count(c.case_id) AS n_eligible FROM vectors q LEFT JOIN vectors c
  ON c.region_id = q.region_id AND c.lead_day = q.lead_day AND c.valid_time <= q.init_time GROUP BY q.case_id""")
def causal_candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = B.vectors(spark, sf).drop("vector")
    return A.eligible_counts(v, v, ["region_id", "lead_day"]).select("case_id", "n_eligible")


@query("frozen_candidates", ctes=B.VECTORS, sql="""
  SELECT q.case_id, count(c.case_id) AS n_eligible FROM vectors q LEFT JOIN vectors c
  ON c.region_id = q.region_id AND c.lead_day = q.lead_day AND c.valid_time <= q.init_time AND c.split IN ('train', 'validation')
  GROUP BY q.case_id""")
def frozen_candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = B.vectors(spark, sf).drop("vector")
    return A.eligible_counts(v, v.where(F.col("split").isin("train", "validation")), ["region_id", "lead_day"]).select(
        "case_id", "n_eligible")


@query("rolling_cases", ctes=B.CASES, doubles="mean_error", sql="""
  SELECT CAST(d.fit_day AS VARCHAR) AS fit_day, region_id, lead_day, count(*) AS n_cases, avg(error_m) AS mean_error, max(valid_time) AS last_verified
  FROM cases c JOIN (SELECT DISTINCT CAST(valid_time AS DATE) + CAST(o AS INTEGER) AS fit_day FROM cases, range(0, 10) t(o)) d
  ON c.valid_time <= CAST(d.fit_day AS TIMESTAMP) AND c.valid_time > CAST(d.fit_day AS TIMESTAMP) - INTERVAL 10 DAY
  GROUP BY ALL HAVING count(*) >= 20""")
def rolling_cases(spark: SparkSession, sf: str) -> DataFrame:
    r = A.rolling_cases(B.cases(spark, sf).select("valid_time", "region_id", "lead_day", "error_m"), 10)
    return (r.groupBy("fit_day", "region_id", "lead_day").agg(
        F.count(F.lit(1)).alias("n_cases"), F.avg("error_m").alias("mean_error"), F.max("valid_time").alias("last_verified"))
        .where("n_cases >= 20").withColumn("fit_day", F.col("fit_day").cast("string")))


@query("bma_param_lookup", ctes=B.CASES, doubles="sigma", sql="""
  SELECT c.case_id, p.sigma, p.n_cases FROM cases c LEFT JOIN (
    SELECT CAST(valid_time AS DATE) AS fit_day, region_id, lead_day, stddev_samp(error_m) AS sigma, count(*) AS n_cases
    FROM cases GROUP BY ALL HAVING count(*) >= 5) p
  ON p.fit_day = CAST(c.init_time AS DATE) AND p.region_id = c.region_id AND p.lead_day = c.lead_day""")
def bma_param_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = B.cases(spark, sf)
    params = (c.groupBy(F.to_date("valid_time").alias("fit_day"), "region_id", "lead_day")
              .agg(F.stddev_samp("error_m").alias("sigma"), F.count(F.lit(1)).alias("n_cases")).where("n_cases >= 5"))
    return A.parameter_lookup(c, params, ["region_id", "lead_day"]).select("case_id", "sigma", "n_cases")


@query("member_rows", ctes=B.MEMBERS, doubles="member_sum z", sql=f"""
  SELECT s.init_time, s.lead_day, s.cell, s.z, m.n_members, m.member_sum FROM ({_STATE}) s JOIN (
    SELECT init_time, lead_day, cell, count(*) AS n_members, sum(value) AS member_sum FROM members GROUP BY ALL) m
  USING (init_time, lead_day, cell)""")
def member_rows(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["init_time", "lead_day", "cell"]
    arrays = B.members(spark, sf).groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("members"))   # ensemble size
    j = A.member_rows(states(spark, sf), arrays, keys)
    return j.select(*keys, "z", F.size("members").cast("long").alias("n_members"),
                    F.aggregate("members", F.lit(0.0), lambda a, x: a + x).alias("member_sum"))


@query("eval_frame", ctes=B.LABELLED, doubles="spread_m p_a", sql="""
  SELECT l.case_id, l.bust, l.spread_m, l.p_a FROM labelled l JOIN labels d ON d.doc_id = l.case_id""")
def eval_frame(spark: SparkSession, sf: str) -> DataFrame:
    lab = B.labelled(spark, sf)
    return A.evaluation_frame(lab.select("case_id", "bust"), lab.select("case_id", "spread_m"), lab.select("case_id", "p_a"),
                              B.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"))).select(
        "case_id", "bust", "spread_m", "p_a")


_STRESS = """SELECT init_time FROM labelled WHERE split = 'test' AND lead_day BETWEEN 3 AND 7
    GROUP BY init_time ORDER BY sum(hidden_bust) DESC, init_time LIMIT 4"""


@query("selected_inits", ctes=B.LABELLED, sql=f"SELECT case_id, init_time FROM labelled WHERE init_time IN ({_STRESS})")
def selected_inits(spark: SparkSession, sf: str) -> DataFrame:
    from windrose.products.selection import stress_inits
    lab = B.labelled(spark, sf)
    return lab.join(stress_inits(lab.where("split = 'test'")), "init_time", "left_semi").select("case_id", "init_time")


@query("b0_predict", ctes=B.LABELLED, doubles="p_b0", sql="""
  WITH rows AS (SELECT case_id, region_id, lead_day, season FROM labelled UNION ALL SELECT -case_id - 1, region_id, lead_day, 'S9' FROM labelled)
  SELECT l.case_id, coalesce(g.rate, t.rate) AS p_b0 FROM rows l LEFT JOIN (
    SELECT region_id, lead_day, season, avg(bust) AS rate FROM labelled WHERE split = 'train' GROUP BY ALL) g
  ON g.region_id = l.region_id AND g.lead_day = l.lead_day AND g.season = l.season
  CROSS JOIN (SELECT avg(bust) AS rate FROM labelled WHERE split = 'train') t""")
def b0_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Every case, and every case again in a season that TRAIN has never seen (negative ids): those get the global rate."""
    lab = B.labelled(spark, sf)
    rows = lab.select("case_id", "region_id", "lead_day", "season")
    unseen = rows.withColumns({"case_id": -F.col("case_id") - 1, "season": F.lit("S9")})
    return L.predict_climatology(rows.unionByName(unseen), L.climatology_rates(lab)).select("case_id", "p_b0")


@query("grid_check", ctes=B.MEMBERS + "," + B.REFERENCE, sql="""
  SELECT coalesce(a.valid_time, b.valid_time) AS valid_time, coalesce(a.cell, b.cell) AS cell,
         CASE WHEN b.cell IS NULL THEN 'left_only' ELSE 'right_only' END AS side
  FROM (SELECT DISTINCT valid_time, cell FROM members) a FULL JOIN (SELECT valid_time, cell FROM reference) b
  ON a.valid_time = b.valid_time AND a.cell = b.cell WHERE a.cell IS NULL OR b.cell IS NULL""")
def grid_check(spark: SparkSession, sf: str) -> DataFrame:
    return G.coordinate_mismatch(B.members(spark, sf), B.reference(spark, sf), ["valid_time", "cell"])


# --- set operations ------------------------------------------------------------------------------------------------

@query("union_blocks", ctes=B.CASES, doubles="error_m", sql="""
  SELECT case_id, region_id, error_m, 'a' AS block FROM cases WHERE row_n = 0
  UNION ALL SELECT case_id, region_id, error_m, 'b' FROM cases WHERE row_n <> 0""")
def union_blocks(spark: SparkSession, sf: str) -> DataFrame:
    c = B.cases(spark, sf)
    a = c.where("row_n = 0").select("case_id", "region_id", "error_m", F.lit("a").alias("block"))
    b = c.where("row_n <> 0").select("region_id", "error_m", "case_id", F.lit("b").alias("block"))
    return a.unionByName(b)


_EXTRA = "SELECT DISTINCT init_time FROM members WHERE level = 850 AND lead_day = 7 AND v > 4"


def _extra_inits(spark: SparkSession, sf: str) -> DataFrame:
    return B.members(spark, sf).where("level = 850 AND lead_day = 7 AND v > 4").select("init_time").distinct()


@query("inits_without_extras", ctes=B.MEMBERS, sql=f"SELECT DISTINCT init_time FROM members EXCEPT ({_EXTRA})")
def inits_without_extras(spark: SparkSession, sf: str) -> DataFrame:
    return B.members(spark, sf).select("init_time").distinct().exceptAll(_extra_inits(spark, sf))


@query("orphan_blocks", ctes=B.MEMBERS + "," + B.REFERENCE, sql="""
  SELECT DISTINCT valid_time FROM members WHERE valid_time NOT IN (SELECT valid_time FROM reference)""")
def orphan_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.members(spark, sf).select("valid_time").distinct().join(
        B.reference(spark, sf).select("valid_time").distinct(), "valid_time", "left_anti")


@query("common_inits", ctes=B.MEMBERS + "," + B.REFERENCE, sql="""
  SELECT init_time FROM members INTERSECT SELECT valid_time FROM reference""")
def common_inits(spark: SparkSession, sf: str) -> DataFrame:
    return B.members(spark, sf).select("init_time").intersect(
        B.reference(spark, sf).select(F.col("valid_time").alias("init_time")))


@query("selected_union", ctes=B.LABELLED, sql="""
  SELECT case_id FROM labelled WHERE split = 'test' AND bust = 1 UNION SELECT case_id FROM labelled WHERE split = 'test' AND p_a >= 0.5""")
def selected_union(spark: SparkSession, sf: str) -> DataFrame:
    te = B.labelled(spark, sf).where("split = 'test'")
    return te.where("bust = 1").select("case_id").union(te.where("p_a >= 0.5").select("case_id")).distinct()


@query("random_pool", ctes=B.LABELLED, sql=f"SELECT DISTINCT init_time FROM labelled WHERE split = 'test' EXCEPT ({_STRESS})")
def random_pool(spark: SparkSession, sf: str) -> DataFrame:
    from windrose.products.selection import random_pool as pool
    return pool(B.labelled(spark, sf).where("split = 'test'"))


@query("distinct_keys", ctes=B.CASES, sql="SELECT DISTINCT region_id, row_n, col_n, init_time FROM cases")
def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return B.cases(spark, sf).select("region_id", "row_n", "col_n", "init_time").dropDuplicates()
