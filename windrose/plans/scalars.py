"""Projection, filter and scalar-expression queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.functions import probability as P
from windrose.functions import scalar as S
from windrose.operators.ordered import ordered_totals
from windrose.plans import bridge as B
from windrose.plans.registry import query


@query("domain_subset", ctes=B.MEMBERS, doubles="lat lon value", sql="""
  SELECT init_time, lat, lon, value FROM members WHERE lat BETWEEN -5 AND 40 AND lon BETWEEN 60 AND 75""")
def domain_subset(spark: SparkSession, sf: str) -> DataFrame:
    box = {**C.TARGET_DOMAIN, "lon_max": 75.0}
    return B.members(spark, sf).where(S.in_box("lat", "lon", box)).select("init_time", "lat", "lon", "value")


@query("to_metres", ctes=B.MEMBERS, doubles="height_m", sql="SELECT init_time, cell, value / 9.80665e0 AS height_m FROM members")
def to_metres(spark: SparkSession, sf: str) -> DataFrame:
    return B.members(spark, sf).select("init_time", "cell", S.to_metres("value").alias("height_m"))


@query("valid_time", ctes=B.CASES, sql="""
  SELECT case_id, init_time + INTERVAL 1 HOUR * (24 * lead_day) AS valid_time FROM cases""")
def valid_time(spark: SparkSession, sf: str) -> DataFrame:
    return B.cases(spark, sf).select("case_id", S.valid_time("init_time", F.col("lead_day") * 24).alias("valid_time"))


@query("lead_day", ctes=B.CASES, sql="""
  SELECT case_id, CAST(date_diff('hour', init_time, valid_time) // 24 AS INTEGER) AS lead_day FROM cases""")
def lead_day(spark: SparkSession, sf: str) -> DataFrame:
    c = B.cases(spark, sf).withColumn("lead", F.col("valid_time") - F.col("init_time"))
    return c.select("case_id", S.lead_day(S.lead_to_hours("lead")).alias("lead_day"))


@query("season", sql="""
  SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (1, 2) THEN 'JF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM'
         WHEN month(o_orderdate) IN (6, 7, 8, 9) THEN 'JJAS' ELSE 'OND' END AS season,
         CAST(CASE WHEN month(o_orderdate) IN (1, 2) THEN 0 WHEN month(o_orderdate) IN (3, 4, 5) THEN 1
         WHEN month(o_orderdate) IN (6, 7, 8, 9) THEN 2 ELSE 3 END AS INTEGER) AS season_code FROM orders""")
def season(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").withColumn("season", S.season("o_orderdate"))
    return o.select("o_orderkey", "season", S.season_code("season").alias("season_code"))


@query("split_of", sql="""
  SELECT o_orderkey, CASE WHEN o_orderdate >= '1998-01-01' AND o_orderdate <= '1998-12-31 23:59:00' THEN 'validation'
    WHEN o_orderdate >= '1999-01-01' AND o_orderdate <= '1999-12-31 23:59:00' THEN 'test'
    WHEN o_orderdate >= '1995-01-01' AND o_orderdate <= '1997-12-31 23:59:00' THEN 'train' ELSE 'unused' END AS split FROM orders""")
def split_of(spark: SparkSession, sf: str) -> DataFrame:
    periods = {"train": ("1995-01-01", "1997-12-31 23:59:00"), "validation": ("1998-01-01", "1998-12-31 23:59:00"),
               "test": ("1999-01-01", "1999-12-31 23:59:00")}
    return B.table(spark, sf, "orders").select("o_orderkey", S.split_of(F.col("o_orderdate").cast("timestamp"), periods).alias("split"))


@query("embargo", ctes=B.CASES, sql="SELECT case_id, split FROM cases")
def embargo(spark: SparkSession, sf: str) -> DataFrame:
    return B.cases_raw(spark, sf).select("case_id", S.embargo("split0", "valid_time", B.PERIOD_ENDS).alias("split"))


@query("case_id", ctes=B.CASES, sql="""
  SELECT case_id AS event_id, strftime(init_time, '%Y%m%d%H') || '_' || region_id || '_D' || lpad(CAST(lead_day AS VARCHAR), 2, '0') AS case_id
  FROM cases""")
def case_id(spark: SparkSession, sf: str) -> DataFrame:
    return B.cases(spark, sf).select(F.col("case_id").alias("event_id"), S.case_id("init_time", "region_id", "lead_day").alias("case_id"))


@query("region_code", ctes=B.CASES, sql="""
  SELECT case_id, row_n * 100 + col_n AS region_code, CAST(hour(ts) AS INTEGER) AS init_hour FROM cases""")
def region_code(spark: SparkSession, sf: str) -> DataFrame:
    return B.cases(spark, sf).select("case_id", S.region_code("row_n", "col_n").alias("region_code"), F.hour("ts").alias("init_hour"))


@query("area_tag", ctes=B.CASES, sql="""
  SELECT case_id, CASE
    WHEN la >= 5 AND la < 22 AND lo >= 55 AND lo < 72 THEN 'Arabian Sea'
    WHEN la >= 5 AND la < 22 AND lo >= 80.5 AND lo < 95 THEN 'Bay of Bengal'
    WHEN la >= -10 AND la < 5 AND lo >= 55 AND lo < 100 THEN 'Equatorial Indian Ocean'
    WHEN la >= 8 AND la < 17 AND lo >= 72 AND lo < 80.5 THEN 'South Indian Peninsula'
    WHEN la >= 17 AND la < 26 AND lo >= 72 AND lo < 86 THEN 'Central India'
    WHEN la >= 22 AND la < 32 AND lo >= 60 AND lo < 77 THEN 'Northwest India / Pakistan'
    WHEN la >= 22 AND la < 30 AND lo >= 86 AND lo < 97 THEN 'Northeast India / Bangladesh'
    WHEN la >= 28 AND la < 40 AND lo >= 75 AND lo < 105 THEN 'Himalaya / Tibetan Plateau'
    WHEN la >= 28 AND la < 40 AND lo >= 55 AND lo < 75 THEN 'Afghanistan / Iran'
    WHEN la >= 10 AND la < 28 AND lo >= 95 AND lo < 106 THEN 'Myanmar / Indochina'
    ELSE 'Surrounding region' END AS area
  FROM (SELECT case_id, spread_m / 2 - 8 AS la, 52 + 57 * p_b AS lo FROM cases)""")
def area_tag(spark: SparkSession, sf: str) -> DataFrame:
    c = B.cases(spark, sf).select("case_id", (F.col("spread_m") / 2 - 8).alias("la"), (52 + 57 * F.col("p_b")).alias("lo"))
    return c.select("case_id", S.area_tag("la", "lo").alias("area"))


@query("area_weights", ctes=B.MEMBERS, doubles="lat weight", sql="""
  SELECT DISTINCT lat, sin(radians(least(90, lat + 2.5))) - sin(radians(greatest(-90, lat - 2.5))) AS weight FROM members""")
def area_weights(spark: SparkSession, sf: str) -> DataFrame:
    return B.members(spark, sf).select("lat").distinct().select("lat", S.area_weight("lat", 5.0).alias("weight"))


@query("normalized_error", ctes=B.CASES, doubles="norm_error", sql="SELECT case_id, error_m / spread_m AS norm_error FROM cases")
def normalized_error(spark: SparkSession, sf: str) -> DataFrame:
    return B.cases(spark, sf).select("case_id", S.normalized_error("error_m", "spread_m").alias("norm_error"))


@query("spread_thr_ratio", ctes=B.LABELLED, doubles="spread_thr_ratio", sql="SELECT case_id, spread_thr_ratio FROM labelled")
def spread_thr_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return B.labelled(spark, sf).select("case_id", S.spread_threshold_ratio("spread_m", "q_primary", "scale_m", C.ENSEMBLE_SIZE)
                                        .alias("spread_thr_ratio"))


@query("wind_features", ctes=B.MEMBERS, doubles="speed shear spread mslp_hpa abs_u", sql="""
  SELECT init_time, lead_day, cell, sqrt(u * u + v * v) AS speed, sqrt((u - u8) * (u - u8) + (v - v8) * (v - v8)) AS shear,
         sqrt(su * su + sv * sv) AS spread, p / 100 AS mslp_hpa, abs(u) AS abs_u
  FROM (SELECT init_time, lead_day, cell, avg(u) AS u, avg(v) AS v, avg(u) FILTER (level = 850) AS u8,
               avg(v) FILTER (level = 850) AS v8, stddev_samp(u) AS su, stddev_samp(v) AS sv, avg(mslp) AS p
        FROM members GROUP BY ALL)""")
def wind_features(spark: SparkSession, sf: str) -> DataFrame:
    return B.grid(spark, sf).select(
        "init_time", "lead_day", "cell", S.wind_speed("u", "v").alias("speed"), S.vector_shear("u", "v", "u850", "v850").alias("shear"),
        S.vector_spread("u_std", "v_std").alias("spread"), S.pa_to_hpa("mslp").alias("mslp_hpa"), F.abs("u").alias("abs_u"))


@query("logit", ctes=B.CASES, doubles="logit", sql="""
  SELECT case_id, ln(q / (1 - q)) AS logit FROM (SELECT case_id, least(greatest(p_a, 1e-6), 1 - 1e-6) AS q FROM cases)""")
def logit(spark: SparkSession, sf: str) -> DataFrame:
    return B.cases(spark, sf).select("case_id", S.logit("p_a").alias("logit"))


@query("risk_level", ctes=B.CASES, sql="""
  SELECT case_id, CASE WHEN p_a >= 0.5 THEN 'ALERT' WHEN p_a > p_b THEN 'ABOVE CLIMATOLOGY' ELSE 'AT OR BELOW CLIMATOLOGY' END AS risk_level,
         CAST(p_a >= 0.5 AS INTEGER) AS alert FROM cases""")
def risk_level(spark: SparkSession, sf: str) -> DataFrame:
    return B.cases(spark, sf).select("case_id", S.risk_level("p_a", "p_b", B.ALERT).alias("risk_level"),
                                     (F.col("p_a") >= B.ALERT).cast("int").alias("alert"))


@query("criterion_level", ctes=B.CASES, sql="""
  SELECT case_id, CASE WHEN rate IS NULL OR n < 5 THEN 'INSUFFICIENT' WHEN rate >= 2 * clim THEN 'HIGH'
         WHEN rate > 1.25 * clim THEN 'ELEVATED' ELSE 'NORMAL' END AS level
  FROM (SELECT case_id, nullif(p_a, 0) AS rate, p_b / 2 AS clim, CAST(spread_m AS INTEGER) AS n FROM cases)""")
def criterion_level(spark: SparkSession, sf: str) -> DataFrame:
    c = B.cases(spark, sf).select("case_id", F.nullif(F.col("p_a"), F.lit(0.0)).alias("rate"), (F.col("p_b") / 2).alias("clim"),
                                  F.col("spread_m").cast("int").alias("n"))
    return c.select("case_id", S.criterion_level("rate", "clim", "n", 5).alias("level"))


_EVIDENCE = """
  SELECT case_id, lead_day, p_a, p_b, spread_m, CAST(case_id % 4 AS INTEGER) AS support,
         CAST(nullif(spread_m - 1, 3) AS INTEGER) AS n_within, nullif(p_b, 0) AS rate FROM cases"""
_LEVEL = """CAST(CASE WHEN support >= 3 OR coalesce(n_within, 0) < 5 THEN 3
         WHEN support = 0 AND n_within >= 20 AND abs(rate - p_a) <= 0.25 THEN 0
         WHEN support <= 1 AND n_within >= 10 THEN 1 ELSE 2 END AS INTEGER)"""


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    c = B.cases(spark, sf).select(
        "case_id", "lead_day", "p_a", "p_b", "spread_m", (F.col("case_id") % 4).cast("int").alias("support"),
        F.nullif(F.col("spread_m") - 1, F.lit(3.0)).cast("int").alias("n_within"), F.nullif(F.col("p_b"), F.lit(0.0)).alias("rate"))
    return c.withColumn("evidence", S.evidence_strength("support", "n_within", "rate", "p_a", C.ANALOGUE_MIN))


@query("evidence_strength", ctes=B.CASES, sql=f"SELECT case_id, {_LEVEL} AS evidence FROM ({_EVIDENCE})")
def evidence_strength(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select("case_id", "evidence")


_BASE = f"""p_a * pow(0.5e0, (lead_day - 1) / 5e0) * [1.0e0, 0.85e0, 0.7e0, 0.5e0][{_LEVEL} + 1]"""


@query("priority_score", ctes=B.CASES, doubles="score", sql=f"""
  SELECT case_id, {_BASE} + 0.25 * greatest(0, p_a - p_b) AS score FROM ({_EVIDENCE})""")
def priority_score(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select(
        "case_id", S.priority_score("p_a", "lead_day", "evidence", S.disagreement_bonus("p_a", "p_b")).alias("score"))


@query("priority_score_tail", ctes=B.CASES, doubles="score", sql=f"""
  SELECT case_id, {_BASE} + 0.25 * least(1, greatest(0, spread_m / 40 - 1)) AS score FROM ({_EVIDENCE})""")
def priority_score_tail(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select(
        "case_id", S.priority_score("p_a", "lead_day", "evidence", S.tail_bonus("spread_m", F.lit(40.0))).alias("score"))


@query("priority_score_plain", ctes=B.CASES, doubles="score", sql=f"SELECT case_id, {_BASE} AS score FROM ({_EVIDENCE})")
def priority_score_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select("case_id", S.priority_score("p_a", "lead_day", "evidence").alias("score"))


@query("ideal_spread_prob", ctes=B.LABELLED, doubles="p_ideal", sql=f"""
  SELECT case_id, 2 * {P.norm_cdf_sql('z')} AS p_ideal FROM (
    SELECT case_id, -(q_primary * scale_m / greatest(spread_m * sqrt(1 + 1 / 50e0), 1e-6)) AS z FROM labelled)""")
def ideal_spread_prob(spark: SparkSession, sf: str) -> DataFrame:
    threshold = F.col("q_primary") * F.col("scale_m")
    return B.labelled(spark, sf).select("case_id", P.reliable_gaussian_exceedance(threshold, "spread_m", C.ENSEMBLE_SIZE).alias("p_ideal"))


@query("round_null", ctes=B.CASES, doubles="ratio", sql="""
  SELECT case_id, CASE WHEN spread_m = 1 THEN NULL ELSE round(bias_m / (spread_m - 1) + 1e-9, 3) END AS ratio FROM cases""")
def round_null(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.when(F.col("spread_m") == 1, F.lit(float("inf"))).otherwise(F.col("bias_m") / (F.col("spread_m") - 1) + F.lit(1e-9))
    return B.cases(spark, sf).select("case_id", S.round_or_null(odd, 3).alias("ratio"))


@query("disagreement_pp", ctes=B.CASES, doubles="disagreement_pp confidence", sql="""
  SELECT case_id, 100 * (p_a - p_b) AS disagreement_pp, 1 - p_a AS confidence FROM cases""")
def disagreement_pp(spark: SparkSession, sf: str) -> DataFrame:
    return B.cases(spark, sf).select("case_id", (100 * (F.col("p_a") - F.col("p_b"))).alias("disagreement_pp"),
                                     (1 - F.col("p_a")).alias("confidence"))


@query("canonical_order", ctes=B.CASES, sql="""
  SELECT case_id, row_number() OVER (ORDER BY init_time, region_id, lead_day, case_id) - 1 AS position FROM cases""")
def canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every case in canonical order: rows before its init time by a prefix sum, then its place inside the init time."""
    c = B.cases(spark, sf).select("case_id", "init_time", "region_id", "lead_day", F.unix_micros("init_time").alias("t"))
    before = ordered_totals(c, [], "t", {"n": F.lit(1)}).select("t", "below_n")
    place = F.row_number().over(W.partitionBy("t").orderBy("region_id", "lead_day", "case_id"))
    return c.join(before, "t").select("case_id", (F.col("below_n") + place - 1).cast("long").alias("position"))
