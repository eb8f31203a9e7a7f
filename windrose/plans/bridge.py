"""Views that give the driver's tables the library's schemas (see FIXTURES.md, part B).

Each view exists twice: as DataFrames for the library and as a SQL common table expression for the
cross-check.  Views are lazy and memoised per (application, folder).  Two of them, the labelled cases and the gridded
state set, are the pipeline's stored tables: they are written once and read by every query that builds on them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.functions import scalar as S
from windrose.operators import labels as L
from windrose.session import scratch_path

TRAIN_END = "2024-01-16 00:00:00"
VALIDATION_END = "2024-01-23 00:00:00"
PERIODS = {"train": ("1900-01-01 00:00:00", "2024-01-15 23:59:59.999999"),
           "validation": (TRAIN_END, "2024-01-22 23:59:59.999999"), "test": (VALIDATION_END, "2999-01-01 00:00:00")}
PERIOD_ENDS = {"train": TRAIN_END, "validation": VALIDATION_END}
ALERT = 0.5

_plans: dict[tuple, DataFrame] = {}


def memo(fn):
    @wraps(fn)
    def inner(spark: SparkSession, sf: str) -> DataFrame:
        key = (fn.__module__, fn.__name__, spark.sparkContext.applicationId, id(spark), sf)
        if key not in _plans:
            _plans[key] = fn(spark, sf)
        return _plans[key]
    return inner


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- cases ---------------------------------------------------------------------------------------------------

def cases_raw(spark: SparkSession, sf: str) -> DataFrame:
    """One case per event: 3 x 3 regions, 5 leads, 2 seasons, 5 signature classes."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("double")
    row, col = (F.col("user_id") % 3).cast("int"), (F.floor(F.col("user_id") / 3) % 3).cast("int")
    lead = (1 + F.col("event_id") % 5).cast("int")
    init = F.date_trunc("day", "ts")
    return e.select(
        F.col("event_id").alias("case_id"),
        F.concat(F.lit("R0"), row.cast("string"), F.lit("0"), col.cast("string")).alias("region_id"),
        row.alias("row_n"), col.alias("col_n"), lead.alias("lead_day"),
        F.concat(F.lit("S"), (F.dayofmonth("ts") % 2).cast("string")).alias("season"),
        "ts", init.alias("init_time"), S.valid_time(init, lead * 24).alias("valid_time"),
        S.split_of("ts", PERIODS).alias("split0"),
        F.col("value").alias("error_m"), (F.col("value") - 30).alias("bias_m"), (1 + k).alias("spread_m"),
        (k / 100).alias("p_a"), ((k + F.col("event_id") % 7) / 110).alias("p_b"), F.col("event_type").alias("sig_class"))


CASES_RAW = """
cases_raw AS (
  SELECT event_id AS case_id, 'R0' || CAST(user_id % 3 AS VARCHAR) || '0' || CAST((user_id // 3) % 3 AS VARCHAR) AS region_id,
         CAST(user_id % 3 AS INTEGER) AS row_n, CAST((user_id // 3) % 3 AS INTEGER) AS col_n,
         CAST(1 + event_id % 5 AS INTEGER) AS lead_day, 'S' || CAST(day(ts) % 2 AS VARCHAR) AS season, ts,
         date_trunc('day', ts) AS init_time,
         date_trunc('day', ts) + INTERVAL 1 DAY * CAST(1 + event_id % 5 AS INTEGER) AS valid_time,
         CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'train'
              WHEN ts < TIMESTAMP '2024-01-23 00:00:00' THEN 'validation' ELSE 'test' END AS split0,
         value AS error_m, value - 30 AS bias_m, 1e0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS spread_m,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100e0 AS p_a,
         (CAST(json_extract_string(props, '$.k') AS DOUBLE) + event_id % 7) / 110e0 AS p_b, event_type AS sig_class
  FROM events)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with the embargo applied."""
    return cases_raw(spark, sf).withColumn("split", S.embargo("split0", "valid_time", PERIOD_ENDS)).drop("split0")


CASES = CASES_RAW + """,
cases AS (
  SELECT * EXCLUDE (split0),
         CASE WHEN split0 = 'train' AND valid_time > TIMESTAMP '2024-01-16 00:00:00' THEN 'embargo'
              WHEN split0 = 'validation' AND valid_time > TIMESTAMP '2024-01-23 00:00:00' THEN 'embargo'
              ELSE split0 END AS split
  FROM cases_raw)"""

_ORDER = ("init_time", "lead_day", "case_id")


def stored(plan):
    """Materialisation point: the plan is written once per application as a parquet table in the shared scratch folder
    and read back (column and partition pruning included) by everything downstream."""
    name, partition = plan.__name__.replace("_plan", ""), plan.partition_by

    @memo
    @wraps(plan)
    def inner(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, name)
        w = plan(spark, sf).write.mode("overwrite")
        (w.partitionBy(partition) if partition else w).parquet(path)
        return spark.read.parquet(path)
    return inner


def labelled_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled cases (thresholds, flags, spread ratio) as one lazy plan."""
    return L.label_cases(cases(spark, sf), anomaly="bias_m", order=_ORDER)


labelled_plan.partition_by = "split"
labelled = stored(labelled_plan)


def labelled_sql(tie: str = "") -> str:
    """The labelled cases; ``tie`` (SQL, e.g. " + 1e-9") widens a threshold's equality to what is equal but for rounding."""
    return CASES + f""",
scale AS (
  SELECT region_id, season, stddev_samp(bias_m) AS scale_m FROM (
    SELECT * FROM cases WHERE split = 'train'
    QUALIFY row_number() OVER (PARTITION BY region_id, valid_time ORDER BY init_time, lead_day, case_id) = 1)
  GROUP BY region_id, season),
scaled AS (SELECT c.*, s.scale_m, c.error_m / s.scale_m AS norm_error FROM cases c LEFT JOIN scale s USING (region_id, season)),
thresholds AS (
  SELECT region_id, lead_day, season, quantile_cont(norm_error, 0.90) AS q_primary,
         quantile_cont(norm_error, 0.95) AS q_sensitivity, quantile_cont(spread_m, 0.25) AS spread_low, count(*) AS n_train
  FROM scaled WHERE split = 'train' GROUP BY ALL),
labelled AS (
  SELECT s.*, t.q_primary, t.q_sensitivity, t.spread_low,
         CAST(coalesce(norm_error > q_primary{tie}, false) AS INTEGER) AS bust,
         CAST(coalesce(norm_error > q_sensitivity{tie}, false) AS INTEGER) AS bust_q95,
         CAST(coalesce(spread_m <= spread_low{tie}, false) AS INTEGER) AS low_spread,
         CAST(coalesce(norm_error > q_primary{tie} AND spread_m <= spread_low{tie}, false) AS INTEGER) AS hidden_bust,
         spread_m * sqrt(1 + 1 / 50e0) / (q_primary * scale_m) AS spread_thr_ratio
  FROM scaled s LEFT JOIN thresholds t USING (region_id, lead_day, season))"""


LABELLED = labelled_sql()
#: ``labels.TIE`` in SQL: a case whose error is an interpolated threshold's value is above or below it by the last bit of the scale alone.
TIE = "1e-9"
LABELLED_TIES = labelled_sql(f" + {TIE}")


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Case grain (init_time, region_id, lead_day): means of the event rows."""
    return cases(spark, sf).groupBy("init_time", "region_id", "row_n", "col_n", "lead_day").agg(
        F.avg("error_m").alias("error_m"), F.avg("spread_m").alias("spread_m"), F.avg("p_a").alias("p_a"))


TRAJECTORIES = CASES + """,
trajectories AS (
  SELECT init_time, region_id, row_n, col_n, lead_day, avg(error_m) AS error_m, avg(spread_m) AS spread_m, avg(p_a) AS p_a
  FROM cases GROUP BY ALL)"""


# --- ensemble members on a 5 x 5 grid -----------------------------------------------------------------------

def members(spark: SparkSession, sf: str) -> DataFrame:
    """Member grain: a line item is a member; monthly inits, leads of 1..7 months, three levels, extra variables."""
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    init = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    row, col = F.floor(F.col("c_nationkey") / 5).cast("int"), (F.col("c_nationkey") % 5).cast("int")
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select(
        init.alias("init_time"), F.col("l_linenumber").alias("lead_day"),
        F.add_months(init, F.col("l_linenumber")).cast("timestamp").alias("valid_time"),
        F.col("l_suppkey").alias("member"),
        F.when(F.col("l_returnflag") == "A", 500).when(F.col("l_returnflag") == "N", 700).otherwise(850).alias("level"),
        F.col("c_nationkey").alias("cell"), row.alias("row_n"), col.alias("col_n"),
        (-10.0 + 5 * row).alias("lat"), (60.0 + 5 * col).alias("lon"),
        (F.col("l_extendedprice") / 1000).alias("value"), (F.col("l_quantity") - 25).alias("u"),
        (F.col("l_discount") * 100 - 5).alias("v"), (101000 + F.col("l_tax") * 10000).alias("mslp")))


MEMBERS = """
members AS (
  SELECT date_trunc('month', o.o_orderdate) AS init_time, l.l_linenumber AS lead_day,
         date_trunc('month', o.o_orderdate) + INTERVAL 1 MONTH * l.l_linenumber AS valid_time, l.l_suppkey AS member,
         CASE l.l_returnflag WHEN 'A' THEN 500 WHEN 'N' THEN 700 ELSE 850 END AS level, c.c_nationkey AS cell,
         c.c_nationkey // 5 AS row_n, c.c_nationkey % 5 AS col_n,
         -10e0 + 5 * (c.c_nationkey // 5) AS lat, 60e0 + 5 * (c.c_nationkey % 5) AS lon,
         l.l_extendedprice / 1000e0 AS value, l.l_quantity - 25 AS u, l.l_discount * 100 - 5 AS v,
         101000 + l.l_tax * 10000 AS mslp
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey)"""


def reference(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("valid_time"),
                     F.col("c_nationkey").alias("cell"))
            .agg((F.avg("o_totalprice") / 5000).alias("ref_value")))


REFERENCE = """
reference AS (
  SELECT date_trunc('month', o.o_orderdate) AS valid_time, c.c_nationkey AS cell, avg(o.o_totalprice) / 5000 AS ref_value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL)"""


def climatology(spark: SparkSession, sf: str) -> DataFrame:
    return (members(spark, sf).groupBy(F.month("init_time").alias("month_n"), "cell")
            .agg(F.avg("value").alias("clim_value"), F.avg("u").alias("u_clim"), F.avg("v").alias("v_clim"),
                 F.avg("mslp").alias("mslp_clim")))


CLIMATOLOGY = """
climatology AS (
  SELECT CAST(month(init_time) AS INTEGER) AS month_n, cell, avg(value) AS clim_value, avg(u) AS u_clim, avg(v) AS v_clim,
         avg(mslp) AS mslp_clim
  FROM members GROUP BY ALL)"""


def grid_plan(spark: SparkSession, sf: str) -> DataFrame:
    """State set: ensemble statistics per (init, lead, cell) and the matching reference and climatology (NULL if absent)."""
    m = members(spark, sf)
    on = lambda lv, c: F.when(F.col("level") == lv, F.col(c))      # noqa: E731
    g = m.groupBy("init_time", "lead_day", "valid_time", "cell", "row_n", "col_n", "lat", "lon").agg(
        F.avg("value").alias("z"), F.stddev_samp("value").alias("z_std"), F.count("value").alias("n_members"),
        F.avg(on(700, "value")).alias("z700"), F.avg(on(850, "value")).alias("z850"),
        F.stddev_samp(on(700, "value")).alias("z700_std"), F.stddev_samp(on(850, "value")).alias("z850_std"),
        F.avg("u").alias("u"), F.avg("v").alias("v"), F.stddev_samp("u").alias("u_std"), F.stddev_samp("v").alias("v_std"),
        F.avg(on(850, "u")).alias("u850"), F.avg(on(850, "v")).alias("v850"),
        F.avg("mslp").alias("mslp"), F.stddev_samp("mslp").alias("mslp_std"))
    return (g.withColumn("month_n", F.month("valid_time"))
            .join(climatology(spark, sf), ["month_n", "cell"], "left")
            .join(reference(spark, sf), ["valid_time", "cell"], "left").drop("month_n"))


grid_plan.partition_by = None
grid = stored(grid_plan)


GRID = MEMBERS + "," + REFERENCE + "," + CLIMATOLOGY + """,
grid AS (
  SELECT g.*, c.clim_value, c.u_clim, c.v_clim, c.mslp_clim, r.ref_value FROM (
    SELECT init_time, lead_day, valid_time, cell, row_n, col_n, lat, lon, avg(value) AS z, stddev_samp(value) AS z_std,
           count(value) AS n_members, avg(value) FILTER (level = 700) AS z700, avg(value) FILTER (level = 850) AS z850,
           stddev_samp(value) FILTER (level = 700) AS z700_std, stddev_samp(value) FILTER (level = 850) AS z850_std,
           avg(u) AS u, avg(v) AS v, stddev_samp(u) AS u_std, stddev_samp(v) AS v_std,
           avg(u) FILTER (level = 850) AS u850, avg(v) FILTER (level = 850) AS v850,
           avg(mslp) AS mslp, stddev_samp(mslp) AS mslp_std
    FROM members GROUP BY ALL) g
  LEFT JOIN climatology c ON month(g.valid_time) = c.month_n AND g.cell = c.cell
  LEFT JOIN reference r ON g.valid_time = r.valid_time AND g.cell = r.cell)"""


# --- analogue vectors -------------------------------------------------------------------------------------------

def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp")
    lead = (1 + F.col("vec_id") % 3).cast("int")
    hours = lambda h: origin + F.make_dt_interval(F.lit(0), h.cast("int"))
    return e.select(
        F.col("vec_id").alias("case_id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.concat(F.lit("G"), (F.col("vec_id") % 2).cast("string")).alias("region_id"), lead.alias("lead_day"),
        hours(F.col("vec_id")).alias("init_time"), hours(F.col("vec_id") + 24 * lead).alias("valid_time"),
        (F.col("label") < 3).cast("int").alias("bust"), F.col("label").cast("double").alias("norm_error"),
        F.element_at(F.array(F.lit("POSITION_PHASE"), F.lit("AMPLITUDE_STRUCTURE"), F.lit("RESIDUAL_MIXED")),
                     (F.col("label") % 3 + 1).cast("int")).alias("sig_class"),
        F.when(F.col("vec_id") % 10 < 5, "train").when(F.col("vec_id") % 10 < 7, "validation").otherwise("test").alias("split"))


VECTORS = """
vectors AS (
  SELECT vec_id AS case_id, CAST(embedding AS DOUBLE[]) AS vector, 'G' || CAST(vec_id % 2 AS VARCHAR) AS region_id,
         CAST(1 + vec_id % 3 AS INTEGER) AS lead_day,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(vec_id AS INTEGER) AS init_time,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(vec_id + 24 * (1 + vec_id % 3) AS INTEGER) AS valid_time,
         CAST(label < 3 AS INTEGER) AS bust, CAST(label AS DOUBLE) AS norm_error,
         ['POSITION_PHASE', 'AMPLITUDE_STRUCTURE', 'RESIDUAL_MIXED'][CAST(label % 3 + 1 AS INTEGER)] AS sig_class,
         CASE WHEN vec_id % 10 < 5 THEN 'train' WHEN vec_id % 10 < 7 THEN 'validation' ELSE 'test' END AS split
  FROM embeddings)"""
