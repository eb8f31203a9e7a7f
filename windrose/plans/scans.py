"""Scan, source and sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.functions import scalar as S
from windrose.plans import bridge as B
from windrose.plans.registry import query
from windrose.session import scratch_path
from windrose.sources import scans, sinks

BOX = {"lat_min": -5.0, "lat_max": 5.0, "lon_min": 65.0, "lon_max": 80.0}


@query("scan_members", ctes=B.MEMBERS, doubles="lat lon value", sql="""
  SELECT init_time, lead_day, level, lat, lon, value FROM members
  WHERE level IN (500, 850) AND lead_day IN (1, 2, 3) AND lat BETWEEN -5 AND 5 AND lon BETWEEN 65 AND 80""")
def scan_members(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scan_members(B.members(spark, sf), (1, 2, 3), (500, 850), BOX, lead="lead_day").select(
        "init_time", "lead_day", "level", "lat", "lon", "value")


@query("scan_reference", ctes=B.REFERENCE, doubles="ref_value", sql="""
  SELECT valid_time, cell, ref_value FROM reference
  WHERE valid_time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'""")
def scan_reference(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scan_reference(B.reference(spark, sf), "1996-01-01", "1998-12-31").select("valid_time", "cell", "ref_value")


@query("scan_climatology", ctes=B.MEMBERS + "," + B.CLIMATOLOGY, doubles="clim_value", sql="""
  SELECT month_n, cell, clim_value FROM climatology""")
def scan_climatology(spark: SparkSession, sf: str) -> DataFrame:
    return B.climatology(spark, sf).select("month_n", "cell", "clim_value")


@query("scan_extra_clim", ctes=B.MEMBERS + "," + B.CLIMATOLOGY, doubles="u_clim v_clim mslp_clim", sql="""
  SELECT month_n, cell, u_clim, v_clim, mslp_clim FROM climatology""")
def scan_extra_clim(spark: SparkSession, sf: str) -> DataFrame:
    return B.climatology(spark, sf).select("month_n", "cell", "u_clim", "v_clim", "mslp_clim")


@query("scan_reduce_members", ctes=B.MEMBERS, doubles="u_mean u_std v_mean v_std mslp_mean mslp_std", sql="""
  SELECT init_time, lead_day, cell, avg(u) AS u_mean, stddev_samp(u) AS u_std, avg(v) AS v_mean, stddev_samp(v) AS v_std,
         avg(mslp) AS mslp_mean, stddev_samp(mslp) AS mslp_std, count(*) AS n_members
  FROM members GROUP BY ALL""")
def scan_reduce_members(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scan_reduced(B.members(spark, sf), ["init_time", "lead_day", "cell"], ["u", "v", "mslp"])


@query("lead_to_hours", ctes=B.CASES, sql="""
  SELECT case_id, CAST(date_diff('hour', init_time, valid_time) AS INTEGER) AS lead_hours FROM cases""")
def lead_to_hours(spark: SparkSession, sf: str) -> DataFrame:
    c = B.cases(spark, sf).withColumn("lead", F.col("valid_time") - F.col("init_time"))
    return c.select("case_id", S.lead_to_hours("lead").alias("lead_hours"))


@query("normalise_coords", ctes=B.MEMBERS, doubles="lat lon", sql="""
  SELECT lat, CASE WHEN lon - 100 < 0 THEN lon - 100 + 360 ELSE lon - 100 END AS lon, count(*) AS n FROM members GROUP BY ALL""")
def normalise_coords(spark: SparkSession, sf: str) -> DataFrame:
    raw = B.members(spark, sf).select(F.col("lat").alias("latitude"), (F.col("lon") - 100).alias("longitude"))
    return scans.normalise_coordinates(raw).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))


@query("to_canonical_units", ctes=B.CASES, doubles="geopotential", sql="""
  SELECT case_id, CASE WHEN sig_class IN ('click', 'view') THEN error_m * 9.80665 ELSE error_m END AS geopotential FROM cases""")
def to_canonical_units(spark: SparkSession, sf: str) -> DataFrame:
    units = (F.when(F.col("sig_class") == "click", "gpm").when(F.col("sig_class") == "view", "m").otherwise("m**2 s**-2"))
    return B.cases(spark, sf).select("case_id", S.canonical_geopotential("error_m", units).alias("geopotential"))


@query("provider_scan", ctes=B.MEMBERS, doubles="value", sql="""
  SELECT lead_day, cell, level, member, value FROM members WHERE init_time = TIMESTAMP '1997-03-01'""")
def provider_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scan_init(B.members(spark, sf), "1997-03-01").select("lead_day", "cell", "level", "member", "value")


@query("provenance", ctes=B.MEMBERS, sql="""
  SELECT n.n_name AS provider, m.init_time, count(DISTINCT m.member) AS n_members,
         array_to_string(list_sort(list(DISTINCT m.lead_day)), ',') AS leads,
         array_to_string(list_sort(list(DISTINCT m.level)), ',') AS levels,
         min(m.valid_time) AS first_valid, max(m.valid_time) AS last_valid, any_value(r.r_name) AS centre, false AS synthetic
  FROM members m JOIN nation n ON m.cell = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    n, r = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    facts = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("provider"), F.col("r_name").alias("centre"), F.lit(False).alias("synthetic"))
    m = B.members(spark, sf).join(n, F.col("cell") == F.col("n_nationkey")).withColumnRenamed("n_name", "provider")
    return scans.provenance(m, facts, lead="lead_day")


@query("table_scan", ctes=B.LABELLED, doubles="norm_error spread_m", sql="""
  SELECT case_id, norm_error, spread_m, bust, split FROM labelled WHERE split IN ('train', 'validation')""")
def table_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.write_table(B.labelled(spark, sf), scratch_path(spark, "case-table"))
    return sinks.scan_table(spark, path, ["case_id", "norm_error", "spread_m", "bust", "split"], ["train", "validation"])


@query("json_sink", ctes=B.CASES, doubles="ratio", sql="""
  SELECT case_id, CASE WHEN spread_m = 1 THEN NULL ELSE bias_m / (spread_m - 1) END AS ratio FROM cases""")
def json_sink(spark: SparkSession, sf: str) -> DataFrame:
    d = B.cases(spark, sf)
    odd = F.when(F.col("spread_m") == 1, F.lit(float("nan"))).otherwise(F.col("bias_m") / (F.col("spread_m") - 1))
    path = sinks.write_json(d.select("case_id", odd.alias("ratio")), scratch_path(spark, "json"))
    return spark.read.schema("case_id bigint, ratio double").json(path)


@query("memory_store", ctes=B.LABELLED, doubles="spread_m p_a", sql="""
  SELECT case_id, valid_time, region_id, bust, CAST(CAST(spread_m AS FLOAT) AS DOUBLE) AS spread_m,
         CAST(CAST(p_a AS FLOAT) AS DOUBLE) AS p_a, lead_day FROM labelled""")
def memory_store(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.write_memory(B.labelled(spark, sf), scratch_path(spark, "memory"), ["spread_m", "p_a"])
    return spark.read.parquet(path).select("case_id", "valid_time", "region_id", "bust", "spread_m", "p_a", "lead_day")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return B.trajectories(spark, sf).select(
        "init_time", "region_id", "lead_day", F.col("p_a").alias("p"), "spread_m",
        (F.col("p_a") >= B.ALERT).cast("int").alias("alert"), "error_m", (F.col("error_m") > 50).cast("int").alias("observed"))


@query("blind_case_docs", ctes=B.TRAJECTORIES, doubles="p spread_m", sql="""
  SELECT init_time, region_id, lead_day, p_a AS p, spread_m, CAST(p_a >= 0.5 AS INTEGER) AS alert FROM trajectories""")
def blind_case_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = sinks.blind_documents(_documents(spark, sf))
    path = sinks.write_json(docs, scratch_path(spark, "blind"))
    back = spark.read.schema("init_time timestamp, region_id string, "
                             "days array<struct<lead_day int, p double, spread_m double, alert int>>").json(path)
    return back.select("init_time", "region_id", F.inline("days"))


@query("verification_docs", ctes=B.TRAJECTORIES, doubles="error_m", sql="""
  SELECT init_time, region_id, lead_day, error_m, CAST(error_m > 50 AS INTEGER) AS observed FROM trajectories""")
def verification_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = sinks.verification_documents(_documents(spark, sf))
    path = sinks.write_json(docs, scratch_path(spark, "verification"))
    back = spark.read.schema("init_time timestamp, region_id string, "
                             "days array<struct<lead_day int, error_m double, observed int>>").json(path)
    return back.select("init_time", "region_id", F.inline("days"))


@query("registry_append", ctes=B.LABELLED, doubles="bust_rate", sql="""
  SELECT split, n_rows, bust_rate, unnest([1, 2]) AS run FROM (
    SELECT split, count(*) AS n_rows, avg(bust) AS bust_rate FROM labelled GROUP BY split)""")
def registry_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "registry")
    summary = B.labelled(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("bust").alias("bust_rate"))
    for run in (1, 2):
        sinks.append_registry(summary.withColumn("run", F.lit(run)), path)
    return spark.read.schema("split string, n_rows bigint, bust_rate double, run int").json(path)


@query("dataset_manifest", ctes=B.CASES, sql="""
  SELECT split, min(init_time) AS first_init, max(init_time) AS last_init, count(DISTINCT init_time) AS n_inits, count(*) AS n_rows
  FROM cases GROUP BY split""")
def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return scans.dataset_manifest(B.cases(spark, sf))


@query("spread_reference", ctes=B.CASES, doubles="spread_m", sql="""
  SELECT region_id, lead_day, season, spread_m FROM cases WHERE split = 'train'""")
def spread_reference(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "spread-reference")
    B.cases(spark, sf).where("split = 'train'").select("region_id", "lead_day", "season", "spread_m").write.parquet(path)
    return spark.read.parquet(path)


@query("case_state_export", ctes=B.LABELLED, doubles="spread_m spread_thr_ratio q_primary", sql="""
  SELECT case_id, region_id, lead_day, season, q_primary, spread_m, spread_thr_ratio, strftime(init_time, '%Y%m%d%H') AS case_init
  FROM labelled""")
def case_state_export(spark: SparkSession, sf: str) -> DataFrame:
    state = sinks.guard_forbidden(B.labelled(spark, sf).select(
        "case_id", "region_id", "lead_day", "season", "q_primary", "spread_m", "spread_thr_ratio",
        F.date_format("init_time", "yyyyMMddHH").alias("case_init")))
    path = sinks.write_table(state, scratch_path(spark, "case-state"), ["case_init"])
    schema = ("case_id bigint, region_id string, lead_day int, season string, q_primary double, spread_m double, "
              "spread_thr_ratio double, case_init string")
    return spark.read.schema(schema).parquet(path)


@query("guard_forbidden", ctes=B.LABELLED, doubles="spread_m", sql="SELECT case_id, lead_day, spread_m FROM labelled")
def guard_forbidden(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.guard_forbidden(B.labelled(spark, sf).select("case_id", "lead_day", "spread_m"))


@query("missing_blocks", ctes=B.MEMBERS + "," + B.REFERENCE, sql="""
  SELECT DISTINCT valid_time, cell FROM members EXCEPT SELECT valid_time, cell FROM reference""")
def missing_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return scans.missing_blocks(B.members(spark, sf), B.reference(spark, sf), ["valid_time", "cell"])
