"""Evidence, serving-view and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrose.functions import text as TX
from windrose.operators import labels as L
from windrose.operators import memory as M
from windrose.plans import bridge as B
from windrose.plans import evaluation as EV
from windrose.plans import memory as PM
from windrose.plans import models as MO
from windrose.plans import scans as PS
from windrose.plans.registry import query
from windrose.products import views as V
from windrose.session import scratch_path
from windrose.streaming import jobs as J

_T = {k: v.replace("'", "''") for k, v in TX.EVIDENCE_TEMPLATES.items()}
_EV = B.LABELLED + """,
ev AS (SELECT l.case_id, spread_m, p_b / 2 AS m_sign_agree, p_a, p_b, CAST(case_id % 50 AS BIGINT) AS n_el, CAST(lead_day AS BIGINT) AS n_in,
         CASE WHEN spread_m > 10 THEN p_a END AS rate, 0.1e0 AS base, CASE WHEN spread_m > 50 THEN bias_m END AS rev, bias_m, error_m, error_m AS rev_nb, p_b AS rev_pct, t.pct
  FROM labelled l JOIN (SELECT l.case_id AS id, count(t.case_id) FILTER (t.spread_m <= l.spread_m) / nullif(count(t.case_id), 0) AS pct FROM labelled l
    LEFT JOIN (SELECT * FROM labelled WHERE split = 'train') t ON t.region_id = l.region_id AND t.lead_day = l.lead_day AND t.season = l.season GROUP BY 1) t ON t.id = l.case_id)"""


@query("evidence_text", ctes=_EV, sql=f"""
  SELECT case_id, 'A. Ensemble evidence' AS kind, printf('{_T["spread"]}', spread_m + 1e-9, 100 * pct + 1e-9, 100 * m_sign_agree + 1e-9) AS text FROM ev WHERE pct IS NOT NULL
  UNION ALL SELECT case_id, 'C. Historical evidence', CASE WHEN rate IS NOT NULL THEN printf('{_T["history"]}', n_el, n_in, 100 * rate + 1e-9, 100 * base + 1e-9) ELSE '{_T["history_missing"]}' END FROM ev
  UNION ALL SELECT case_id, 'D. Forecast-evolution evidence', CASE WHEN rev IS NOT NULL THEN printf('{_T["evolution"]}', rev + 1e-9, rev_nb + 1e-9, 100 * rev_pct + 1e-9) ELSE '{_T["evolution_missing"]}' END FROM ev
  UNION ALL SELECT case_id, 'B. Atmospheric-state evidence', printf('{_T["state"]}', bias_m + 1e-9, 100 * p_a + 1e-9, p_b + 1e-9) FROM ev
  UNION ALL SELECT case_id, 'C2. Recent verified error behaviour', printf('{_T["recent"]}', p_b + 1e-9, bias_m + 1e-9, 100 * p_a + 1e-9, n_el, p_a + 1e-9, error_m / 50 + 1e-9) FROM ev WHERE rate IS NOT NULL
  UNION ALL SELECT case_id, 'E. Predicted error distribution', printf('{_T["distribution"]}', p_a + 1e-9, p_a / 2 + 1e-9, p_a * 2 + 1e-9, p_a * 3 + 1e-9, p_b + 1e-9, 100 * p_a + 1e-9, 100 * p_b + 1e-9) FROM ev
  UNION ALL SELECT case_id, 'alert', CASE WHEN p_a >= 0.4 THEN 'At or above' ELSE 'Below' END || printf(' the alert threshold %.1f%% (10%% false-alarm rate on validation).', 40 + 1e-9) FROM ev
  UNION ALL SELECT case_id, 'tail', printf('The predicted upper-tail error (%.2fx) ', p_a * 3 + 1e-9) || CASE WHEN p_a * 3 > p_b THEN 'is above' ELSE 'stays below' END
         || printf(' the project bust threshold (%.2fx).', p_b + 1e-9) FROM ev
  UNION ALL SELECT case_id, 'E. Baseline comparison', printf('{_T["baseline"]}', 100 * p_a + 1e-9, 100 * p_b + 1e-9, 100 * (p_a - p_b) + 1e-9) FROM ev""")
def evidence_text(spark: SparkSession, sf: str) -> DataFrame:
    lab = L.spread_percentile(B.labelled(spark, sf)).withColumns({
        "m_sign_agree": F.col("p_b") / 2, "an_n_eligible": F.col("case_id") % 50, "an_n_within": F.col("lead_day"),
        "an_bust_rate": F.when(F.col("spread_m") > 10, F.col("p_a")), "base_rate": F.lit(0.1),
        "rev_region": F.when(F.col("spread_m") > 50, F.col("bias_m")), "rev_nbhd": F.col("error_m"), "rev_nbhd_pct": F.col("p_b"),
        "anom500": F.col("bias_m"), "abs_anom_pct": F.col("p_a"), "pc_norm": F.col("p_b"), "rec_err": F.when(F.col("spread_m") > 10, F.col("p_b")),
        "rec_bias": F.col("bias_m"), "rec_bust_rate": F.col("p_a"), "rec_n": F.col("case_id") % 50, "rec_err_nbhd": F.col("p_a"), "rec_err_domain": F.col("error_m") / 50,
        "q25": F.col("p_a") / 2, "q50": F.col("p_a"), "q75": F.col("p_a") * 2, "q95": F.col("p_a") * 3})
    statement = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))      # noqa: E731
    items = TX.evidence_list(TX.spread_evidence(), TX.state_evidence(), TX.history_evidence(), TX.recent_evidence(), TX.evolution_evidence(),
                             TX.baseline_evidence("p_a", "p_b"), TX.distribution_evidence("p_a", "p_b", "p_b"),
                             statement("alert", TX.alert_statement("p_a", F.lit(0.4))), statement("tail", TX.tail_statement("q95", "p_b")))
    return lab.select("case_id", F.inline(items))


@query("feature_dim", ctes=B.LABELLED, doubles="mean", sql="""
  SELECT feature, mean, CASE feature WHEN 'rec_err' THEN 'REC' ELSE 'SPREAD' END AS group_name,
    CASE feature WHEN 'spread_m' THEN 'Z500 ensemble spread (m)' WHEN 'lead_day' THEN 'lead day'
         ELSE 'spread relative to the bust threshold (spread / TRAIN Q90 error, m/m)' END AS label
  FROM (SELECT 'spread_m' AS feature, avg(spread_m) AS mean FROM labelled UNION ALL SELECT 'lead_day', avg(lead_day) FROM labelled
        UNION ALL SELECT 'spread_thr_ratio', avg(spread_thr_ratio) FROM labelled)""")
def feature_dim(spark: SparkSession, sf: str) -> DataFrame:
    lab = B.labelled(spark, sf).select("case_id", "spread_m", F.col("lead_day").cast("double").alias("lead_day"), "spread_thr_ratio")
    means = lab.unpivot(["case_id"], ["spread_m", "lead_day", "spread_thr_ratio"], "feature", "x").groupBy("feature").agg(F.avg("x").alias("mean"))
    return means.join(F.broadcast(V.feature_dimension(spark)), "feature")        # fewer than a hundred features


@query("top_drivers", ctes=B.CASES, doubles="contribution", sql="""
  WITH c AS (SELECT case_id, 'spread_m' AS feature, (spread_m - 50) / 30 AS contribution FROM cases UNION ALL SELECT case_id, 'p_b', p_b - 0.5 FROM cases
             UNION ALL SELECT case_id, 'lead_day', (3 - lead_day) / 4e0 FROM cases)
  SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank, feature, contribution,
         CASE WHEN contribution > 0 THEN 'raises risk' ELSE 'lowers risk' END AS direction FROM c
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY abs(contribution) DESC, feature) <= 2""")
def top_drivers(spark: SparkSession, sf: str) -> DataFrame:
    return V.top_drivers(B.cases(spark, sf), {"spread_m": (F.col("spread_m") - 50) / 30, "p_b": F.col("p_b") - 0.5, "lead_day": (3 - F.col("lead_day")) / 4.0}, 2)


RECORDS = B.CASES + """,
served AS (SELECT *, CAST(case_id % 4 AS INTEGER) AS support, CAST(spread_m - 1 AS INTEGER) AS n_in, CASE WHEN p_b > 0 THEN p_b END AS rate, 0.3e0 AS base FROM cases),
graded AS (SELECT *, CASE WHEN support >= 3 OR n_in < 5 THEN 3 WHEN support = 0 AND n_in >= 20 AND coalesce(abs(rate - p_a) <= 0.25, false) THEN 0
             WHEN support <= 1 AND n_in >= 10 THEN 1 ELSE 2 END AS ev FROM served),
records AS (SELECT case_id, init_time, region_id, lead_day, valid_time, p_a AS bust_probability, p_b AS b0_probability,
  CASE WHEN p_a >= 0.5 THEN 'ALERT' WHEN p_a > p_b THEN 'ABOVE CLIMATOLOGY' ELSE 'AT OR BELOW CLIMATOLOGY' END AS risk_level, CAST(p_a >= 0.5 AS INTEGER) AS alert,
  CASE WHEN rate IS NULL OR n_in < 5 THEN 'INSUFFICIENT' WHEN rate >= 2 * base THEN 'HIGH' WHEN rate > 1.25 * base THEN 'ELEVATED' ELSE 'NORMAL' END AS analogue_evidence,
  ['NORMAL SUPPORT', 'MODERATE SUPPORT', 'WEAK SUPPORT', 'INSUFFICIENT HISTORICAL SUPPORT'][support + 1] AS support,
  ['STRONG', 'MODERATE', 'WEAK', 'INSUFFICIENT HISTORICAL SUPPORT'][ev + 1] AS evidence_quality,
  p_a * pow(0.5e0, (lead_day - 1) / 5e0) * [1.0e0, 0.85e0, 0.7e0, 0.5e0][ev + 1] AS priority_score FROM graded)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.cases(spark, sf).withColumns({
        "support_level": (F.col("case_id") % 4).cast("int"), "n_within": (F.col("spread_m") - 1).cast("int"), "n_used": (F.col("spread_m") - 1).cast("int"),
        "analogue_rate": F.when(F.col("p_b") > 0, F.col("p_b")), "base_rate": F.lit(0.3)})
    return V.cell_record(rows, "p_a", "p_b", B.ALERT)


@query("cell_record", ctes=RECORDS, doubles="bust_probability b0_probability priority_score", sql="SELECT * FROM records")
def cell_record(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)


@query("case_overview", ctes=RECORDS, doubles="mean_p peak_p", sql="""
  SELECT init_time, n_cells, n_alerts, mean_p, peak_p, queue FROM (
    SELECT init_time, count(*) AS n_cells, CAST(sum(alert) AS BIGINT) AS n_alerts, avg(bust_probability) AS mean_p, max(bust_probability) AS peak_p FROM records GROUP BY init_time)
  JOIN (SELECT init_time, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY r) AS queue FROM (
    SELECT init_time, case_id, row_number() OVER (PARTITION BY init_time ORDER BY priority_score DESC, case_id) AS r FROM records) WHERE r <= 20 GROUP BY init_time) USING (init_time)""")
def case_overview(spark: SparkSession, sf: str) -> DataFrame:
    return V.case_overview(records(spark, sf))


@query("region_trajectory", ctes=B.TRAJECTORIES, doubles="p_a spread_m", sql="""
  SELECT init_time, lead_day, p_a, spread_m FROM trajectories WHERE region_id = 'R0101'""")
def region_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return B.trajectories(spark, sf).where("region_id = 'R0101'").select("init_time", "lead_day", "p_a", "spread_m")


@query("evidence_view", ctes=B.TRAJECTORIES, doubles="p_a spread_m", sql="""
  SELECT init_time, region_id, lead_day, p_a, spread_m FROM trajectories
  QUALIFY row_number() OVER (PARTITION BY init_time, region_id ORDER BY p_a DESC, lead_day) = 1""")
def evidence_view(spark: SparkSession, sf: str) -> DataFrame:
    return V.default_lead(B.trajectories(spark, sf), "p_a").select("init_time", "region_id", "lead_day", "p_a", "spread_m")


@query("history_view", ctes=PM.EXPECTED, doubles=PM._P3, sql="""
  SELECT e.*, nearest FROM expected e JOIN (SELECT case_id, string_agg(CAST(neighbour AS VARCHAR), ',' ORDER BY rank) AS nearest FROM knn WHERE rank <= 5 GROUP BY case_id) USING (case_id)""")
def history_view(spark: SparkSession, sf: str) -> DataFrame:
    listing = M.nearest_listing(PM.neighbours(spark, sf), PM.standardised(spark, sf), 5)
    return V.history_view(listing, PM.expected(spark, sf))


@query("reveal", ctes=PM.EXPECTED, doubles="norm_error", sql="""
  SELECT z.case_id, CAST(norm_error / 10 >= 0.5 AS INTEGER) AS alert, bust AS actual_bust, norm_error, expected_top, CASE WHEN bust = 1 THEN sig_class END AS actual_signature,
         CASE WHEN bust = 1 THEN CAST(expected_top = sig_class AS INTEGER) END AS signature_match FROM z LEFT JOIN expected USING (case_id)""")
def reveal(spark: SparkSession, sf: str) -> DataFrame:
    z = PM.standardised(spark, sf).withColumn("p", F.col("norm_error") / 10)
    return V.reveal(z, PM.expected(spark, sf), "p", 0.5)


_BUNDLE = ("auprc", "roc_auc", "brier", "ece", "recall", "hidden_bust_recall", "mean_jaccard")


@query("metrics_bundle", ctes=EV.BOARD, doubles="value", sql=" UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM board" for m in _BUNDLE))
def metrics_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return V.metrics_bundle(EV.scoreboard(spark, sf), _BUNDLE)


@query("provider_status", ctes=B.MEMBERS, sql="""
  SELECT provider, count(*) AS n_inits, min(init_time) AS first_init, max(init_time) AS last_init, min(n_members) AS min_members,
         count(*) FILTER (n_leads = 7) AS complete_inits, CAST(min(n_members) >= 10 AND count(*) FILTER (n_leads = 7) = count(*) AS INTEGER) AS ready
  FROM (SELECT n_name AS provider, init_time, count(DISTINCT member) AS n_members, count(DISTINCT lead_day) AS n_leads FROM members JOIN nation ON cell = n_nationkey GROUP BY ALL)
  GROUP BY provider""")
def provider_status(spark: SparkSession, sf: str) -> DataFrame:
    return V.provider_status(PS.provenance(spark, sf), range(1, 8), 10)


@query("field_arrays", ctes=B.GRID, doubles="z", sql="""
  SELECT init_time, CAST(dense_rank() OVER (PARTITION BY init_time ORDER BY lead_day) - 1 AS INTEGER) AS i,
         CAST(dense_rank() OVER (PARTITION BY init_time, lead_day ORDER BY col_n) - 1 AS INTEGER) AS j,
         CAST(row_number() OVER (PARTITION BY init_time, lead_day, col_n ORDER BY row_n) - 1 AS INTEGER) AS k, z FROM grid""")
def field_arrays(spark: SparkSession, sf: str) -> DataFrame:
    f = V.field_arrays(B.grid(spark, sf), "z")
    a = f.select("init_time", F.posexplode("field").alias("i", "x")).select("init_time", "i", F.posexplode("x").alias("j", "y"))
    return a.select("init_time", "i", "j", F.posexplode("y").alias("k", "z"))


# --- streams: the tables replayed as files in time order ---------------------------------------------------------------------

FILE_ROWS = 1_000_000


def _files(df: DataFrame, time: str, name: str) -> str:
    """A folder of files written one after the other in time order, the stand-in for an arriving stream: the file source reads by
    modification time.  A file holds one day or part of it, less than the streams' lateness, so however the files of a day are
    dealt to micro-batches, none brings rows behind the watermark of an earlier one."""
    spark = df.sparkSession
    days, path = scratch_path(spark, f"{name}-days"), scratch_path(spark, name)
    df.where(F.col(time).isNotNull()).withColumn("_day", F.to_date(time)).write.partitionBy("_day").parquet(days)
    kept = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_day", T.DateType())])).parquet(days)
    for day, n in sorted(map(tuple, kept.groupBy("_day").count().collect())):          # a row for each day of the calendar
        kept.where(F.col("_day") == day).drop("_day").coalesce(-(-n // FILE_ROWS)).write.mode("append").parquet(path)
    return path


@query("stream_verified", ctes=B.TRAJECTORIES, doubles="p_a observed", sql="""
  WITH v AS (SELECT init_time AS valid_time, region_id, avg(error_m) AS observed FROM cases GROUP BY ALL)
  SELECT t.init_time, t.region_id, t.lead_day, t.p_a, v.observed FROM (SELECT *, init_time + INTERVAL 1 DAY * lead_day AS valid_time FROM trajectories) t
  JOIN v ON v.valid_time = t.valid_time AND v.region_id = t.region_id""")
def stream_verified(spark: SparkSession, sf: str) -> DataFrame:
    f = B.trajectories(spark, sf).select("init_time", "region_id", "lead_day", "p_a", (F.col("init_time") + F.make_dt_interval(F.col("lead_day"))).alias("valid_time"))
    v = B.cases(spark, sf).groupBy(F.col("init_time").alias("valid_time"), "region_id").agg(F.avg("error_m").alias("observed"))
    fs = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 2).parquet(_files(f, "init_time", "forecasts"))
    vs = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 2).parquet(_files(v, "valid_time", "verification"))
    out = J.run_available(J.verified_forecasts(fs, vs, 5, lateness="2 days"), "verified")
    return spark.read.parquet(out).select("init_time", "region_id", "lead_day", "p_a", "observed")


@query("stream_recent", ctes=B.LABELLED, doubles="rec_err rec_bias", sql="""
  WITH facts AS (SELECT region_id, valid_time, norm_error, bias_m FROM labelled WHERE lead_day <= 3),
  ends AS (SELECT DISTINCT date_trunc('day', valid_time) + INTERVAL 1 DAY * CAST(k AS INTEGER) AS t FROM facts, range(0, 6) r(k))
  SELECT f.region_id, t AS init_time, avg(norm_error) AS rec_err, avg(bias_m) AS rec_bias, count(*) AS rec_n FROM facts f JOIN ends
  ON f.valid_time <= t AND f.valid_time > t - INTERVAL 5 DAY GROUP BY ALL""")
def stream_recent(spark: SparkSession, sf: str) -> DataFrame:
    facts = B.labelled(spark, sf).where("lead_day <= 3").select("region_id", "valid_time", "norm_error", "bias_m")
    s = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 2).parquet(_files(facts, "valid_time", "facts"))
    out = J.run_available(J.trailing_errors(s, lateness="2 days"), "recent", mode="update")
    return J.latest(spark.read.parquet(out), ["region_id", "init_time"])


@query("stream_scores")
def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    model = MO.base_model(spark, sf)
    rows = MO.test(spark, sf).select("case_id", "init_time", *MO.SPREAD)
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(_files(rows, "init_time", "cases"))
    out = J.run_available(s, "scores", transform=lambda b: model.score(b).select("case_id", "raw_probability", "bust_probability"))
    return spark.read.parquet(out).select("case_id", "raw_probability", "bust_probability")


@query("stream_scores_check", ctes=B.LABELLED, sql="SELECT case_id, true AS stream_equals_batch FROM labelled WHERE split = 'test'")
def stream_scores_check(spark: SparkSession, sf: str) -> DataFrame:
    batch = MO.base_model(spark, sf).score(MO.test(spark, sf)).select("case_id", F.col("bust_probability").alias("_p"))
    return stream_scores(spark, sf).join(batch, "case_id").select("case_id", (F.abs(F.col("bust_probability") - F.col("_p")) < 1e-12).alias("stream_equals_batch"))
