"""Evaluation-metric queries over the labelled cases with two scores, p_a and p_b."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.evaluation import bootstrap as BS
from windrose.evaluation import ranking as R
from windrose.evaluation import scores as SC
from windrose.operators.ordered import grouped_quantiles
from windrose.plans import bridge as B
from windrose.plans.aggregates import PATTERN, pattern
from windrose.plans.registry import query

MODELS = {"a": "p_a", "b": "p_b"}


def test_rows(spark: SparkSession, sf: str) -> DataFrame:
    return B.labelled(spark, sf).where("split = 'test'")


def cum(name: str, source: str, by: str = "model", label: str = "bust", score: str = "p", weight: str = "1") -> str:
    """SQL: cumulated histogram ``name`` of (by, score)."""
    over = f"PARTITION BY {by}"
    return f"""{name} AS (SELECT {by}, s, pos, neg, sum(pos) OVER ({over} ORDER BY s DESC) AS tp, sum(neg) OVER ({over} ORDER BY s DESC) AS fp,
      sum(pos) OVER ({over}) AS p, sum(neg) OVER ({over}) AS n FROM (
      SELECT {by}, {score} AS s, CAST(sum({label} * {weight}) AS DOUBLE) AS pos, CAST(sum((1 - {label}) * {weight}) AS DOUBLE) AS neg
      FROM {source} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY ALL))"""


AUPRC = "sum(CASE WHEN p > 0 THEN pos / p * tp / (tp + fp) END)"
ROC = "sum(CASE WHEN p > 0 AND n > 0 THEN pos * (n - fp + neg / 2) / (p * n) END)"


def RAF(far: float) -> str:
    return f"coalesce(max(tp / p) FILTER (fp <= {far} * n), 0e0)"


_BOTH = """,
long AS (SELECT l.*, 'a' AS model, p_a AS p FROM labelled l UNION ALL SELECT l.*, 'b', p_b FROM labelled l),
test AS (SELECT * FROM long WHERE split = 'test')"""
LONG = B.LABELLED + _BOTH
HIST = LONG + "," + cum("h", "test")


def long_rows(spark: SparkSession, sf: str) -> DataFrame:
    return SC.models_to_rows(test_rows(spark, sf), MODELS, ["init_time", "region_id", "lead_day", "bust", "hidden_bust", "low_spread",
                                                            "norm_error", "q_primary"])


@query("auprc", ctes=HIST, doubles="auprc", sql=f"SELECT model, {AUPRC} AS auprc FROM h GROUP BY model")
def auprc(spark: SparkSession, sf: str) -> DataFrame:
    return R.auprc(long_rows(spark, sf), "bust", "p", ["model"])


@query("roc_auc", ctes=HIST, doubles="roc_auc", sql="""
  SELECT x.model, sum(CASE WHEN x.p > y.p THEN 1e0 WHEN x.p = y.p THEN 0.5e0 ELSE 0e0 END) / count(*) AS roc_auc
  FROM test x JOIN test y ON x.model = y.model AND x.bust = 1 AND y.bust = 0 GROUP BY x.model""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return R.roc_auc(long_rows(spark, sf), "bust", "p", ["model"])


@query("brier", ctes=LONG, doubles="brier", sql="SELECT model, avg((bust - p) * (bust - p)) AS brier FROM test GROUP BY model")
def brier(spark: SparkSession, sf: str) -> DataFrame:
    return SC.agg(long_rows(spark, sf), ["model"], SC.brier("bust", "p").alias("brier"))


@query("mae", ctes=LONG, doubles="mae", sql="SELECT model, avg(abs(bust - p)) AS mae FROM test GROUP BY model")
def mae(spark: SparkSession, sf: str) -> DataFrame:
    return SC.agg(long_rows(spark, sf), ["model"], SC.mae("bust", "p").alias("mae"))


@query("rmse", ctes=LONG, doubles="rmse", sql="SELECT model, sqrt(avg(pow(norm_error - p, 2))) AS rmse FROM test GROUP BY model")
def rmse(spark: SparkSession, sf: str) -> DataFrame:
    return SC.agg(long_rows(spark, sf), ["model"], SC.rmse("norm_error", "p").alias("rmse"))


_PIN = "avg(CASE WHEN error_m >= {q} THEN {l} * (error_m - {q}) ELSE ({l} - 1) * (error_m - {q}) END)"


@query("pinball", ctes=B.CASES, doubles="pinball", sql="SELECT split, " + _PIN.format(q="spread_m", l="0.9e0") + " AS pinball FROM cases GROUP BY split")
def pinball(spark: SparkSession, sf: str) -> DataFrame:
    return SC.agg(B.cases(spark, sf), ["split"], SC.pinball(F.col("error_m"), F.col("spread_m"), F.lit(0.9)).alias("pinball"))


@query("quantile_coverage", ctes=B.CASES, doubles="level coverage pinball", sql=" UNION ALL ".join(
    f"SELECT split, '{n}' AS quantile, {lv}e0 AS level, avg(CASE WHEN error_m <= {q} THEN 1e0 ELSE 0e0 END) AS coverage, "
    + _PIN.format(q=q, l=f"{lv}e0") + " AS pinball FROM cases GROUP BY split"
    for n, lv, q in (("q50", 0.5, "(spread_m * 0.7)"), ("q90", 0.9, "(spread_m * 2.0)"))))
def quantile_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = B.cases(spark, sf).withColumns({"q50": F.col("spread_m") * 0.7, "q90": F.col("spread_m") * 2.0})
    return SC.quantile_coverage(c, "error_m", {"q50": 0.5, "q90": 0.9}, ["split"])


@query("central_coverage", ctes=B.CASES, doubles="central_coverage mean_width", sql="""
  SELECT split, avg(CASE WHEN error_m >= spread_m * 0.5 AND error_m <= spread_m * 1.5 THEN 1e0 ELSE 0e0 END) AS central_coverage,
         avg(spread_m * 1.5 - spread_m * 0.5) AS mean_width FROM cases GROUP BY split""")
def central_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = B.cases(spark, sf).withColumns({"q25": F.col("spread_m") * 0.5, "q75": F.col("spread_m") * 1.5})
    return SC.central_coverage(c, "error_m", "q25", "q75", ["split"])


_EDGES = [i * 0.1 for i in range(1, 10)]
_BIN = "CAST(CASE " + " ".join(f"WHEN p < {e!r}e0 THEN {i}" for i, e in enumerate(_EDGES)) + " ELSE 9 END AS INTEGER)"
_REL = f"SELECT model, {_BIN} AS bin, count(*) AS n, avg(p) AS mean_pred, avg(bust) AS obs_freq FROM test GROUP BY ALL"


@query("reliability_curve", ctes=LONG, doubles="mean_pred obs_freq", sql=_REL)
def reliability_curve(spark: SparkSession, sf: str) -> DataFrame:
    return SC.reliability_curve(long_rows(spark, sf), "bust", "p", ["model"])


_ECE = f"SELECT model, sum(n * abs(mean_pred - obs_freq)) / sum(n) AS ece FROM ({_REL}) GROUP BY model"


@query("ece", ctes=LONG, doubles="ece", sql=_ECE)
def ece(spark: SparkSession, sf: str) -> DataFrame:
    return SC.ece(long_rows(spark, sf), "bust", "p", ["model"])


def _threshold(source: str) -> str:
    """SQL: the negative at 0-based position floor(far N) in descending order."""
    return f"""SELECT model, coalesce(max(p) FILTER (i = k), min(p)) AS threshold, count(*) FILTER (i = k) > 0 AS exclusive FROM (
      SELECT model, p, row_number() OVER (PARTITION BY model ORDER BY p DESC) - 1 AS i, floor(0.1e0 * count(*) OVER (PARTITION BY model)) AS k
      FROM {source} WHERE bust = 0) GROUP BY model"""


_VAL = "(SELECT * FROM long WHERE split = 'validation')"


@query("threshold_at_far", ctes=LONG, doubles="threshold", sql=_threshold(_VAL))
def threshold_at_far(spark: SparkSession, sf: str) -> DataFrame:
    va = SC.models_to_rows(B.labelled(spark, sf).where("split = 'validation'"), MODELS, ["bust"])
    return R.threshold_at_far(va, "bust", "p", 0.10, ["model"])


@query("recall_at_far", ctes=HIST, doubles="r05 r10", sql=f"SELECT model, {RAF(0.05)} AS r05, {RAF(0.1)} AS r10 FROM h GROUP BY model")
def recall_at_far(spark: SparkSession, sf: str) -> DataFrame:
    h = R.score_histogram(long_rows(spark, sf), "bust", "p", ["model"])
    return h.groupBy("model").agg(R.recall_at_far_column(0.05).alias("r05"), R.recall_at_far_column(0.10).alias("r10"))


_CONF = """SELECT model, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
    CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS false_alarm_rate FROM (
    SELECT model, count(*) FILTER (alert AND bust = 1) AS tp, count(*) FILTER (alert AND bust = 0) AS fp, count(*) FILTER (NOT alert AND bust = 1) AS fn,
           count(*) FILTER (NOT alert AND bust = 0) AS tn FROM alerted GROUP BY model)"""
_FIXED = LONG + ", alerted AS (SELECT *, p >= 0.5 AS alert FROM test)"


def fixed_alert():
    return F.col("p") >= B.ALERT


@query("confusion", ctes=_FIXED, doubles="precision recall false_alarm_rate", sql=_CONF)
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return SC.confusion(long_rows(spark, sf), "bust", fixed_alert(), ["model"])


_HIDDEN = """SELECT model, count(*) FILTER (hidden_bust = 1) AS n_hidden_busts, avg(CAST(alert AS INTEGER)) FILTER (hidden_bust = 1) AS hidden_bust_recall,
    avg(bust) FILTER (low_spread = 1 AND alert) AS low_spread_precision FROM alerted GROUP BY model"""


@query("hidden_bust", ctes=_FIXED + "," + cum("hl", "(SELECT * FROM test WHERE low_spread = 1)"), doubles="hidden_bust_recall low_spread_precision low_spread_auprc",
       sql=f"SELECT * FROM ({_HIDDEN}) JOIN (SELECT model, {AUPRC} AS low_spread_auprc FROM hl GROUP BY model) USING (model)")
def hidden_bust(spark: SparkSession, sf: str) -> DataFrame:
    rows = long_rows(spark, sf)
    return SC.hidden_bust(rows, fixed_alert(), ["model"]).join(SC.low_spread_auprc(rows, "p", ["model"]), "model")


@query("warning_lead", ctes=_FIXED, doubles="mean_lead_detected recall", sql="""
  SELECT model, lead_day, avg(CAST(alert AS INTEGER)) AS recall, count(*) AS n_busts, any_value(m) AS mean_lead_detected FROM alerted
  JOIN (SELECT model, avg(lead_day) FILTER (alert AND bust = 1) AS m FROM alerted GROUP BY model) USING (model) WHERE bust = 1 GROUP BY model, lead_day""")
def warning_lead(spark: SparkSession, sf: str) -> DataFrame:
    rows = long_rows(spark, sf)
    return SC.recall_by_lead(rows, fixed_alert(), ["model"]).join(SC.warning_lead(rows, fixed_alert(), ["model"]), "model")


_PEAK = """SELECT model, count(*) AS n_trajectories, avg(abs(dp - de)) AS mean_abs_peak_day_error, avg(CASE WHEN abs(dp - de) <= 1 THEN 1e0 ELSE 0e0 END) AS within_1_day
  FROM (SELECT model, init_time, region_id, arg_min(lead_day, struct_pack(a := -p, b := lead_day)) AS dp,
               arg_min(lead_day, struct_pack(a := -norm_error / q_primary, b := lead_day)) AS de, max(bust) AS any_bust FROM test GROUP BY ALL)
  WHERE any_bust = 1 GROUP BY model"""


@query("peak_day_error", ctes=LONG, doubles="mean_abs_peak_day_error within_1_day", sql=_PEAK)
def peak_day_error(spark: SparkSession, sf: str) -> DataFrame:
    return SC.peak_day_error(long_rows(spark, sf), "p", ["model"])


_OVERLAP = """SELECT model, count(*) AS n_maps, avg(i / u) AS mean_jaccard FROM (
    SELECT model, init_time, lead_day, count(*) FILTER (alert AND bust = 1) AS i, count(*) FILTER (alert OR bust = 1) AS u FROM alerted GROUP BY ALL)
  WHERE u > 0 GROUP BY model"""


@query("spatial_overlap", ctes=_FIXED, doubles="mean_jaccard", sql=_OVERLAP)
def spatial_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return SC.spatial_overlap(long_rows(spark, sf), fixed_alert(), ["model"])


def draws(n_boot: int, seed: int) -> str:
    return f"""days AS (SELECT d AS day, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS m FROM (
      SELECT DISTINCT CAST(init_time AS DATE) AS d FROM labelled WHERE split = 'test')),
    weights AS (SELECT rep, day, count(*) AS weight FROM (
      SELECT r AS rep, CAST('0x' || substr(md5('{seed}-' || r || '-' || i), 1, 8) AS BIGINT) % m AS k FROM days, range(0, {n_boot}) t(r)) x
      JOIN days ON days.i = x.k GROUP BY ALL)"""


_REP = cum("hb", "fan", by="model, rep", weight="weight")
_FAN = "fan AS (SELECT t.model, w.rep, t.p, t.bust, w.weight FROM test t JOIN weights w ON w.day = CAST(t.init_time AS DATE))"
_SUMMARY = """avg(d) AS mean, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi, avg(CASE WHEN d <= 0 THEN 1e0 ELSE 0e0 END) AS p_le_0, count(d) AS n_boot"""


@query("bootstrap_diff", ctes=LONG + "," + draws(300, 11) + "," + _FAN + "," + _REP, doubles="mean ci_lo ci_hi p_le_0", sql=f"""
  SELECT {_SUMMARY} FROM (SELECT rep, max(v) FILTER (model = 'a') - max(v) FILTER (model = 'b') AS d FROM (
    SELECT model, rep, {AUPRC} AS v FROM hb GROUP BY model, rep) GROUP BY rep)""")
def bootstrap_diff(spark: SparkSession, sf: str) -> DataFrame:
    return BS.auprc_difference(test_rows(spark, sf), "bust", "p_a", "p_b", 300, seed=11)


@query("bootstrap_metrics", ctes=B.LABELLED_TIES + _BOTH + "," + draws(300, 12) + """,
  all_weights AS (SELECT * FROM weights UNION ALL SELECT -1, day, 1 FROM days),
  fan AS (SELECT t.*, w.rep, w.weight FROM test t JOIN all_weights w ON w.day = CAST(t.init_time AS DATE)), thr AS (""" + _threshold(_VAL) + """),
  """ + _REP, doubles="point ci_lo ci_hi diff diff_lo diff_hi p_le_0", sql=f"""
  WITH rank AS (SELECT model, rep, {AUPRC} AS auprc, {RAF(0.1)} AS recall_at_far FROM hb GROUP BY model, rep),
  addm AS (SELECT f.model, rep, sum(weight * pow(bust - p, 2)) / sum(weight) AS brier,
            CAST(sum(weight) FILTER (hidden_bust = 1 AND CASE WHEN exclusive THEN p > threshold ELSE p >= threshold END) AS DOUBLE) AS hh,
            CAST(sum(weight) FILTER (hidden_bust = 1) AS DOUBLE) AS hn FROM fan f JOIN thr ON thr.model = f.model GROUP BY ALL),
  v AS (UNPIVOT (SELECT model, rep, auprc, brier, recall_at_far, coalesce(hh, 0) / hn AS hidden_recall FROM rank JOIN addm USING (model, rep))
        ON auprc, brier, recall_at_far, hidden_recall INTO NAME metric VALUE v),
  d AS (SELECT v.*, v.v - r.v AS d FROM v JOIN v r ON r.rep = v.rep AND r.metric = v.metric AND r.model = 'a')
  SELECT model, metric, max(v) FILTER (rep < 0) AS point, quantile_cont(v, 0.025) FILTER (rep >= 0) AS ci_lo, quantile_cont(v, 0.975) FILTER (rep >= 0) AS ci_hi,
         max(d) FILTER (rep < 0) AS diff, quantile_cont(d, 0.025) FILTER (rep >= 0) AS diff_lo, quantile_cont(d, 0.975) FILTER (rep >= 0) AS diff_hi,
         avg(CASE WHEN d <= 0 THEN 1e0 ELSE 0e0 END) FILTER (rep >= 0) AS p_le_0 FROM d GROUP BY model, metric""")
def bootstrap_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return BS.metric_intervals(test_rows(spark, sf), MODELS, threshold_at_far(spark, sf), 300, seed=12)


@query("bootstrap_auc_diff", ctes=PATTERN + "," + draws(200, 13) + """,
  test AS (SELECT 'a' AS model, init_time, pattern_bust AS bust, p_a AS p FROM pattern WHERE split = 'test'
           UNION ALL SELECT 'b', init_time, bust, p_a FROM pattern WHERE split = 'test'),""" + _FAN + "," + _REP, doubles="mean ci_lo ci_hi p_le_0", sql=f"""
  SELECT {_SUMMARY} FROM (SELECT rep, max(v) FILTER (model = 'a') - max(v) FILTER (model = 'b') AS d FROM (
    SELECT model, rep, {ROC} AS v FROM hb GROUP BY model, rep) GROUP BY rep)""")
def bootstrap_auc_diff(spark: SparkSession, sf: str) -> DataFrame:
    return BS.auc_difference(pattern(spark, sf).where("split = 'test'"), ("pattern_bust", "p_a"), ("bust", "p_a"), 200, seed=13)


_DQ = """WITH d AS (SELECT bust AS y, p_a, p_b, 100 * (p_a - p_b) AS d FROM labelled WHERE split = 'test')"""


@query("disagreement", ctes=B.LABELLED, doubles="observed_rate mean_p_model mean_p_base brier_model brier_base share", sql=_DQ + """,
  g AS (SELECT CASE WHEN d > 5 THEN 'model_higher' WHEN abs(d) <= 5 THEN 'agree' ELSE 'model_lower' END AS bin, count(*) AS n, avg(y) AS observed_rate,
          avg(p_a) AS mean_p_model, avg(p_b) AS mean_p_base, avg(pow(y - p_a, 2)) AS brier_model, avg(pow(y - p_b, 2)) AS brier_base FROM d GROUP BY 1)
  SELECT b.bin, coalesce(n, 0) AS n, observed_rate, mean_p_model, mean_p_base, brier_model, brier_base, coalesce(n, 0) / (SELECT count(*) FROM d) AS share
  FROM (VALUES ('model_higher'), ('agree'), ('model_lower')) b(bin) LEFT JOIN g ON g.bin = b.bin""")
def disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return SC.disagreement(test_rows(spark, sf), "bust", "p_a", "p_b")[1]


@query("disagreement_summary", ctes=B.LABELLED, doubles="mean_abs_pp share_gt_5pp share_gt_10pp q01 q05 q50 q95 q99", sql=_DQ + """
  SELECT avg(abs(d)) AS mean_abs_pp, avg(CASE WHEN abs(d) > 5 THEN 1e0 ELSE 0e0 END) AS share_gt_5pp, avg(CASE WHEN abs(d) > 10 THEN 1e0 ELSE 0e0 END) AS share_gt_10pp,
         quantile_cont(d, 0.01) AS q01, quantile_cont(d, 0.05) AS q05, quantile_cont(d, 0.5) AS q50, quantile_cont(d, 0.95) AS q95, quantile_cont(d, 0.99) AS q99 FROM d""")
def disagreement_summary(spark: SparkSession, sf: str) -> DataFrame:
    return SC.disagreement(test_rows(spark, sf), "bust", "p_a", "p_b")[0]


_FEAT = B.LABELLED + """,
feat AS (SELECT split, lead_day, bust, low_spread, 'spread_m' AS feature, spread_m AS p FROM labelled UNION ALL
         SELECT split, lead_day, bust, low_spread, 'p_b', p_b FROM labelled UNION ALL
         SELECT split, lead_day, bust, low_spread, 'part', CASE WHEN spread_m > 20 THEN p_a END FROM labelled)"""


def _feat(spark: SparkSession, sf: str) -> DataFrame:
    return B.labelled(spark, sf).withColumn("part", F.when(F.col("spread_m") > 20, F.col("p_a")))


FEATS = ["spread_m", "p_b", "part"]


@query("univariate_auc", ctes=_FEAT + "," + cum("hf", "feat", by="split, feature"), doubles="roc_auc", sql=f"""
  SELECT split, feature, {ROC} AS roc_auc, CAST(max(p + n) AS BIGINT) AS n FROM hf WHERE split IN ('train', 'validation') GROUP BY split, feature""")
def univariate_auc(spark: SparkSession, sf: str) -> DataFrame:
    return SC.univariate_auc(_feat(spark, sf).where("split IN ('train', 'validation')"), FEATS)


@query("stratified_auc", ctes=_FEAT + "," + cum("hf", "feat", by="split, feature, lead_day"), doubles="auc_given_stratum", sql=f"""
  SELECT split, feature, sum(np * auc) / sum(np) AS auc_given_stratum, count(*) AS n_strata FROM (
    SELECT split, feature, lead_day, {ROC} AS auc, max(p) AS np, max(n) AS nn FROM hf GROUP BY ALL) WHERE np >= 20 AND nn > 20 GROUP BY split, feature""")
def stratified_auc(spark: SparkSession, sf: str) -> DataFrame:
    return SC.stratified_auc(_feat(spark, sf), FEATS, "lead_day")


@query("metrics_by_dimension", ctes=B.LABELLED + """,
  dim AS (SELECT bust, p_a AS p, 'lead_day' AS dimension, CAST(lead_day AS VARCHAR) AS level FROM labelled WHERE split = 'test' UNION ALL
          SELECT bust, p_a, 'region_id', region_id FROM labelled WHERE split = 'test' UNION ALL SELECT bust, p_a, 'season', season FROM labelled WHERE split = 'test'),
  """ + cum("hd", "dim", by="dimension, level"), doubles="rate brier auprc roc_auc", sql=f"""
  SELECT * FROM (SELECT dimension, level, count(*) AS n, avg(bust) AS rate, avg(pow(bust - p, 2)) AS brier FROM dim GROUP BY ALL)
  JOIN (SELECT dimension, level, {AUPRC} AS auprc, {ROC} AS roc_auc FROM hd GROUP BY ALL) USING (dimension, level)""")
def metrics_by_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return SC.metrics_by_dimension(test_rows(spark, sf), ["lead_day", "region_id", "season"], "bust", "p_a")


@query("regional_stability", ctes=LONG + "," + cum("hr", "test", by="model, region_id"), doubles="median p10 p90 share_not_worse", sql=f"""
  WITH r AS (SELECT region_id, {AUPRC} FILTER (model = 'a') AS a, {AUPRC} FILTER (model = 'b') AS b FROM hr GROUP BY region_id)
  SELECT quantile_cont(a, 0.5) AS median, quantile_cont(a, 0.1) AS p10, quantile_cont(a, 0.9) AS p90, avg(CASE WHEN a >= b THEN 1e0 ELSE 0e0 END) AS share_not_worse,
         count(*) AS n_regions FROM r""")
def regional_stability(spark: SparkSession, sf: str) -> DataFrame:
    h = R.score_histogram(long_rows(spark, sf), "bust", "p", ["model", "region_id"]).groupBy("model", "region_id").agg(R.auprc_column().alias("v"))
    wide = h.groupBy("region_id").agg(F.max(F.when(F.col("model") == "a", F.col("v"))).alias("a"), F.max(F.when(F.col("model") == "b", F.col("v"))).alias("b"))
    return SC.regional_stability(wide, "a", "b")


@query("brier_skill", ctes=HIST, doubles="brier_skill lift", sql=f"""
  WITH c AS (SELECT avg(bust) AS rate FROM labelled WHERE split = 'validation')
  SELECT t.model, 1 - avg(pow(bust - p, 2)) / avg(pow(bust - rate, 2)) AS brier_skill, any_value(a.auprc) / avg(bust) AS lift
  FROM test t, c, (SELECT model, {AUPRC} AS auprc FROM h GROUP BY model) a WHERE a.model = t.model GROUP BY t.model""")
def brier_skill(spark: SparkSession, sf: str) -> DataFrame:
    rate = B.labelled(spark, sf).where("split = 'validation'").agg(F.avg("bust")).scalar()
    rows = long_rows(spark, sf).withColumn("_c", rate)
    g = rows.groupBy("model").agg((1 - SC.brier("bust", "p") / SC.brier("bust", "_c")).alias("brier_skill"), F.avg("bust").alias("_rate"))
    return g.join(R.auprc(rows, "bust", "p", ["model"]), "model").select("model", "brier_skill", (F.col("auprc") / F.col("_rate")).alias("lift"))


BOARD = HIST + ", thr AS (" + _threshold(_VAL) + """),
  alerted AS (SELECT t.*, CASE WHEN exclusive THEN p > threshold ELSE p >= threshold END AS alert FROM test t JOIN thr ON thr.model = t.model),
  """ + cum("hl", "(SELECT * FROM test WHERE low_spread = 1)") + f""",
  board AS (SELECT * FROM (SELECT model, {AUPRC} AS auprc, {ROC} AS roc_auc, {RAF(0.05)} AS recall_at_far_5, {RAF(0.1)} AS recall_at_far_10 FROM h GROUP BY model)
    JOIN (SELECT model, avg(pow(bust - p, 2)) AS brier, count(*) AS n_rows FROM test GROUP BY model) USING (model) JOIN ({_ECE}) USING (model)
    JOIN ({_CONF}) USING (model) JOIN ({_HIDDEN}) USING (model) JOIN (SELECT model, {AUPRC} AS low_spread_auprc FROM hl GROUP BY model) USING (model)
    JOIN (SELECT model, avg(lead_day) FILTER (alert AND bust = 1) AS mean_lead_detected FROM alerted GROUP BY model) USING (model)
    JOIN ({_PEAK}) USING (model) JOIN ({_OVERLAP}) USING (model) JOIN (SELECT model, threshold FROM thr) USING (model))"""
_BOARD_D = """auprc roc_auc recall_at_far_5 recall_at_far_10 brier ece precision recall false_alarm_rate hidden_bust_recall low_spread_precision low_spread_auprc
mean_lead_detected mean_abs_peak_day_error within_1_day mean_jaccard threshold"""


@query("scoreboard", ctes=BOARD, doubles=_BOARD_D, sql="SELECT * FROM board")
def scoreboard(spark: SparkSession, sf: str) -> DataFrame:
    return SC.scoreboard(B.labelled(spark, sf), MODELS)


@query("gate", ctes=BOARD, sql="""
  WITH m AS (SELECT max(auprc) FILTER (model = 'a') - max(auprc) FILTER (model = 'b') >= 0.01 AS auprc_gain, max(brier) FILTER (model = 'a') <= max(brier) FILTER (model = 'b') + 0.001 AS brier_ok,
                    max(ece) FILTER (model = 'a') <= 0.5 AS ece_ok FROM board)
  SELECT CAST(auprc_gain AS INTEGER) AS auprc_gain, CAST(brier_ok AS INTEGER) AS brier_ok, CAST(ece_ok AS INTEGER) AS ece_ok,
         CASE WHEN auprc_gain AND brier_ok AND ece_ok THEN 'GO' ELSE 'NO-GO' END AS decision FROM m""")
def gate(spark: SparkSession, sf: str) -> DataFrame:
    b = scoreboard(spark, sf)
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))          # noqa: E731
    one = b.agg(*[of(m, c).alias(f"{c}_{m}") for m in MODELS for c in ("auprc", "brier", "ece")])
    return SC.gate({"auprc_gain": F.col("auprc_a") - F.col("auprc_b") >= 0.01, "brier_ok": F.col("brier_a") <= F.col("brier_b") + 0.001,
                    "ece_ok": F.col("ece_a") <= 0.5}, one)


_CELLS = ", ".join(f"coalesce(printf('%.4f', {c}), '-')" for c in ("auprc", "roc_auc", "brier", "ece", "recall"))


@query("report_tables", ctes=BOARD, sql=f"SELECT model, '| ' || concat_ws(' | ', model, {_CELLS}, CAST(n_rows AS VARCHAR)) || ' |' AS line FROM board")
def report_tables(spark: SparkSession, sf: str) -> DataFrame:
    return SC.report_lines(scoreboard(spark, sf), ["model", "auprc", "roc_auc", "brier", "ece", "recall", "n_rows"])


@query("auprc_ceiling", ctes=B.LABELLED + """,
  sim AS (SELECT split, r AS rep, p_a AS p, CASE WHEN CAST('0x' || substr(md5('5-' || r || '-' || case_id), 1, 8) AS BIGINT) / 4294967296e0 < p_a THEN 1 ELSE 0 END AS bust
          FROM labelled, range(0, 20) t(r)), """ + cum("hs", "sim", by="split, rep"), doubles="ceiling_auprc ceiling_sd", sql=f"""
  SELECT split, avg(v) AS ceiling_auprc, stddev_pop(v) AS ceiling_sd, count(v) AS n_rep FROM (SELECT split, rep, {AUPRC} AS v FROM hs GROUP BY split, rep) GROUP BY split""")
def auprc_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return BS.auprc_ceiling(B.labelled(spark, sf), "p_a", "case_id", ["split"], 20, seed=5)


@query("spearman", ctes=B.LABELLED, doubles="spearman", sql="""
  SELECT split, corr(ra, rb) AS spearman FROM (
    SELECT split, rank() OVER (PARTITION BY split ORDER BY p_a) + (count(*) OVER (PARTITION BY split, p_a) - 1) / 2e0 AS ra,
           rank() OVER (PARTITION BY split ORDER BY p_b) + (count(*) OVER (PARTITION BY split, p_b) - 1) / 2e0 AS rb FROM labelled) GROUP BY split""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return SC.spearman(B.labelled(spark, sf), "p_a", "p_b", ["split"])


_LOW = "(SELECT * FROM long WHERE split = 'validation' AND low_spread = 1)"


@query("regime_diagnosis", ctes=LONG + "," + cum("hv", _LOW), doubles="auprc roc_auc lift_over_base threshold p_q99", sql=f"""
  SELECT model, auprc, roc_auc, auprc / rate AS lift_over_base, threshold, p_q99, n_rows FROM (SELECT model, {AUPRC} AS auprc, {ROC} AS roc_auc FROM hv GROUP BY model)
  JOIN (SELECT model, avg(bust) AS rate, quantile_cont(p, 0.99) AS p_q99, count(*) AS n_rows FROM {_LOW} GROUP BY model) USING (model) JOIN ({_threshold(_LOW)}) USING (model)""")
def regime_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    va = B.labelled(spark, sf).where("split = 'validation' AND low_spread = 1")
    rows = SC.models_to_rows(va, MODELS, ["bust"])
    m = R.ranking_metrics(rows, "bust", "p", ["model"], fars=())
    base = rows.groupBy("model").agg(F.avg("bust").alias("_rate"), F.count(F.lit(1)).alias("n_rows"))
    thr = R.threshold_at_far(rows, "bust", "p", 0.10, ["model"], strict=False).drop("exclusive")
    q = grouped_quantiles(rows, ["model"], "p", {"p_q99": 0.99})
    return (m.join(base, "model").join(thr, "model").join(q, "model")
            .select("model", "auprc", "roc_auc", (F.col("auprc") / F.col("_rate")).alias("lift_over_base"), "threshold", "p_q99", "n_rows"))


@query("regime_features", ctes=_FEAT + "," + cum("hf", "(SELECT * FROM feat WHERE split = 'validation' AND low_spread = 1)", by="feature"), doubles="roc_auc abs_auc_minus_half",
       sql=f"SELECT feature, {ROC} AS roc_auc, abs({ROC} - 0.5) AS abs_auc_minus_half FROM hf GROUP BY feature ORDER BY 3 DESC, feature LIMIT 10")
def regime_features(spark: SparkSession, sf: str) -> DataFrame:
    va = _feat(spark, sf).where("split = 'validation' AND low_spread = 1")
    u = SC.univariate_auc(va, FEATS, by=()).drop("n").withColumn("abs_auc_minus_half", F.abs(F.col("roc_auc") - 0.5))
    return u.orderBy(F.desc("abs_auc_minus_half"), "feature").limit(10)
