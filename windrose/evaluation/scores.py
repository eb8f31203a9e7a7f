"""Probability, calibration, alert and spatial metrics; every metric is a grouped aggregation over case rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.evaluation import ranking as R
from windrose.operators.ordered import average_ranks, grouped_quantiles
from windrose.session import stored_once


def _sq(c: Column) -> Column:
    return c * c


def agg(df: DataFrame, by: Sequence[str], *cols: Column) -> DataFrame:
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def brier(y, p) -> Column:
    return F.avg(_sq(F.col(y) - F.col(p)))


def mae(y, p) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def rmse(y, p) -> Column:
    return F.sqrt(F.avg(_sq(F.col(y) - F.col(p))))


def pinball(y: Column, q: Column, level: Column) -> Column:
    d = y - q
    return F.avg(F.when(d >= 0, level * d).otherwise((level - 1) * d))


def models_to_rows(df: DataFrame, models: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per (case, model): all models are scored by one plan instead of a loop."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p")) for m, c in models.items()])
    return df.select(*keep, F.inline(pairs))


def quantile_coverage(df: DataFrame, y: str, levels: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Share of y at or below each predicted quantile and its pinball loss."""
    pairs = F.array(*[F.struct(F.lit(c).alias("quantile"), F.lit(float(lv)).alias("level"), F.col(c).cast("double").alias("q"))
                      for c, lv in levels.items()])
    long = df.select(*by, F.col(y).alias("_y"), F.inline(pairs))
    return long.groupBy(*by, "quantile", "level").agg(
        F.avg((F.col("_y") <= F.col("q")).cast("double")).alias("coverage"), pinball(F.col("_y"), F.col("q"), F.col("level")).alias("pinball"))


def central_coverage(df: DataFrame, y: str, lo: str, hi: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of y inside [lo, hi], ends included, and the mean width of the range."""
    inside = (F.col(y) >= F.col(lo)) & (F.col(y) <= F.col(hi))
    return df.groupBy(*by).agg(F.avg(inside.cast("double")).alias("central_coverage"), F.avg(F.col(hi) - F.col(lo)).alias("mean_width"))


def reliability_bin(p: Column, bins: int = C.RELIABILITY_BINS) -> Column:
    """Equal bins on [0, 1] compared with the floating-point edges i x (1 / bins); the last bin is closed."""
    step = 1.0 / bins
    edges = [i * step for i in range(1, bins)]
    out = F.when(p < edges[0], 0)
    for i, e in enumerate(edges[1:], 1):
        out = out.when(p < e, i)
    return out.otherwise(bins - 1).cast("int")


def reliability_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int = C.RELIABILITY_BINS) -> DataFrame:
    """Non-empty bins: count, mean prediction, observed frequency."""
    return df.where(F.col(p).isNotNull()).groupBy(*by, reliability_bin(F.col(p), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("obs_freq"))


def ece(df: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int = C.RELIABILITY_BINS) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("mean_pred") - F.col("obs_freq"))
    return agg(reliability_curve(df, y, p, by, bins), by, (F.sum(gap) / F.sum("n")).alias("ece"))


def _n(c: Column) -> Column:
    return F.count(F.when(c, 1))


def confusion(df: DataFrame, y: str, alert: Column, by: Sequence[str] = ()) -> DataFrame:
    pos = F.col(y) == 1
    g = agg(df.withColumn("_a", alert), by, _n(F.col("_a") & pos).alias("tp"), _n(F.col("_a") & ~pos).alias("fp"),
            _n(~F.col("_a") & pos).alias("fn"), _n(~F.col("_a") & ~pos).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)                              # noqa: E731
    return g.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
                          "false_alarm_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})


def hidden_bust(df: DataFrame, alert: Column, by: Sequence[str] = ()) -> DataFrame:
    """Alert recall on hidden busts, alert precision within low-spread cases."""
    a = alert.cast("double")
    return agg(df, by, F.count(F.when(F.col("hidden_bust") == 1, 1)).alias("n_hidden_busts"),
               F.avg(F.when(F.col("hidden_bust") == 1, a)).alias("hidden_bust_recall"),
               F.avg(F.when((F.col("low_spread") == 1) & alert, F.col("bust").cast("double"))).alias("low_spread_precision"))


def low_spread_auprc(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    return R.auprc(df.where("low_spread = 1"), "bust", p, by).withColumnRenamed("auprc", "low_spread_auprc")


def warning_lead(df: DataFrame, alert: Column, by: Sequence[str] = ()) -> DataFrame:
    return agg(df, by, F.avg(F.when(alert & (F.col("bust") == 1), F.col("lead_day"))).alias("mean_lead_detected"))


def recall_by_lead(df: DataFrame, alert: Column, by: Sequence[str] = ()) -> DataFrame:
    return agg(df.where("bust = 1"), [*by, "lead_day"], F.avg(alert.cast("double")).alias("recall"), F.count(F.lit(1)).alias("n_busts"))


def peak_day_error(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """|argmax-day of predicted risk - argmax-day of error / threshold| over trajectories with a bust; first maximum wins."""
    day = lambda c: (-F.max(F.struct(c.alias("v"), (-F.col("lead_day")).alias("d")))["d"])        # noqa: E731
    t = df.groupBy(*by, "init_time", "region_id").agg(
        day(F.col(p)).alias("_dp"), day(F.col("norm_error") / F.col("q_primary")).alias("_de"), F.max("bust").alias("_any"))
    e = F.abs(F.col("_dp") - F.col("_de"))
    return agg(t.where("_any = 1"), by, F.count(F.lit(1)).alias("n_trajectories"), F.avg(e).alias("mean_abs_peak_day_error"),
               F.avg((e <= 1).cast("double")).alias("within_1_day"))


def spatial_overlap(df: DataFrame, alert: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean Jaccard index of alerted and observed regions per (init, lead) map; maps without either are skipped."""
    b = F.col("bust") == 1
    m = df.groupBy(*by, "init_time", "lead_day").agg(_n(alert & b).alias("_i"), _n(alert | b).alias("_u")).where("_u > 0")
    return agg(m, by, F.count(F.lit(1)).alias("n_maps"), F.avg(F.col("_i") / F.col("_u")).alias("mean_jaccard"))


def disagreement(df: DataFrame, y: str, p_model: str, p_base: str, margin: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(one-row summary of the difference in percentage points, table of the three bins including empty ones)."""
    d = df.withColumn("_d", 100 * (F.col(p_model) - F.col(p_base)))
    qs = {"q01": 0.01, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99}
    summary = d.agg(F.avg(F.abs("_d")).alias("mean_abs_pp"), F.avg((F.abs("_d") > 5).cast("double")).alias("share_gt_5pp"),
                    F.avg((F.abs("_d") > 10).cast("double")).alias("share_gt_10pp"))
    quant = grouped_quantiles(d.select("_d"), [], "_d", qs).select(F.struct(*qs).alias("_q")).scalar()
    summary = summary.withColumn("_q", quant).select("*", "_q.*").drop("_q")
    name = F.when(F.col("_d") > margin, "model_higher").when(F.abs("_d") <= margin, "agree").otherwise("model_lower")
    g = d.groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("observed_rate"), F.avg(p_model).alias("mean_p_model"),
                                         F.avg(p_base).alias("mean_p_base"), brier(y, p_model).alias("brier_model"), brier(y, p_base).alias("brier_base"))
    frame = d.select(F.explode(F.array(*[F.lit(b) for b in ("model_higher", "agree", "model_lower")])).alias("bin")).distinct()
    total = d.agg(F.count(F.lit(1)).alias("_t")).scalar()
    bins = frame.join(g, "bin", "left").withColumn("_t", total)
    return summary, bins.withColumns({"n": F.coalesce("n", F.lit(0).cast("long"))}).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def features_to_rows(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return df.select(*keep, F.inline(pairs)).where(F.col("x").isNotNull())


def univariate_auc(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("split",), label: str = "bust") -> DataFrame:
    long = features_to_rows(df, features, [*by, label])
    h = R.score_histogram(long, label, "x", [*by, "feature"])
    return h.groupBy(*by, "feature").agg(R.roc_auc_column().alias("roc_auc"), F.max(F.col("p") + F.col("n")).cast("long").alias("n"))


def stratified_auc(df: DataFrame, features: Sequence[str], stratum: str, by: Sequence[str] = ("split",), label: str = "bust",
                   min_class: int = 20) -> DataFrame:
    """Positive-weighted mean of within-stratum AUC; strata need >= min_class positives and > min_class negatives."""
    long = features_to_rows(df, features, [*by, stratum, label])
    h = R.score_histogram(long, label, "x", [*by, "feature", stratum])
    s = (h.groupBy(*by, "feature", stratum).agg(R.roc_auc_column().alias("_auc"), F.max("p").alias("_p"), F.max("n").alias("_n"))
         .where((F.col("_p") >= min_class) & (F.col("_n") > min_class)))
    return s.groupBy(*by, "feature").agg((F.sum(F.col("_p") * F.col("_auc")) / F.sum("_p")).alias("auc_given_stratum"),
                                         F.count(F.lit(1)).alias("n_strata"))


def metrics_by_dimension(df: DataFrame, dimensions: Sequence[str], label: str, score: str) -> DataFrame:
    """AUPRC, ROC AUC, Brier, rate per value of every dimension in one plan (dimensions become rows)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions])
    long = df.select(label, score, F.inline(pairs))
    by = ["dimension", "level"]
    basic = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"), brier(label, score).alias("brier"))
    h = R.score_histogram(long, label, score, by)
    return basic.join(h.groupBy(*by).agg(R.auprc_column().alias("auprc"), R.roc_auc_column().alias("roc_auc")), by, "left")


def regional_stability(by_region: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median, P10, P90 of a per-region metric and the share of regions where ``a`` is at least ``b``."""
    return agg(by_region, keys, F.percentile(a, 0.5).alias("median"), F.percentile(a, 0.1).alias("p10"), F.percentile(a, 0.9).alias("p90"),
               F.avg((F.col(a) >= F.col(b)).cast("double")).alias("share_not_worse"), F.count(F.lit(1)).alias("n_regions"))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation from tie-averaged ranks."""
    r = average_ranks(average_ranks(df.select(*by, a, b), by, a, "_ra"), by, b, "_rb")
    return agg(r, by, F.corr("_ra", "_rb").alias("spearman"))


def scoreboard(frame: DataFrame, models: Mapping[str, str], far: float = C.ALERT_FAR, fit: str = "validation", test: str = "test") -> DataFrame:
    """One row per model: ranking, probability, calibration, operating point chosen on ``fit`` and applied to ``test``."""
    keep = ["split", "init_time", "region_id", "lead_day", "bust", "hidden_bust", "low_spread", "norm_error", "q_primary"]
    rows = stored_once(models_to_rows(frame, models, keep).where(F.col("split").isin(fit, test)), "scoreboard")
    by = ["model"]
    thr = stored_once(R.threshold_at_far(rows.where(F.col("split") == fit), "bust", "p", far, by), "thresholds")
    te = rows.where(F.col("split") == test).join(F.broadcast(thr), by)      # one row per model
    a = R.alerts(F.col("p"), F.col("threshold"), F.col("exclusive"))
    te = stored_once(te.withColumn("alert", a), "scoreboard-test")
    al = F.col("alert")
    out = R.ranking_metrics(te, "bust", "p", by)
    for part in (agg(te, by, brier("bust", "p").alias("brier"), F.count(F.lit(1)).alias("n_rows")), ece(te, "bust", "p", by),
                 confusion(te, "bust", al, by), hidden_bust(te, al, by), low_spread_auprc(te, "p", by), warning_lead(te, al, by),
                 peak_day_error(te, "p", by), spatial_overlap(te, al, by), thr.drop("exclusive")):
        out = out.join(part, by, "left")
    return out


def gate(checks: Mapping[str, Column], metrics: DataFrame) -> DataFrame:
    """Pre-registered decision over a one-row metric table: every check must hold."""
    cols = [F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in checks.items()]
    g = metrics.select(*cols)
    total = sum((F.col(n) for n in checks), F.lit(0))
    return g.withColumn("decision", F.when(total == len(checks), "GO").otherwise("NO-GO"))


def report_lines(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Markdown rows of a metric table; the caller prints them in key order."""
    cells = [F.coalesce(F.format_number(F.col(c), digits) if t == "double" else F.col(c).cast("string"), F.lit("-"))
             for c, t in df.select(*columns).dtypes]
    return df.select(columns[0], F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
