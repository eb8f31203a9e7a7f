"""Ranking metrics on a distributed score histogram.

``score_histogram`` collapses equal scores (so the step semantics of ties are exact) and attaches cumulated
positives and negatives *above* each score, per group, with the bounded prefix sum of ``operators.ordered``.
Every metric is then one aggregation over distinct scores.  Groups are extra keys (model, lead, replicate...),
so one plan evaluates all of them; optional weights turn a bootstrap replicate into a weighted histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.operators.ordered import ordered_totals


def score_histogram(df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, score): pos, neg at the score; tp, fp = cumulated from the highest score down to it; P, N totals."""
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    t = ordered_totals(df.where(y.isNotNull()), by, score, {"pos": y * w, "neg": (1 - y) * w})
    return t.select(*by, F.col(score).alias("score"), "pos", "neg", (F.col("total_pos") - F.col("below_pos")).alias("tp"),
                    (F.col("total_neg") - F.col("below_neg")).alias("fp"), F.col("total_pos").alias("p"), F.col("total_neg").alias("n"))


def _per_group(h: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return h.groupBy(*by).agg(*aggs) if by else h.agg(*aggs)


def auprc_column() -> Column:
    """Average precision: sum of (recall step) x precision; NULL without positives."""
    return F.sum(F.when(F.col("p") > 0, F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))))


def roc_auc_column() -> Column:
    """Tie-averaged ROC AUC; NULL for a single class."""
    beaten = F.col("n") - F.col("fp") + F.col("neg") / 2
    return F.sum(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("pos") * beaten / (F.col("p") * F.col("n"))))


def recall_at_far_column(far: float) -> Column:
    """Largest recall among thresholds with false-alarm rate <= far; 0 when none qualifies."""
    ok = F.col("fp") <= F.lit(far) * F.col("n")
    return F.coalesce(F.max(F.when(ok, F.col("tp") / F.col("p"))), F.lit(0.0))


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None,
                    fars: Sequence[float] = (0.05, 0.10)) -> DataFrame:
    h = score_histogram(df, label, score, by, weight)
    return _per_group(h, by, [auprc_column().alias("auprc"), roc_auc_column().alias("roc_auc"),
                              *[recall_at_far_column(f).alias(f"recall_at_far_{round(100 * f)}") for f in fars]])


def auprc(df, label, score, by=(), weight=None):
    return _per_group(score_histogram(df, label, score, by, weight), by, [auprc_column().alias("auprc")])


def roc_auc(df, label, score, by=(), weight=None):
    return _per_group(score_histogram(df, label, score, by, weight), by, [roc_auc_column().alias("roc_auc")])


def threshold_at_far(df: DataFrame, label: str, score: str, far: float, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Alert threshold whose false-alarm rate is <= far on these rows.

    With N negatives and k = floor(far N), the negative at 0-based position k in descending order must stay below:
    the alert rule is ``score > threshold`` (``strict``).  When k >= N every negative may alarm: the threshold is the
    lowest negative and the rule is ``score >= threshold`` (``exclusive`` = false).  ``strict=False`` is the audit
    variant that alerts at the k-th negative itself."""
    h = score_histogram(df, label, score, by)
    k = F.floor(F.lit(far) * F.col("n"))
    at_k = (F.col("fp") - F.col("neg") <= k) & (k < F.col("fp")) & (F.col("neg") > 0)
    g = _per_group(h, by, [F.max(F.when(at_k, F.col("score"))).alias("_t"), F.min(F.when(F.col("neg") > 0, F.col("score"))).alias("_low")])
    exclusive = F.col("_t").isNotNull() if strict else F.lit(False)
    return g.select(*by, F.coalesce("_t", "_low").alias("threshold"), exclusive.alias("exclusive"))


def alerts(score: Column, threshold: Column, exclusive: Column) -> Column:
    return F.when(exclusive, score > threshold).otherwise(score >= threshold)


def pr_curve(df: DataFrame, label: str, score: str, points: int = 60) -> DataFrame:
    """Precision-recall points in order of rising threshold, thinned to about ``points`` evenly spaced positions.

    The closing point (recall 0, precision 1) takes the last position; positions come from a prefix sum over the
    histogram, not from a global sort."""
    h = score_histogram(df, label, score).where(F.col("p") > 0)
    t = ordered_totals(h.withColumn("one", F.lit(1)), [], "score", {"i": F.col("one")})
    pos = t.select("score", F.col("below_i").cast("long").alias("position"), F.col("total_i").cast("long").alias("m"))
    curve = h.join(pos, "score").select("position", "m", (F.col("tp") / F.col("p")).alias("recall"),
                                        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    # position i is kept when some k in 0..points-1 has floor(k m / (points - 1)) = i
    step = F.lit(float(points - 1))
    k = F.ceil(F.col("position") * step / F.col("m"))
    near = lambda j: (j >= 0) & (j < points) & (F.floor(j * F.col("m") / step) == F.col("position"))      # noqa: E731
    kept = curve.where(near(k - 1) | near(k) | near(k + 1)).drop("m")
    end = curve.agg(F.max("m").alias("position")).select("position", F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return kept.unionByName(end.where(F.col("position").isNotNull()))
