"""Block bootstrap over initialisation days by weight vectors.

A replicate draws as many days as there are, with replacement.  The draw is hashed from (seed, replicate, position), so it is
reproducible on any cluster, and its effect is one vector of integer weights per day: a matrix of days x replicates, bounded by
the calendar and a parameter, which every task gets.  Scores are cut into slots per key; a task sorts the rows of one slot and
cumulates the weights of all replicates together, as vectors, starting from the sums of the slots above.  Neither the replicates
nor the distinct scores multiply the rows that are shuffled; what grows with the replicates are sums per slot.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.evaluation import ranking as R
from windrose.functions.random import seeded_int, seeded_uniform
from windrose.operators.ordered import slot_shapes, with_slots
from windrose.session import stored_once

_TILE_ROWS = 4_096        # rows x replicates held at once inside a task
_MATRIX_CELLS = 1 << 24   # days x replicates of one matrix; more replicates go in further batches


def day_weights(days: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(rep, day, weight) from a one-column table of distinct days (thousands at most)."""
    w = W.partitionBy(F.lit(0))
    indexed = days.select("day", (F.row_number().over(w.orderBy("day")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("m"))
    draws = (indexed.select(F.col("i").alias("position"), "m").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
             .select("rep", (seeded_int(seed, F.col("rep"), F.col("position")) % F.col("m")).alias("i"))
             .groupBy("rep", "i").agg(F.count(F.lit(1)).alias("weight")))
    return draws.join(indexed.select("i", "day"), "i").select("rep", "day", "weight")


def _matrices(weights: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(days, replicates, weights as days x replicates), in batches of replicates."""
    long = weights.select("rep", F.unix_date("day").alias("day"), "weight").toPandas()       # days x replicates at most
    days, reps = np.unique(long["day"].to_numpy(np.int64)), np.unique(long["rep"].to_numpy(np.int64))
    matrix = np.zeros((len(days), len(reps)), np.int32)
    matrix[np.searchsorted(days, long["day"]), np.searchsorted(reps, long["rep"])] = long["weight"]
    batch = max(1, _MATRIX_CELLS // max(1, len(days)))
    return [(days, reps[i:i + batch], matrix[:, i:i + batch]) for i in range(0, len(reps), batch)]


def _weighted(day: np.ndarray, count: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sum of count x weight over the rows, per replicate."""
    return np.bincount(day, weights=count, minlength=len(matrix)) @ matrix


def _slot_metrics(day: np.ndarray, score: np.ndarray, y: np.ndarray, count: np.ndarray, matrix: np.ndarray,
                  above: np.ndarray, total: np.ndarray, far: float) -> np.ndarray:
    """(AUPRC part, ROC AUC part, recall) of one slot per replicate.  ``above`` and ``total``: positives and negatives in the slots
    above and in the whole key.  Rows of one score are one step."""
    order = np.argsort(-score, kind="stable")
    day, score, y, count = day[order], score[order], y[order], count[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(score)) + 1, [len(score)]])
    (tp, fp), (p, n) = above, total
    ap, auc, recall = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p))
    at = 0
    while at < len(starts) - 1:
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + _TILE_ROWS, side="right")) - 1)      # whole steps
        rows = slice(starts[at], starts[stop])
        if stop == at + 1:                               # a step of any length is one sum over the days
            d, c, hit = day[rows], count[rows], y[rows] == 1
            pos, neg = (_weighted(d[m], c[m], matrix)[None, :] for m in (hit, ~hit))
        else:
            w, steps = matrix[day[rows]] * count[rows][:, None], starts[at:stop] - starts[at]
            hit = (y[rows] == 1)[:, None]
            pos, neg = np.add.reduceat(w * hit, steps), np.add.reduceat(w * ~hit, steps)
        tps, fps = tp + np.cumsum(pos, 0), fp + np.cumsum(neg, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ap += np.where(pos > 0, pos / p * tps / (tps + fps), 0.0).sum(0)
            auc += np.where(pos > 0, pos * (n - fps + neg / 2) / (p * n), 0.0).sum(0)
            recall = np.maximum(recall, np.where((fps <= far * n) & (p > 0), tps / p, 0.0).max(0))
        tp, fp, at = tps[-1], fps[-1], stop
    return np.stack([ap, auc, recall])


def _slot_sums(shared: Broadcast, names: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Positives and negatives of one slot per replicate."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        days, reps, matrix = shared.value
        day, c, hit = np.searchsorted(days, pdf["day"]), pdf["c"].to_numpy(), pdf["y"].to_numpy() == 1
        return pd.DataFrame({**{n: pdf[n].iloc[0] for n in names}, "rep": reps, "pos": _weighted(day[hit], c[hit], matrix),
                             "neg": _weighted(day[~hit], c[~hit], matrix)})
    return run


def _slot_parts(shared: Broadcast, names: Sequence[str], far: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Metric contributions of one slot per replicate, given its offsets."""
    def run(pdf: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        days, reps, matrix = shared.value
        o = offsets.sort_values("rep")
        above, total = o[["above_pos", "above_neg"]].to_numpy().T, o[["total_pos", "total_neg"]].to_numpy().T
        got = _slot_metrics(np.searchsorted(days, pdf["day"]), pdf["score"].to_numpy(), pdf["y"].to_numpy(), pdf["c"].to_numpy(), matrix, above, total, far)
        return pd.DataFrame({**{n: pdf[n].iloc[0] for n in names}, "rep": reps, "ap": got[0], "auc": got[1], "recall": got[2], "p": total[0], "n": total[1]})
    return run


def replicate_metrics(rows: DataFrame, weights: DataFrame, label: str, score: str, by: Sequence[str], far: float = 0.10,
                      slot_rows: int | None = None) -> DataFrame:
    """(by, rep, auprc, roc_auc, recall_at_far) of every replicate; NULL where a class (AUPRC: the positives) has no weight.
    ``weights``: (rep, day, weight).  Rows without a score or label are left out."""
    by = list(by)
    spark = rows.sparkSession
    daily = stored_once(rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        *by, F.unix_date("day").alias("day"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y")).agg(
        F.count(F.lit(1)).cast("double").alias("c")), "daily")
    cut = with_slots(daily, slot_shapes(daily, by, "score", slot_rows), by, "score")
    cut = stored_once(cut, "slots")
    key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name in [*by, "_slot"])
    names = [f.name for f in cut.schema.fields if f.name in [*by, "_slot"]]
    per_day = cut.groupBy(*names, "day", "y").agg(F.sum("c").alias("c"))
    parts = []
    for days, reps, matrix in _matrices(weights):
        shared = spark.sparkContext.broadcast((days, reps, matrix))
        slots = per_day.groupBy(*names).applyInPandas(_slot_sums(shared, names), f"{key}, rep bigint, pos double, neg double")
        over = W.partitionBy(*by, "rep").orderBy(F.desc("_slot")).rowsBetween(W.unboundedPreceding, -1)      # slots of one key and replicate
        whole = W.partitionBy(*by, "rep")
        offsets = slots.select(*names, "rep", *[F.coalesce(F.sum(x).over(over), F.lit(0.0)).alias(f"above_{x}") for x in ("pos", "neg")],
                               *[F.sum(x).over(whole).alias(f"total_{x}") for x in ("pos", "neg")])
        parts.append(cut.groupBy(*names).cogroup(offsets.groupBy(*names)).applyInPandas(
            _slot_parts(shared, names, far), f"{key}, rep bigint, ap double, auc double, recall double, p double, n double"))
    if not parts:
        return cut.select(*by, F.lit(0).cast("long").alias("rep"), *[F.lit(0.0).alias(m) for m in ("auprc", "roc_auc", "recall_at_far")]).where("false")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    has_p, has_n = F.max("p") > 0, F.max("n") > 0
    return every.groupBy(*by, "rep").agg(F.when(has_p, F.sum("ap")).alias("auprc"), F.when(has_p & has_n, F.sum("auc")).alias("roc_auc"),
                                         F.when(has_p | has_n, F.max("recall")).alias("recall_at_far"))


def _with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("init_time"))


def summarise(diffs: DataFrame, value: str = "diff", by: Sequence[str] = ()) -> DataFrame:
    """Mean, 95 % interval and share <= 0 over the replicates (a table of n_boot rows per key)."""
    aggs = [F.avg(value).alias("mean"), F.percentile(value, 0.025).alias("ci_lo"), F.percentile(value, 0.975).alias("ci_hi"),
            F.avg((F.col(value) <= 0).cast("double")).alias("p_le_0"), F.count(value).alias("n_boot")]
    return diffs.groupBy(*by).agg(*aggs) if by else diffs.agg(*aggs)


def auprc_difference(df: DataFrame, label: str, a: str, b: str, n_boot: int = 200, seed: int = 0) -> DataFrame:
    d = _with_day(df)
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in (("a", a), ("b", b))])
    rows = d.select("day", label, F.inline(pairs))
    weights = day_weights(d.select("day").distinct(), n_boot, seed)
    per = replicate_metrics(rows, weights, label, "p", ["model"]).select("rep", "model", F.col("auprc").alias("v"))
    diff = per.groupBy("rep").agg((F.max(F.when(F.col("model") == "a", F.col("v"))) - F.max(F.when(F.col("model") == "b", F.col("v")))).alias("diff"))
    return summarise(diff)


def auc_difference(df: DataFrame, a: tuple[str, str], b: tuple[str, str], n_boot: int = 200, seed: int = 0) -> DataFrame:
    """ROC AUC(label_a, score_a) - ROC AUC(label_b, score_b): the labels may differ."""
    d = _with_day(df)
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(y).cast("int").alias("y"), F.col(p).alias("p")) for m, (y, p) in (("a", a), ("b", b))])
    rows = d.select("day", F.inline(pairs))
    weights = day_weights(d.select("day").distinct(), n_boot, seed)
    per = replicate_metrics(rows, weights, "y", "p", ["model"]).select("rep", "model", F.col("roc_auc").alias("v"))
    diff = per.groupBy("rep").agg((F.max(F.when(F.col("model") == "a", F.col("v"))) - F.max(F.when(F.col("model") == "b", F.col("v")))).alias("diff"))
    return summarise(diff)


def metric_intervals(df: DataFrame, models: Mapping[str, str], thresholds: DataFrame, n_boot: int = 300, seed: int = 0, far: float = 0.10) -> DataFrame:
    """Point value and 95 % interval of AUPRC, Brier, recall at FAR and hidden-bust recall per model, and of every
    model's difference to the first.  ``thresholds``: (model, threshold, exclusive).  Replicate -1 is the point value."""
    d = _with_day(df)
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in models.items()])
    rows = d.select("day", "bust", "hidden_bust", F.inline(pairs))
    days = d.select("day").distinct()
    weights = day_weights(days, n_boot, seed).unionByName(days.select(F.lit(-1).alias("rep"), "day", F.lit(1).cast("long").alias("weight")))
    rank = replicate_metrics(rows, weights, "bust", "p", ["model"], far).select("rep", "model", "auprc", "recall_at_far")
    hit = R.alerts(F.col("p"), F.col("threshold"), F.col("exclusive"))
    err = (F.col("bust") - F.col("p")) * (F.col("bust") - F.col("p"))
    hidden = F.col("hidden_bust") == 1
    daily = rows.join(F.broadcast(thresholds), "model").groupBy("model", "day").agg(     # one row per model
        F.sum(err).alias("_e"), F.count(F.lit(1)).alias("_n"), F.count(F.when(hidden & hit, 1)).alias("_hh"), F.count(F.when(hidden, 1)).alias("_h"))
    add = daily.join(weights, "day").groupBy("rep", "model").agg(
        (F.sum(F.col("_e") * F.col("weight")) / F.sum(F.col("_n") * F.col("weight"))).alias("brier"),
        F.try_divide(F.sum(F.col("_hh") * F.col("weight")).cast("double"), F.sum(F.col("_h") * F.col("weight")).cast("double")).alias("hidden_recall"))
    metrics = ["auprc", "brier", "recall_at_far", "hidden_recall"]
    long = rank.join(add, ["rep", "model"]).select(
        "rep", "model", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])))
    first = next(iter(models))
    ref = long.where(F.col("model") == first).select("rep", "metric", F.col("v").alias("_ref"))
    both = long.join(ref, ["rep", "metric"]).withColumn("d", F.col("v") - F.col("_ref"))
    boot, point = F.col("rep") >= 0, F.col("rep") < 0
    return both.groupBy("model", "metric").agg(
        F.max(F.when(point, F.col("v"))).alias("point"), F.percentile(F.when(boot, F.col("v")), 0.025).alias("ci_lo"),
        F.percentile(F.when(boot, F.col("v")), 0.975).alias("ci_hi"), F.max(F.when(point, F.col("d"))).alias("diff"),
        F.percentile(F.when(boot, F.col("d")), 0.025).alias("diff_lo"), F.percentile(F.when(boot, F.col("d")), 0.975).alias("diff_hi"),
        F.avg(F.when(boot, (F.col("d") <= 0).cast("double"))).alias("p_le_0"))


def auprc_ceiling(df: DataFrame, p: str, key: str, by: Sequence[str] = ("split",), replicates: int = 20, seed: int = 0) -> DataFrame:
    """AUPRC attainable if labels were drawn from ``p``: mean and sd over seeded replicates.

    Labels of one score are only counted, so rows collapse to (replicate, score) on the map side."""
    sim = (df.select(*by, key, F.col(p).alias("s")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
           .withColumn("y", (seeded_uniform(seed, F.col("rep"), F.col(key)) < F.col("s")).cast("int")))
    per = R.score_histogram(sim, "y", "s", [*by, "rep"]).groupBy(*by, "rep").agg(R.auprc_column().alias("v"))
    return per.groupBy(*by).agg(F.avg("v").alias("ceiling_auprc"), F.stddev_pop("v").alias("ceiling_sd"), F.count("v").alias("n_rep"))
