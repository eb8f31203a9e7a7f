"""Selection rules over tables of finished runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_within_guardrail(runs: DataFrame, key: str, loss: str, metric: str, tolerance: float = 0.01) -> DataFrame:
    """Among the runs whose loss is within ``tolerance`` of the best, the one with the largest metric."""
    best = runs.agg(F.min(loss)).scalar()
    ok = runs.withColumn("_best", best).where(F.col(loss) <= (1 + tolerance) * F.col("_best")).drop("_best")
    return ok.orderBy(F.desc(metric), key).limit(1).select(key, loss, metric)


def keep_improving_groups(runs: DataFrame, baseline: str, by: Sequence[str] = ("period",)) -> DataFrame:
    """Feature groups whose mean metric beats the baseline in every period.

    ``runs``: (group_name, period, seed, metric); the baseline is one of the groups."""
    mean = runs.groupBy("group_name", *by).agg(F.avg("metric").alias("m"))
    base = mean.where(F.col("group_name") == baseline).select(*by, F.col("m").alias("_b"))
    g = mean.where(F.col("group_name") != baseline).join(base, list(by)).withColumn("gain", F.col("m") - F.col("_b"))
    return g.groupBy("group_name").agg(F.min("gain").alias("worst_gain"), F.avg("gain").alias("mean_gain"),
                                       (F.min("gain") > 0).cast("int").alias("keep"))
