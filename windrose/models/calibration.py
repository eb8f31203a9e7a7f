"""Isotonic calibration as a knot table, cross-fitted calibration and calibrator resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.operators.ordered import slot_shapes, with_slots
from windrose.session import stored_once

KNOT_BITS = 24          # a calibrator of more knots than 2**24 would not fit a row


def fit_isotonic(rows: DataFrame, score: str, label: str, fitted_on: str = "validation", name: str = "default") -> DataFrame:
    """One-row calibrator (name, fitted_on, xs, ys).

    Equal scores collapse to their mean label and weight before the fit, so MLlib's parallel pooling sees distinct
    scores only; the result is the short list of knots of the step function."""
    pooled = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.avg(label).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    data = VectorAssembler(inputCols=["s"], outputCol="features").transform(pooled)
    model = IsotonicRegression(featuresCol="features", labelCol="y", weightCol="w").fit(data)
    xs, ys = [float(x) for x in model.boundaries], [float(y) for y in model.predictions]
    return rows.sparkSession.createDataFrame([(name, fitted_on, xs, ys)], "name string, fitted_on string, xs array<double>, ys array<double>")


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear interpolation over sorted knots, constant outside; the knot is found by a binary search."""
    n = F.size(xs)
    step = lambda at, s: F.when((at + s <= n) & (F.get(xs, at + s - 1) <= x), at + s).otherwise(at)       # noqa: E731
    i = F.aggregate(F.array(*[F.lit(2**b) for b in reversed(range(KNOT_BITS))]), F.lit(0), step)
    at = F.least(F.greatest(i, F.lit(1)), F.greatest(n - 1, F.lit(1)))
    x0, y0 = F.element_at(xs, at), F.element_at(ys, at)
    x1, y1 = F.try_element_at(xs, at + 1), F.try_element_at(ys, at + 1)
    inner = F.when(x1 > x0, y0 + (x - x0) * (y1 - y0) / (x1 - x0)).otherwise(y0)
    return (F.when(x.isNull(), None).when(i == 0, F.element_at(ys, F.lit(1))).when(i >= n, F.element_at(ys, F.lit(-1))).otherwise(inner))


def calibrate(rows: DataFrame, calibrator: DataFrame, score: str, out: str) -> DataFrame:
    knots = calibrator.select(F.struct("xs", "ys").alias("k")).scalar()
    return rows.withColumn("_k", knots).withColumn(out, interpolate(F.col(score), F.col("_k.xs"), F.col("_k.ys"))).drop("_k")


def falls(rows: DataFrame, score: str, out: str, slot_rows: int | None = None, tolerance: float = 1e-12) -> DataFrame:
    """(falls): number of distinct scores with a calibrated value below that of a smaller score, or with two of them.

    Every score is held against all smaller ones: the largest value before it in its slot and in the slots below."""
    steps = stored_once(rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.min(out).alias("lo"), F.max(out).alias("hi")), "steps")
    cut = with_slots(steps, slot_shapes(steps, [], "s", slot_rows), [], "s")
    before = W.partitionBy(F.lit(0)).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)      # a row a slot
    tops = cut.groupBy("_slot").agg(F.max("hi").alias("_top")).select("_slot", F.max("_top").over(before).alias("_below"))
    inside = W.partitionBy("_slot").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    seen = cut.join(tops, "_slot").withColumn("_seen", F.greatest(F.max("hi").over(inside), F.col("_below")))
    fall = (F.col("lo") < F.col("_seen") - tolerance) | (F.col("hi") - F.col("lo") > tolerance)
    return seen.agg(F.count(F.when(fall, 1)).alias("falls"))


def cross_calibrate(rows: DataFrame, score: str, label: str, fold: Column, folds: Sequence[int] = (0, 1), out: str = "p_cal") -> DataFrame:
    """Each fold is calibrated by the fit on the other rows, so validation scores are never in-sample."""
    marked = rows.withColumn("_fold", fold)
    parts = [calibrate(marked.where(F.col("_fold") == k), fit_isotonic(marked.where(F.col("_fold") != k), score, label), score, out) for k in folds]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res.drop("_fold")


def resolve_calibrator(rows: DataFrame, calibrators: DataFrame, score: str, default: str, by: str = "provider", out: str = "p_cal") -> DataFrame:
    """The provider's own calibrator, or the documented transfer of the ``default`` one; only validation fits are accepted.

    ``calibrators``: (provider, fitted_on, xs, ys), one row per provider."""
    ok = F.when(F.col("fitted_on") == "validation", True).otherwise(F.raise_error(F.lit("calibrator was not fitted on validation")).cast("boolean"))
    usable = calibrators.where(ok).select(F.col(by), F.struct("xs", "ys").alias("_own"))
    fallback = usable.where(F.col(by) == default).select("_own").scalar()
    j = rows.join(usable, by, "left").withColumn("_def", fallback).withColumn("_k", F.coalesce("_own", "_def"))
    return j.withColumns({out: interpolate(F.col(score), F.col("_k.xs"), F.col("_k.ys")), "own_calibrator": F.col("_own").isNotNull().cast("int")}
                         ).drop("_own", "_def", "_k")
