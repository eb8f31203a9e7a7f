"""Distributed prefix sums over ordered values: the base of quantiles, ECDFs, ranks and ranking metrics.

A window ``partitionBy(key).orderBy(value)`` sorts a whole key in one task; a key that holds a third of all
rows would not fit.  ``ordered_totals`` instead

1. collapses equal (key, value) rows with map-side partial sums,
2. cuts the values of every key with more than ``SLOT_ROWS`` distinct ones into slots of about that many, at points
   from a mergeable quantile sketch of that key; the number of slots follows from the key's count,
3. sums each (key, slot) and turns that into offsets,
4. accumulates inside each (key, slot) and adds the offset.

The collapsed rows are written to shared storage, so the input is evaluated once; counts, cut points and sums read what they need
of that table.  Counts and cut points are joined by key and never reach the driver.  They only steer the work distribution: the
result is exact for any choice.  Keys with few values have slot 0 alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.session import stored_once

SLOT_ROWS = 100_000
_LEVELS = 10                     # a sketch gives 2**_LEVELS - 1 cut points


def slot_shapes(df: DataFrame, keys: Sequence[str], value: str, slot_rows: int | None = None) -> DataFrame:
    """(keys, _shape): cut points and number of slots of the keys with more than ``slot_rows`` rows."""
    slot_rows = SLOT_ROWS if slot_rows is None else slot_rows
    probs = ", ".join(f"{i / 2**_LEVELS}D" for i in range(1, 2**_LEVELS))      # one expression text: a thousand literal columns are slow to build
    cuts = F.expr(f"percentile_approx(CAST(`{value}` AS DOUBLE), array({probs}), 10000)")
    n_slots = F.least(F.lit(2**_LEVELS), F.ceil(F.count(F.lit(1)) / slot_rows)).cast("int")
    shape = F.struct(cuts.alias("cuts"), n_slots.alias("n")).alias("_shape")
    if not keys:
        return df.agg(shape)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > slot_rows).select(*keys)
    return df.join(large, list(keys)).groupBy(*keys).agg(shape)


def slot_of(value: Column, shape: Column) -> Column:
    """Slot of ``value`` under a shape: a binary search of the cut points; 0 without a shape."""
    v, cuts = value.cast("double"), shape["cuts"]
    step = lambda at, s: F.when(F.element_at(cuts, at + s) < v, at + s).otherwise(at)        # noqa: E731
    below = F.aggregate(F.array(*[F.lit(2**i) for i in reversed(range(_LEVELS))]), F.lit(0), step)
    return F.when(shape["n"] > 1, F.floor(below * shape["n"] / 2**_LEVELS)).otherwise(0).cast("int")


def with_slots(df: DataFrame, shapes: DataFrame, keys: Sequence[str], value: str, out: str = "_slot") -> DataFrame:
    """``df`` with the slot of every row."""
    shaped = df.join(shapes, list(keys), "left") if keys else df.withColumn("_shape", shapes.scalar())
    return shaped.withColumn(out, slot_of(F.col(value), F.col("_shape"))).drop("_shape")


def ordered_totals(df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column],
                   slot_rows: int | None = None) -> DataFrame:
    """One row per distinct (keys, value): summed measures ``m``, sums over smaller values ``below_m`` and
    key totals ``total_m``.  Rows with a NULL value are left out; keys must not be NULL."""
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, value, *[c.alias(n) for n, c in measures.items()])
    names = list(measures)
    distinct = stored_once(rows.groupBy(*keys, value).agg(*[F.sum(n).alias(n) for n in names]), "ordered")
    cut = with_slots(distinct, slot_shapes(distinct, keys, value, slot_rows), keys, value)
    anchor = list(keys) or [F.lit(0)]
    slots = cut.groupBy(*keys, "_slot").agg(*[F.sum(n).alias(n) for n in names])
    before = W.partitionBy(*anchor).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*anchor)
    offsets = slots.select(*keys, "_slot",
                           *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in names],
                           *[F.sum(n).over(whole).alias(f"total_{n}") for n in names])
    inside = W.partitionBy(*keys, "_slot").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (cut.join(offsets, [*keys, "_slot"])
            .select(*keys, value, *names,
                    *[(F.col(f"_off_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"below_{n}")
                      for n in names],
                    *[f"total_{n}" for n in names]))


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                      count: str | None = None, slot_rows: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without holding an oversized key in one task."""
    t = ordered_totals(df, keys, value, {"n": F.lit(1)}, slot_rows)
    covers = lambda r: (F.col("below_n") <= r) & (r < F.col("below_n") + F.col("n"))     # noqa: E731
    picks = []
    for name, p in probs.items():
        h = (F.col("total_n") - 1) * F.lit(float(p))
        picks += [F.max(F.when(covers(F.floor(h)), F.col(value))).alias(f"_lo_{name}"),
                  F.max(F.when(covers(F.ceil(h)), F.col(value))).alias(f"_hi_{name}")]
    g = t.groupBy(*keys).agg(*picks, F.max("total_n").alias("_n"))
    h = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    cols = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (h[n] - F.floor(h[n]))).alias(n)
            for n in probs]
    return g.select(*keys, *cols, *([F.col("_n").cast("long").alias(count)] if count else []))


def quantile_grid(df: DataFrame, keys: Sequence[str], value: str, steps: int = 1000,
                  slot_rows: int | None = None) -> DataFrame:
    """Dense quantile grid (keys, grid_index 0..steps, quantile) per key.

    Each distinct value emits only the grid positions it brackets, so the output of the explode is
    proportional to values + grid size, never values x grid."""
    t = ordered_totals(df, keys, value, {"n": F.lit(1)}, slot_rows)
    span = F.col("total_n") - 1
    first = F.greatest(F.lit(0), (F.floor((F.col("below_n") - 1) * steps / F.greatest(span, F.lit(1))) - 1).cast("int"))
    last = F.least(F.lit(steps), (F.ceil((F.col("below_n") + F.col("n")) * steps / F.greatest(span, F.lit(1))) + 1).cast("int"))
    near = (t.withColumn("grid_index", F.explode(F.when(span == 0, F.sequence(F.lit(0), F.lit(steps)))
                                                 .otherwise(F.sequence(first, last))))
            .withColumn("_h", span * (F.col("grid_index") / F.lit(float(steps)))))
    hit = lambda r: (F.col("below_n") <= r) & (r < F.col("below_n") + F.col("n"))        # noqa: E731
    g = near.groupBy(*keys, "grid_index").agg(
        F.max(F.when(hit(F.floor("_h")), F.col(value))).alias("_lo"),
        F.max(F.when(hit(F.ceil("_h")), F.col(value))).alias("_hi"), F.max("_h").alias("_h"))
    return g.select(*keys, F.col("grid_index").cast("int").alias("grid_index"),
                    (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))).alias("quantile"))


def reference_percentile(df: DataFrame, keys: Sequence[str], value: str, is_reference: Column,
                         out: str = "percentile") -> DataFrame:
    """Share of reference rows of the same key with value <= this row's value; NULL without reference rows.

    Attached by an equi-join on (keys, value), which spreads a hot key over its values."""
    t = ordered_totals(df, keys, value, {"n": F.when(is_reference, 1).otherwise(0)})
    share = F.when(F.col("total_n") > 0, (F.col("below_n") + F.col("n")) / F.col("total_n"))
    return df.join(t.select(*keys, value, share.alias(out)), [*keys, value], "left")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Tie-averaged 1-based ranks within each key."""
    t = ordered_totals(df, keys, value, {"n": F.lit(1)})
    return df.join(t.select(*keys, value, (F.col("below_n") + (F.col("n") + 1) / 2).alias(out)), [*keys, value], "left")
