"""Recently verified error behaviour: trailing, right-closed (T - window, T] statistics under the availability rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.operators.ordered import ordered_totals
from windrose.session import cut_lineage

MEASURES = {"n": None, "err": "norm_error", "bias": "bias_m", "hit": "bust"}


def trailing_sums(facts: DataFrame, inits: DataFrame, keys: Sequence[str], window_days: int = C.RECENT_WINDOW_DAYS) -> DataFrame:
    """Sums of facts with valid_time in (T - window, T] for every (key, init T) of ``inits``.

    Facts and the two window ends of every query are put on one time axis; a prefix sum over that axis gives the
    cumulated facts at both ends and the window is their difference.  Facts of equal time collapse first, so the
    axis holds distinct times only and a busy key is spread over time intervals."""
    micros = window_days * 86_400_000_000
    zero = [F.lit(0.0).alias(m) for m in MEASURES]
    values = [F.lit(1.0).alias("n"), *[F.col(c).cast("double").alias(m) for m, c in MEASURES.items() if c]]
    q = inits.select(*keys, F.unix_micros("init_time").alias("t"))
    axis = (facts.select(*keys, F.unix_micros("valid_time").alias("t"), *values)
            .unionByName(q.select(*keys, "t", *zero))
            .unionByName(q.select(*keys, (F.col("t") - micros).alias("t"), *zero)))
    tot = ordered_totals(axis, keys, "t", {m: F.col(m) for m in MEASURES})
    upto = tot.select(*keys, "t", *[(F.col(f"below_{m}") + F.col(m)).alias(m) for m in MEASURES])
    hi = upto.select(*keys, "t", *[F.col(m).alias(f"hi_{m}") for m in MEASURES])
    lo = upto.select(*keys, (F.col("t") + micros).alias("t"), *[F.col(m).alias(f"lo_{m}") for m in MEASURES])
    return (inits.withColumn("t", F.unix_micros("init_time")).join(hi, [*keys, "t"]).join(lo, [*keys, "t"])
            .select(*inits.columns, *[(F.col(f"hi_{m}") - F.col(f"lo_{m}")).alias(m) for m in MEASURES]))


def recent_error_features(cases: DataFrame, regions: DataFrame, neighbours: DataFrame, window_days: int = C.RECENT_WINDOW_DAYS,
                          max_lead: int = C.RECENT_MAX_LEAD) -> DataFrame:
    """rec_* features per (init_time, region_id).

    ``regions``: region dimension (region_id); ``neighbours``: (region_id, nb_region_id) with self.  The neighbour
    value is a mean of regional means (missing ones skipped), the domain value pools all facts."""
    facts = cases.where(F.col("lead_day") <= max_lead).select("region_id", "valid_time", "norm_error", "bias_m", "bust")
    inits = cases.select("init_time").distinct()
    known = facts.select("region_id").distinct().join(regions.select("region_id"), "region_id")
    frame = cases.select("init_time", "region_id").distinct().join(known, "region_id", "left_semi")
    # a region without a row at some init still feeds its neighbours: complete (init, region) over the region dimension
    regions_list = known.agg(F.collect_set("region_id").alias("_r"))          # bounded by the region dimension
    full = inits.withColumn("region_id", F.explode(regions_list.scalar()))
    own = trailing_sums(facts, full, ["region_id"], window_days)
    mean = lambda m: F.when(F.col("n") > 0.5, F.col(m) / F.col("n"))          # noqa: E731
    own = cut_lineage(own.select("init_time", "region_id", mean("err").alias("rec_err"), mean("bias").alias("rec_bias"),
                     mean("hit").alias("rec_bust_rate"), F.round("n").alias("rec_n")))      # feeds the neighbours and the result
    nb = (neighbours.select("region_id", "nb_region_id")
          .join(own.select("init_time", F.col("region_id").alias("nb_region_id"), F.col("rec_err").alias("_e")), "nb_region_id")
          .groupBy("init_time", "region_id").agg(F.avg("_e").alias("rec_err_nbhd")))
    daily = facts.groupBy("valid_time").agg(F.count(F.lit(1)).alias("_n"), F.sum("norm_error").alias("_e"))
    domain = _domain_mean(daily, inits, window_days)
    return (frame.join(own, ["init_time", "region_id"]).join(nb, ["init_time", "region_id"], "left")
            .join(domain, "init_time", "left"))


def _domain_mean(daily: DataFrame, inits: DataFrame, window_days: int) -> DataFrame:
    """Pooled mean over all regions: one row per valid time, then the same prefix difference with no key."""
    micros = window_days * 86_400_000_000
    q = inits.select(F.unix_micros("init_time").alias("t"))
    zero = [F.lit(0.0).alias("n"), F.lit(0.0).alias("e")]
    axis = (daily.select(F.unix_micros("valid_time").alias("t"), F.col("_n").cast("double").alias("n"), F.col("_e").alias("e"))
            .unionByName(q.select("t", *zero)).unionByName(q.select((F.col("t") - micros).alias("t"), *zero)))
    tot = ordered_totals(axis, [], "t", {"n": F.col("n"), "e": F.col("e")})
    upto = tot.select("t", (F.col("below_n") + F.col("n")).alias("n"), (F.col("below_e") + F.col("e")).alias("e"))
    hi = upto.select("t", F.col("n").alias("hn"), F.col("e").alias("he"))
    lo = upto.select((F.col("t") + micros).alias("t"), F.col("n").alias("ln"), F.col("e").alias("le"))
    n, e = F.col("hn") - F.col("ln"), F.col("he") - F.col("le")
    return (inits.withColumn("t", F.unix_micros("init_time")).join(hi, "t").join(lo, "t")
            .select("init_time", F.when(n > 0.5, e / n).alias("rec_err_domain")))
