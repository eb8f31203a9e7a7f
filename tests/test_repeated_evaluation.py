"""Sums of doubles differ in their last bits from one evaluation to the next, labels and levels must not."""

import datetime as dt
import random

from pyspark.sql import functions as F

from windrose.operators import labels as L
from windrose.operators import support as SP

T0 = dt.datetime(2020, 1, 1)


def restless(df):
    """``df`` with its rows in a new order at every evaluation."""
    def mixed(blocks):
        for b in blocks:
            yield b.sample(frac=1, random_state=random.SystemRandom().randrange(2**32))
    return df.coalesce(1).mapInPandas(mixed, df.schema)


def unsteady(scale):
    """``scale`` with other last bits at every evaluation, as sums have whose shuffled parts arrive in another order."""
    def nudged(blocks):
        for b in blocks:
            yield b.assign(scale_m=[x * (1 + random.SystemRandom().randrange(-2, 3) * 2.0**-52) for x in b["scale_m"]])
    return scale.mapInPandas(nudged, scale.schema)


def test_errors_equal_to_their_threshold_are_no_busts(spark, monkeypatch):
    fit = L.fit_normalisation
    monkeypatch.setattr(L, "fit_normalisation", lambda *a: unsteady(fit(*a)))
    rng = random.Random(1)
    rows = [(i, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i + 24), f"R{r}", 1, "S", float(rng.choice((3.3, 7.1, 9.7))), rng.gauss(0, 3), 5.0, "train")
            for r in range(40) for i in range(200)]
    df = spark.createDataFrame(rows, "case_id long, init_time timestamp, valid_time timestamp, region_id string, lead_day int, season string, "
                                     "error_m double, ref_anom_m double, spread_m double, split string")
    got = L.label_cases(df).groupBy("region_id", "error_m").agg(F.min("bust"), F.max("bust"), F.max("bust_q95")).collect()
    assert len(got) == 120 and all(tuple(r)[2:] == (0, 0, 0) for r in got)       # the threshold is the largest error of each region


def test_distances_equal_to_their_threshold_reach_it(spark):
    rng = random.Random(2)
    kinds = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(20)]
    rows = [(lead * 1000 + i, lead, "train", *kinds[i % 20]) for lead in range(30) for i in range(400)]
    df = restless(spark.createDataFrame(rows, "case_id long, lead_day int, split string, a double, b double"))
    got = SP.support_levels(df, SP.fit_support(df, ["a", "b"]), ["a", "b"])
    most = got.groupBy("lead_day", "a", "b").agg(F.max("support_level").alias("level"), F.min("support_level").alias("low")).groupBy("lead_day").agg(F.max("level"), F.max("low"))
    assert [tuple(r)[1:] for r in most.collect()] == [(3, 3)] * 30             # the farthest point of a lead is its highest quantile
