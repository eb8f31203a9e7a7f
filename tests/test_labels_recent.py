"""Leakage, window edges and label rules on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.operators import alignment as A
from windrose.operators import labels as L
from windrose.operators import ordered as O
from windrose.operators import recent as RE

T0 = dt.datetime(2020, 1, 1)


def cases(seed=0, perturb=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(240):
        init = T0 + dt.timedelta(hours=12 * i)
        split = "train" if i < 120 else "test"
        for lead in (1, 2):
            e, s, a, b = rng.gamma(2, 10), rng.gamma(3, 5), rng.normal(0, 20), rng.normal(0, 3)
            if perturb and split == "test":
                e, s, a = e * 50 + 1, s + 100, a * 9
            rows.append((i * 10 + lead, init, init + dt.timedelta(days=lead), "R0000" if i % 3 else "R0001", lead, "S", float(e), float(b), float(s), float(a), split))
    return rows


SCHEMA = ("case_id bigint, init_time timestamp, valid_time timestamp, region_id string, lead_day int, season string, error_m double, "
          "bias_m double, spread_m double, ref_anom_m double, split string")


def test_fitted_parameters_ignore_later_rows(spark):
    a, b = (spark.createDataFrame(cases(perturb=p), SCHEMA) for p in (False, True))
    key = lambda df: sorted(map(tuple, df.collect()))               # noqa: E731
    assert key(L.fit_normalisation(a)) == key(L.fit_normalisation(b))
    cols = ["case_id", "norm_error", "q_primary", "spread_low", "bust"]
    tr = lambda df: key(L.label_cases(df).where("split = 'train'").select(*cols))      # noqa: E731
    assert tr(a) == tr(b)


@pytest.mark.parametrize("limit", [40, 10 ** 9])
def test_thresholds_match_numpy_in_both_plans(spark, monkeypatch, limit):
    monkeypatch.setattr(O, "SLOT_ROWS", limit)
    df = spark.createDataFrame(cases(), SCHEMA).withColumn("norm_error", F.col("error_m") / 10)
    for r in L.fit_thresholds(df).collect():
        v = np.array([x[6] / 10 for x in cases() if x[10] == "train" and x[3] == r["region_id"] and x[4] == r["lead_day"]])
        assert [r["q_primary"], r["q_sensitivity"]] == pytest.approx(list(np.quantile(v, [0.9, 0.95]))) and r["n_train"] == len(v)


def test_label_comparisons_are_strict_and_inclusive(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 3.0, 2.0), (1.1, 2.1, 1.0, 1.05, 2.0), (5.0, 1.0, None, None, None)],
                               "norm_error double, spread_m double, q_primary double, q_sensitivity double, spread_low double")
    got = [tuple(r) for r in L.exceedance_labels(df).select("bust", "bust_q95", "low_spread", "hidden_bust").collect()]
    assert got == [(0, 0, 1, 0), (1, 1, 0, 0), (0, 0, 0, 0)]


@pytest.mark.parametrize("limit", [40, 10 ** 9])
def test_trailing_window_is_left_open_right_closed(spark, monkeypatch, limit):
    monkeypatch.setattr(O, "SLOT_ROWS", limit)
    t = T0 + dt.timedelta(days=10)
    us = dt.timedelta(microseconds=1)
    facts = [("a", t, 1.0), ("a", t - dt.timedelta(days=5), 2.0), ("a", t - dt.timedelta(days=5) + us, 4.0), ("a", t + us, 8.0), ("b", t, 16.0)]
    f = spark.createDataFrame([(k, v, e, e, 1) for k, v, e in facts], "region_id string, valid_time timestamp, norm_error double, bias_m double, bust int")
    q = spark.createDataFrame([(t, "a"), (t, "b")], "init_time timestamp, region_id string")
    got = {r["region_id"]: (r["n"], r["err"]) for r in RE.trailing_sums(f, q, ["region_id"]).collect()}
    assert got == {"a": (2.0, 5.0), "b": (1.0, 16.0)}


def test_recent_errors_ignore_the_future(spark):
    base = spark.createDataFrame(cases(), SCHEMA).withColumn("norm_error", F.col("error_m") / 10).withColumn("bust", (F.col("error_m") > 30).cast("int"))
    cut = T0 + dt.timedelta(days=40)
    late = base.withColumn("norm_error", F.when(F.col("valid_time") > F.lit(cut), 99.0).otherwise(F.col("norm_error")))
    regions = base.select("region_id").distinct()
    nb = regions.select("region_id", F.col("region_id").alias("nb_region_id"))
    rows = lambda d: sorted(map(str, RE.recent_error_features(d, regions, nb).where(F.col("init_time") <= F.lit(cut)).collect()))      # noqa: E731
    assert rows(base) == rows(late)


def test_rolling_windows(spark):
    v = [T0, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(v)], "i int, valid_time timestamp")
    got = {}
    for r in A.rolling_cases(df, 3).collect():
        got.setdefault(r["i"], []).append(r["fit_day"])
    day = lambda k: (T0 + dt.timedelta(days=k)).date()                # noqa: E731
    assert {k: sorted(x) for k, x in got.items()} == {0: [day(0), day(1), day(2)], 1: [day(1), day(2), day(3)], 2: [day(1), day(2), day(3)]}


def test_merge_rejects_duplicates(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    b = spark.createDataFrame([(1, 3.0), (1, 4.0)], "k int, y double")
    with pytest.raises(Exception, match="not unique"):
        A.one_to_one_merge(a, b, ["k"]).collect()


def test_missing_reference_is_an_error(spark):
    f = spark.createDataFrame([(1,)], "valid_time int")
    with pytest.raises(Exception, match="verification reference missing"):
        A.align_reference(f, f.where("valid_time > 5").select("valid_time"), ["valid_time"]).collect()
