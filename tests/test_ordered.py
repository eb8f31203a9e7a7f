"""The ordered operators with many and with single slots per key against NumPy, with a hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.evaluation import ranking as R
from windrose.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in np.round(rng.lognormal(0, 1, 3000), 2)]           # a third and more, with ties
    rows += [(f"k{i % 40}", float(x)) for i, x in enumerate(rng.normal(0, 1, 2000))]
    rows += [("flat", 1.5)] * 500
    return rows, spark.createDataFrame(rows, "k string, v double").cache()


@pytest.mark.parametrize("limit", [40, 10 ** 9])
def test_quantiles(skewed, monkeypatch, limit):
    rows, df = skewed
    monkeypatch.setattr(O, "SLOT_ROWS", limit)
    got = {r["k"]: r for r in O.grouped_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.9, "c": 0.333}, count="n").collect()}
    for k in {r[0] for r in rows}:
        v = np.array([x for kk, x in rows if kk == k])
        assert got[k]["n"] == len(v)
        assert [got[k][c] for c in "abc"] == pytest.approx(list(np.quantile(v, [0.1, 0.9, 0.333])), abs=1e-12)


@pytest.mark.parametrize("limit", [40, 10 ** 9])
def test_prefix_sums_and_percentile(skewed, monkeypatch, limit):
    rows, df = skewed
    monkeypatch.setattr(O, "SLOT_ROWS", limit)
    t = O.ordered_totals(df, ["k"], "v", {"n": F.lit(1)}).collect()
    for k in ("hot", "flat", "k7"):
        v = np.sort([x for kk, x in rows if kk == k])
        for r in (x for x in t if x["k"] == k):
            assert (r["below_n"], r["n"], r["total_n"]) == (np.searchsorted(v, r["v"]), (v == r["v"]).sum(), len(v))
    p = O.reference_percentile(df.withColumn("id", F.monotonically_increasing_id()), ["k"], "v", F.col("v") > 0.5, "pct")
    assert p.count() == len(rows)
    for r in p.where("k = 'hot'").limit(200).collect():
        ref = np.sort([x for kk, x in rows if kk == "hot" and x > 0.5])
        assert r["pct"] == pytest.approx(np.searchsorted(ref, r["v"], side="right") / len(ref))


def test_no_slot_holds_a_hot_key(skewed):
    """What one task sees is bounded, whatever the key distribution, and slots follow the order of the values."""
    rows, df = skewed
    d = df.distinct()
    per = O.with_slots(d, O.slot_shapes(d, ["k"], "v", 40), ["k"], "v").groupBy("k", "_slot").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    assert max(r["n"] for r in per) <= 80 and len([r for r in per if r["k"] == "hot"]) > 8
    hot = sorted((r["_slot"], r["lo"], r["hi"]) for r in per if r["k"] == "hot")
    assert all(a[2] < b[1] for a, b in zip(hot, hot[1:]))


@pytest.mark.parametrize("limit", [40, 10 ** 9])
def test_quantile_grid(skewed, monkeypatch, limit):
    rows, df = skewed
    monkeypatch.setattr(O, "SLOT_ROWS", limit)
    g = O.quantile_grid(df.where("k IN ('hot', 'flat', 'k3')"), ["k"], "v", 100).collect()
    for k in ("hot", "flat", "k3"):
        v = np.array([x for kk, x in rows if kk == k])
        got = [r["quantile"] for r in sorted((r for r in g if r["k"] == k), key=lambda r: r["grid_index"])]
        assert got == pytest.approx(list(np.quantile(v, np.arange(101) / 100)), abs=1e-9)


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, 2.0)], "i int, v double")
    r = {x["i"]: x["rk"] for x in O.average_ranks(df, [], "v", "rk").collect()}
    assert r == {2: 1.0, 4: 2.0, 1: 3.5, 3: 3.5}


def brute_auprc(y, p):
    order = np.unique(p)[::-1]
    total, last, out = y.sum(), 0.0, 0.0
    for s in order:
        tp, n = y[p >= s].sum(), (p >= s).sum()
        out += (tp / total - last) * tp / n
        last = tp / total
    return out


@pytest.mark.parametrize("limit", [40, 10 ** 9])
def test_ranking_metrics(spark, monkeypatch, limit):
    monkeypatch.setattr(O, "SLOT_ROWS", limit)
    rng = np.random.default_rng(5)
    p = np.round(rng.random(800), 2)
    y = (rng.random(800) < p * 0.4).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    m = R.ranking_metrics(df, "y", "p").first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert m["auprc"] == pytest.approx(brute_auprc(y, p)) and m["roc_auc"] == pytest.approx(auc)
    best = max((p[y == 1] >= s).mean() for s in np.unique(p) if (p[y == 0] >= s).mean() <= 0.10)
    assert m["recall_at_far_10"] == pytest.approx(best)
    t = R.threshold_at_far(df, "y", "p", 0.1).first()
    k = int(np.floor(0.1 * len(neg)))
    assert t["threshold"] == np.sort(neg)[::-1][k] and t["exclusive"]
    assert (neg > t["threshold"]).mean() <= 0.1


def test_metrics_without_positives_are_null(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.4)], "y int, p double")
    m = R.ranking_metrics(df, "y", "p", fars=()).first()
    assert m["auprc"] is None and m["roc_auc"] is None
