"""Boosting against brute force, planted effects and exact Shapley values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.evaluation import ranking as R
from windrose.models import boosting as BO
from windrose.models import exceedance as X

ALL = {"subsample": 1.0, "columns": 1.0}


def cases(spark, n=6000, seed=0):
    """An outcome that depends on s and x, x at times missing; three periods in each split."""
    rng = np.random.default_rng(seed)
    s, x, z = rng.gamma(2, 20, n), rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-3 + 0.04 * s + 0.9 * x)))).astype(int)
    x[rng.random(n) < 0.1] = np.nan
    return spark.createDataFrame(pd.DataFrame({
        "case_id": np.arange(n), "s": s, "x": x, "z": z, "bust": y, "amount": np.exp(0.5 * np.nan_to_num(x) + 0.4 * z) + 0.01 * s,
        "period": np.arange(n) % 3, "split": np.array(["train", "validation", "test"])[np.arange(n) * 3 // n]})).repartition(5).cache()


def brute_tree(bins, g, h, depth, shrink, least, node=1, rows=None, out=None):
    """The tree by trying every split of every node on the rows themselves."""
    out = {} if out is None else out
    rows = np.arange(bins.shape[1]) if rows is None else rows
    gs, hs = g[rows].sum(), h[rows].sum()
    out[node] = (-1, 0, False, -gs / (hs + shrink), len(rows))
    best = None
    if depth:
        for left in (False, True):
            for i in range(len(bins)):
                b = bins[i][rows]
                for c in range(255):
                    go = np.where(b == BO.MISSING, left, b <= c)
                    if not 0 < go.sum() < len(rows) or min(h[rows[go]].sum(), h[rows[~go]].sum()) < least:
                        continue
                    gl, hl = g[rows[go]].sum(), h[rows[go]].sum()
                    gain = gl**2 / (hl + shrink) + (gs - gl) ** 2 / (hs - hl + shrink) - gs**2 / (hs + shrink)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, i, c, left, go)
    if best:
        out[node] = (best[1], best[2], best[3], 0.0, len(rows))
        brute_tree(bins, g, h, depth - 1, shrink, least, 2 * node, rows[best[4]], out)
        brute_tree(bins, g, h, depth - 1, shrink, least, 2 * node + 1, rows[~best[4]], out)
    return out


def test_first_tree_equals_brute_force(spark):
    df = cases(spark, 900, 3)
    [m] = BO.fit(df, [BO.Fit(("s", "x", "z"), "bust")], rounds=1, rate=1.0, min_curvature=3.0, shrink=2.0, bins=16, **ALL)
    rows = df.where("split = 'train'").toPandas()
    bins = m.bins([rows[f].to_numpy(float) for f in m.features])
    p = np.full(len(rows), rows.bust.mean())
    want = brute_tree(bins, p - rows.bust.to_numpy(), p * (1 - p), 3, 2.0, 3.0)
    assert m.start == pytest.approx(math.log(p[0] / (1 - p[0])))
    # the stopping rows keep the tree, as it is far better than none
    assert m.rounds == 1 and m.losses[1] < m.losses[0]
    for node, (f, c, left, value, n) in want.items():
        assert (m.feature[0][node], m.cover[0][node]) == (f, n)
        if f >= 0:
            assert (m.cut[0][node], bool(m.missing_left[0][node])) == (c, left)
        else:
            assert m.value[0][node] == pytest.approx(value, abs=1e-5)
    assert (m.feature[0] >= 0).sum() == sum(f >= 0 for f, *_ in want.values()) > 3


def test_quantile_leaves_are_exact(spark):
    df = cases(spark, 1500, 4)
    fits = [BO.Fit(("s", "x"), "amount", level=v) for v in (0.1, 0.5, 0.95)]
    models = BO.fit(df, fits, rounds=2, rate=1.0, depth=2, min_cases=40, min_curvature=0.0, shrink=1.0, patience=9, **ALL)
    rows = df.where("split = 'train'").toPandas()
    for m, x in zip(models, fits):
        bins = m.bins([rows[f].to_numpy(float) for f in m.features])
        for t in range(m.rounds):
            leaf = BO.leaf_of(bins, m.feature[t], m.cut[t], m.missing_left[t])
            r = rows.amount.to_numpy() - m.margin(bins, trees=t)
            for node in np.unique(leaf):
                own = np.sort(r[leaf == node].astype(np.float32))
                assert m.value[t][node] == pytest.approx(float(own[max(math.ceil(x.level * len(own)), 1) - 1]), rel=1e-6, abs=1e-7)
        assert m.rounds > 0


def test_order_of_32_bit_floats():
    x = np.array([-np.inf, -3.5, -1e-30, -0.0, 0.0, 1e-30, 2.0, 1e30], np.float32)
    u = BO.ordered_bits(x)
    assert (np.diff(u) >= 0).all() and u[3] == u[4]
    assert [BO.from_bits(int(v)) for v in u] == [float(v) for v in x]


def test_residual_learner_adds_to_a_cross_fitted_margin(spark):
    df = cases(spark)
    fast = {"rate": 0.2, "rounds": 30, "patience": 5, "min_curvature": 5.0, "columns": 1.0}
    base = X.fit_exceedance(df, ["s"], **fast)
    m = X.crossfit_margin(base.margin(df, "full"), base, F.col("period")).cache()
    other, train = m.where("split <> 'train'"), m.where("split = 'train'")
    assert m.count() == df.count() and other.where("abs(margin - full) > 1e-12").isEmpty() and train.where("abs(margin - full) < 1e-9").count() < 0.5 * train.count()
    model = X.fit_residual(m, ["s", "x"], **fast)
    te = model.raw(m.where("split = 'test'"), "p").withColumn("p0", 1 / (1 + F.exp(-F.col("margin"))))
    a, b = (R.auprc(te, "bust", c).first()["auprc"] for c in ("p", "p0"))
    assert a > b + 0.03 and model.trees.losses[0] > model.trees.losses[model.trees.rounds] == min(model.trees.losses)
    # nothing left to add: early stopping keeps no tree, and the score is the margin
    none = X.fit_residual(m.withColumn("margin", F.when(F.col("bust") == 1, 30.0).otherwise(-30.0)), ["z"], calibrate=False, **fast)
    assert none.trees.rounds == 0
    assert none.margin(m, "out").where("out <> margin").isEmpty()


def test_quantiles_cover_and_beat_the_forest(spark):
    df = cases(spark, 9000, 8)
    te = df.where("split = 'test'")
    boost = X.fit_quantile_boost(df, ["x", "s"], "amount", rate=0.2, rounds=30, patience=5)
    forest = X.fit_quantile_forest(df, ["x", "s"], "amount")
    qb, qf, y = (d.orderBy("case_id") for d in (boost.quantiles(te), forest.quantiles(te), te.select("case_id", "amount")))
    y = np.array([r.amount for r in y.collect()])
    qb, qf = (np.array([r.q for r in d.collect()]) for d in (qb, qf))
    assert (np.diff(qb, axis=1) >= 0).all()
    loss = lambda q: np.mean([np.maximum(v * (y - q[:, i]), (v - 1) * (y - q[:, i])).mean() for i, v in enumerate(C.QUANTILE_LEVELS)])      # noqa: E731
    for i, v in enumerate(C.QUANTILE_LEVELS):
        assert abs((y <= qb[:, i]).mean() - v) < 0.02 + 2 * math.sqrt(v * (1 - v) / len(y))
    assert loss(qb) <= loss(qf)
    once, again = (X.fit_quantile_boost(d, ["x", "s"], "amount", rate=0.2, rounds=2) for d in (df, df.repartition(3)))
    for a, b in zip(once.trees, again.trees):          # the same trees from another partitioning
        assert (a.feature == b.feature).all() and (a.value == b.value).all()


def shapley(m, x):
    """Over all orders of the inputs: the change of the conditional mean when an input becomes known."""
    def value(known):
        total = m.start
        for t in range(m.rounds):
            def walk(node):
                f = int(m.feature[t][node])
                if f < 0:
                    return m.value[t][node]
                if f in known:
                    right = not m.missing_left[t][node] if x[f] == BO.MISSING else x[f] > m.cut[t][node]
                    return walk(2 * node + int(right))
                return sum(m.cover[t][k] / m.cover[t][node] * walk(k) for k in (2 * node, 2 * node + 1))
            total += walk(1)
        return total
    n = len(m.features)
    out = np.zeros(n)
    for order in itertools.permutations(range(n)):
        for k, f in enumerate(order):
            out[f] += value(set(order[:k + 1])) - value(set(order[:k]))
    return out / math.factorial(n), value(set())


def test_attributions_equal_all_orderings(spark):
    df = cases(spark, 1200, 5)
    [m] = BO.fit(df, [BO.Fit(("s", "x", "z"), "bust")], rounds=4, rate=0.5, min_curvature=2.0, shrink=1.0, **ALL)
    rows = df.limit(40).toPandas()
    bins = m.bins([rows[f].to_numpy(float) for f in m.features])
    got = BO.attributions(m, bins)
    assert m.rounds >= 2 and (bins == BO.MISSING).any()
    for c in range(len(rows)):
        parts, mean = shapley(m, bins[:, c])
        assert got[:-1, c] == pytest.approx(parts, abs=1e-9) and got[-1, c] == pytest.approx(mean, abs=1e-9)
    assert got.sum(0) == pytest.approx(m.margin(bins), abs=1e-9)
    e = BO.explain(m, df, ["case_id"])
    g = BO.group_sums(e, {"A": ["s"], "B": ["x"]}, ["case_id"]).groupBy("case_id").agg(F.sum("contribution_logodds").alias("g"), F.count("*").alias("n"))
    assert e.join(g, "case_id").where("abs(g + mean + offset - margin) > 1e-9 or n <> 3").isEmpty() and e.count() == 1200


def test_null_and_degenerate_inputs(spark, tmp_path):
    df = cases(spark, 300, 6).withColumns({"none": F.lit(None).cast("double"), "same": F.lit(1.0)})
    [m] = BO.fit(df, [BO.Fit(("none", "same"), "bust")], rounds=5, patience=2, min_curvature=1.0)
    assert m.rounds == 0
    m.save(spark, str(tmp_path / "t"))
    again = BO.Trees.load(spark, str(tmp_path / "t"))
    assert again.rounds == 0 and again.start == m.start and again.losses == pytest.approx(m.losses)
    [empty] = BO.fit(df.limit(0), [BO.Fit(("s",), "bust")], rounds=3)
    assert empty.rounds == 0 and empty.predict(df, "p").where("p <> 0").isEmpty()
    [part] = BO.fit(df.withColumn("bust", F.when(F.col("case_id") % 2 == 0, F.col("bust"))), [BO.Fit(("s",), "bust")], rounds=3, min_curvature=1.0, rate=0.5, **ALL)
    assert part.rounds == 0 or part.cover[0][1] == df.where("split = 'train' and case_id % 2 = 0").count()


def test_the_driver_gets_no_residuals_of_quantile_trees(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 4, 6000), rng.normal(size=6000)
    df = spark.createDataFrame([(i, float(a), float(b), "train" if i % 3 else "validation") for i, (a, b) in enumerate(zip(x, y))],
                               "case_id long, x double, y double, split string").persist()
    seen = []
    for name in ("toPandas", "collect"):
        def counted(self, _f=getattr(DataFrame, name)):
            out = _f(self)
            seen.append(len(out))
            return out
        monkeypatch.setattr(DataFrame, name, counted)
    t = BO.fit(df, [BO.Fit(("x",), "y", level=0.5)], rounds=2, depth=2, min_cases=1, min_curvature=0.0, shrink=0.0, rate=1.0, subsample=1.0, columns=1.0)[0]
    assert t.rounds == len(t.value) and seen and max(seen) < 100          # histograms of four bins and a row a leaf


def test_fits_share_labels_and_unused_rows_are_not_packed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(BO, "scratch_path", lambda spark, name: str(tmp_path / name))
    df = cases(spark, 1200, 9)
    BO.fit(df, [BO.Fit(("s", "x"), "amount", level=v) for v in (0.1, 0.5, 0.9)], rounds=1, min_curvature=0.0)
    blocks = spark.read.schema(BO.BLOCK).parquet(str(tmp_path / "boosting" / "0")).selectExpr("n", "length(y) AS y", "length(use) AS use", "length(f) AS f").collect()
    assert sum(b["n"] for b in blocks) == df.where("split <> 'test'").count()
    assert all((b["y"], b["use"], b["f"]) == (8 * b["n"], b["n"], 24 * b["n"]) for b in blocks)


def test_only_one_of_two_children_is_summed(spark):
    rng = np.random.default_rng(1)
    n, tree = 500, (np.array([-1, 0, -1, -1]), np.array([0, 9, 0, 0]), np.zeros(4, bool))
    bins, key = rng.integers(0, 64, (2, n)).astype(np.uint8), rng.integers(0, 2**40, n)
    block = [bins, key, (rng.random(n) < 0.3).astype(float), np.ones(n, np.uint8), np.zeros(n)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in block)], ["n", "bins", "key", "y", "use", "f"])
    state = BO._State(None, np.arange(2), np.arange(2), 1, 0, 1.0, 0, 0, [], tree, np.array([False, False, True, False]))
    [got] = BO._histograms(type("H", (), {"value": {0: state}}), 1)(iter([batch]))
    cell, g, h, c = (np.array(got.column(x)) for x in ("cell", "g", "h", "c"))
    left = bins[0] <= 9
    assert cell.max() < 2 * 256 and c.sum() == 2 * left.sum()                  # node 3 would start at cell 512
    assert h.sum() == 2 * left.sum() * BO.FIXED / 4 and g.sum() == 2 * ((0.5 - block[2][left]) * BO.FIXED).sum()
