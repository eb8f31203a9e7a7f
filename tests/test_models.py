"""Mixture fits, learners' protocol, support distance and streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.models import bma as B
from windrose.models import exceedance as X
from windrose.operators import support as SP
from windrose.sources import sinks

T0 = dt.datetime(2020, 1, 1)


def archive(n=400, k=20, groups=("a",), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        for i in range(n):
            f = rng.normal(0, 10) + rng.normal(0, 2, k)
            y = 1.5 + 0.9 * f[rng.integers(k)] + rng.normal(0, 3)
            rows.append((g, T0 + dt.timedelta(days=i), [float(x) for x in f], float(y)))
    return rows


SCHEMA = "g string, valid_time timestamp, members array<double>, y double"


def test_fit_recovers_parameters(spark):
    r = B.fit_exchangeable(spark.createDataFrame(archive(2000), SCHEMA), ["g"]).first()
    assert r["a"] == pytest.approx(1.5, abs=0.3) and r["b"] == pytest.approx(0.9, abs=0.05) and r["sigma"] == pytest.approx(3.0, abs=0.3)


def test_oversized_groups_take_the_distributed_plan_with_equal_results(spark):
    rows = archive(120, 8, ("a", "b")) + archive(30, 8, ("c",), 3)
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r["g"]: r for r in B.fit_exchangeable(df, ["g"]).collect()}
    two = {r["g"]: r for r in B.fit_exchangeable(df, ["g"], group_rows=50).collect()}
    assert set(one) == set(two) == {"a", "b", "c"}
    for g in one:
        for c in ("a", "b", "sigma"):
            assert two[g][c] == pytest.approx(one[g][c], rel=1e-6)
        assert (two[g]["n_cases"], two[g]["em_iter"]) == (one[g]["n_cases"], one[g]["em_iter"])


def test_free_weights_distributed_plan_agrees(spark):
    df = spark.createDataFrame(archive(90, 3, ("a", "b", "c"), 5), SCHEMA)
    one = {r["g"]: r for r in B.free_weights(df, ["g"], 2, 1, max_iter=6).collect()}
    two = {r["g"]: r for r in B.free_weights(df, ["g"], 2, 1, max_iter=6, group_rows=50).collect()}
    assert set(one) == set(two) and len(one) == 2
    for g in one:
        assert [two[g][c] for c in ("n", "k", "w_min", "w_max", "sigma")] == pytest.approx([one[g][c] for c in ("n", "k", "w_min", "w_max", "sigma")])


def test_rolling_fit_equals_a_fit_per_window(spark):
    rows = archive(150, 5, ("a", "b"))
    df = spark.createDataFrame(rows, SCHEMA)
    days = spark.createDataFrame([((T0 + dt.timedelta(days=d)).date(),) for d in range(0, 170, 3)], "fit_day date")
    for limit in (10 ** 6, 60):                                       # chunk plan, and per-day plan for large chunks
        got = {(r["fit_day"], r["g"]): r for r in B.rolling_fit(df, ["g"], days, 40, 20, group_rows=limit).collect()}
        seen = 0
        for d in range(0, 170, 3):
            day = T0 + dt.timedelta(days=d)
            use = [r for r in rows if r[0] == "a" and day - dt.timedelta(days=40) < r[1] <= day]
            if len(use) < 20:
                assert (day.date(), "a") not in got
                continue
            r, seen = got[(day.date(), "a")], seen + 1
            assert r["n_cases"] == len(use) and r["last_verified"] == max(x[1] for x in use) <= day
        one = B.fit_exchangeable(df.where(F.col("valid_time").between(T0 + dt.timedelta(days=21), T0 + dt.timedelta(days=60)) & (F.col("g") == "b")), ["g"]).first()
        r = got[((T0 + dt.timedelta(days=60)).date(), "b")]
        assert seen > 30 and [r["a"], r["b"], r["sigma"]] == pytest.approx([one["a"], one["b"], one["sigma"]])


def test_quantiles_invert_the_cdf_and_moments_match_sampling(spark):
    rng = np.random.default_rng(2)
    mu, sigma, m, s = [-3.0, 0.5, 4.0], 1.7, 0.4, 2.0
    df = spark.createDataFrame([(mu, sigma, m, s)], "mu array<double>, sigma double, m double, s double")
    q = B.quantiles(df, "m", "s").select(F.posexplode("bma_q").alias("i", "c"), "mu", "sigma", "m", "s")
    p = [r["p"] for r in B.exceedance(q, "c", "m", "s", "p").orderBy("i").collect()]
    assert p == pytest.approx([0.9, 0.75, 0.5, 0.25, 0.1, 0.05], abs=1e-9)
    z = rng.choice(mu, 400_000) + rng.normal(0, sigma, 400_000)
    y = np.abs(m - z) / s
    r = B.exceedance(B.moments(df.withColumn("c", F.lit(0.9)), "m", "s"), "c", "m", "s").first()
    one = B.predictive(df.withColumn("c", F.lit(0.9)), "c", "m", "s").first()           # the batch form agrees with the expressions
    assert [one["bma_exceedance"], one["bma_mean"], one["bma_std"]] == pytest.approx([r["p_exceed"], r["bma_mean"], r["bma_std"]], abs=1e-12)
    assert B.predictive(df.withColumn("c", F.lit(None).cast("double")), "c", "m", "s").first()["bma_mean"] is None
    assert r["bma_mean"] == pytest.approx(y.mean(), rel=0.01) and r["bma_std"] == pytest.approx(y.std(), rel=0.01)


def toy(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    x, noise, z = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x - 1.5)))).astype(int)
    split = np.array(["train", "validation", "test"])[np.arange(n) * 3 // n]
    rows = [(i, T0 + dt.timedelta(days=i % 3 * 400), float(x[i]) if i % 11 else None, float(noise[i]), int(y[i]), float(np.exp(0.3 * x[i] + 0.5 * z[i])), str(split[i])) for i in range(n)]
    return spark.createDataFrame(rows, "case_id bigint, init_time timestamp, x double, noise double, bust int, norm_error double, split string")


def test_exceedance_protocol(spark, tmp_path):
    df = toy(spark)
    m = X.fit_exceedance(df, ["x", "noise"], rounds=12, rate=0.2, min_curvature=5.0, columns=1.0)
    te = m.score(df.where("split = 'test'")).cache()
    a = te.agg(F.avg(F.when(F.col("bust") == 1, F.col("raw_probability"))), F.avg(F.when(F.col("bust") == 0, F.col("raw_probability")))).first()
    assert a[0] > a[1] and te.where("bust_probability < 0 OR bust_probability > 1 OR bust_probability IS NULL").isEmpty()
    m.save(str(tmp_path / "m"), spark)
    again = X.ExceedanceModel.load(spark, str(tmp_path / "m")).score(df.where("split = 'test'"))
    d = te.join(again.select("case_id", F.col("bust_probability").alias("p2")), "case_id")
    assert d.agg(F.max(F.abs(F.col("bust_probability") - F.col("p2")))).first()[0] == 0
    assert m.importance(spark).first()["feature"] == "x"


def test_verification_columns_are_refused(spark):
    df = toy(spark, 60)
    with pytest.raises(ValueError, match="verification"):
        X.fit_exceedance(df, ["x", "norm_error"])
    with pytest.raises(ValueError, match="verification"):
        sinks.guard_forbidden(df)


def test_quantile_forest_is_ordered_and_covers(spark):
    df = toy(spark)
    f = X.fit_quantile_forest(df, ["x"], trees=5, depth=4)
    q = f.quantiles(df.where("split = 'test'")).join(df.select("case_id", "norm_error"), "case_id")
    assert q.where(F.exists(F.zip_with(F.slice("q", 1, 5), F.slice("q", 2, 5), lambda a, b: a - b), lambda d: d > 1e-9)).isEmpty()
    assert q.agg(F.avg((F.col("norm_error") <= F.col("q")[4]).cast("double"))).first()[0] == pytest.approx(0.9, abs=0.05)


def test_permutation_is_a_bijection(spark):
    df = toy(spark, 500)
    p = X.permute_column(df, "noise", 3)
    vals = lambda d: sorted(r[0] for r in d.select("noise").collect())       # noqa: E731
    assert vals(p) == vals(df)
    assert p.join(df.select("case_id", F.col("noise").alias("n0")), "case_id").where("noise <> n0").count() > 400


def test_support_distance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 0.3]])
    df = spark.createDataFrame([(i, 1, "train", *[float(v) for v in r]) for i, r in enumerate(x)] + [(999, 1, "test", None, 1.0, 1.0)],
                               "case_id bigint, lead_day int, split string, a double, b double, c double")
    sup = SP.fit_support(df, ["a", "b", "c"])
    got = {r["case_id"]: r for r in SP.support_levels(df, sup, ["a", "b", "c"]).collect()}
    p, s = sup.first(), np.cov(x.T, bias=True)
    d2, mu = (s * s).sum(), np.trace(s) / 3
    z = x - x.mean(0)
    beta, gap = (((z ** 2).sum(1) ** 2).mean() - d2) / (3 * 400), (d2 - 2 * mu * np.trace(s) + 3 * mu * mu) / 3
    assert p["shrinkage"] == pytest.approx(min(beta, gap) / gap)
    prec = np.linalg.inv((1 - p["shrinkage"]) * s + p["shrinkage"] * mu * np.eye(3))
    assert got[7]["support_distance"] == pytest.approx(float(np.sqrt(z[7] @ prec @ z[7])))
    assert got[999]["support_distance"] is None and got[999]["support_level"] == 3


def test_free_weights_query_stops_by_tolerance(monkeypatch):
    import inspect

    from windrose.plans import mixture
    real, seen = mixture.M.free_weights, []

    def fake(*a, **b):
        call = inspect.signature(real).bind(*a, **b)
        call.apply_defaults()
        seen.append((call.arguments["max_iter"], call.arguments["tol"]))
        raise StopIteration

    monkeypatch.setattr(mixture.M, "free_weights", fake)
    with pytest.raises(StopIteration):
        mixture.checked_weights(None, mixture.M.GROUP_ROWS)
    assert seen == [(500, 1e-7)]


def test_mixture_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, T0 + dt.timedelta(days=4 * (i // 2)), "a", [float(x) for x in np.random.default_rng(i).normal(0, 30, 9)], 50.0, 0.6, int(i % 3 == 0))
                                  for i in range(6)], "id int, init_time timestamp, g string, members array<double>, scale double, c double, bust int")
    rows = rows.withColumn("mean_anom", F.aggregate("members", F.lit(0.0), lambda a, x: a + x) / 9)
    params = spark.createDataFrame([(T0.date(), "a", 1.0, 0.9, 15.0, 60), ((T0 + dt.timedelta(days=4)).date(), "a", 0.5, 1.1, 12.0, 60)],
                                   "fit_day date, g string, a double, b double, sigma double, n_cases int")
    model = B.BmaModel(params, ["g"], {"window_days": 60})
    bare = model.predict(rows, "c", "mean_anom", "scale").orderBy("id").collect()
    assert [r.bma_exceedance is None for r in bare] == [False] * 4 + [True] * 2 and all(r.bma_probability is None for r in bare)
    fitted = model.calibrate(rows, "bust", "c", "mean_anom", "scale")
    fitted.save(str(tmp_path / "m"))
    again = B.BmaModel.load(spark, str(tmp_path / "m"))
    a, b = (m.predict(rows, "c", "mean_anom", "scale").orderBy("id").collect() for m in (fitted, again))
    assert a == b and again.settings == {"window_days": 60} and again.keys == ["g"]
    seen = sorted((r.bma_exceedance, r.bma_probability) for r in a[:4])
    assert all(x[1] <= y[1] for x, y in zip(seen, seen[1:])) and all(0 <= p <= 1 for _, p in seen) and all(r.bma_probability is None for r in a[4:])


def test_pca_fit_tells_the_maps_it_was_fitted_on(spark, sf):
    from windrose.plans import models as MO
    got = MO.pca_fit(spark, sf).collect()
    maps = MO.maps(spark, sf).where(MO.TRAIN_MAPS).count()
    assert [r["component"] for r in got] == list(range(1, 9)) and {r["n_maps"] for r in got} == {maps}
    assert all(r["explained"] > 0 and r["variance"] > 0 for r in got)


def test_forest_looks_leaves_up_without_a_row_a_tree(spark):
    df = toy(spark, 1500, 4)
    f = X.fit_quantile_forest(df, ["x", "noise"], "norm_error", trees=4, depth=3)
    rows = f._leaf_rows(df, "case_id").join(f.leaves, ["tree", "leaf"]).groupBy("case_id").agg(F.avg("q10").alias("a"), F.avg("q95").alias("b"), F.count("*").alias("n"))
    q = f.quantiles(df)
    assert "Generate" not in q._jdf.queryExecution().optimizedPlan().toString()
    bad = rows.join(q, "case_id").where("abs(a - q[0]) > 1e-9 OR abs(b - q[5]) > 1e-9 OR n <> 4")
    assert q.count() == 1500 and bad.count() == 0
