"""Analytic fields and identities for the grid operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.functions import scalar as S
from windrose.operators import ensemble as E
from windrose.operators import grid as G
from windrose.operators import stencils as ST

NR, NC, D = 9, 7, 5.0


def field(spark, fn, names, leads=(1,)):
    rows = [(0, ld, r, c, -20.0 + D * r, 60.0 + D * c, *[float(x) for x in fn(-20.0 + D * r, 60.0 + D * c, ld)])
            for ld in leads for r in range(NR) for c in range(NC)]
    return spark.createDataFrame(rows, "init_time int, lead_day int, row_n int, col_n int, lat double, lon double, " + ", ".join(f"{n} double" for n in names))


BY = ["init_time", "lead_day"]


def test_solid_body_rotation(spark):
    u0 = 20.0
    df = field(spark, lambda la, lo, _: (u0 * math.cos(math.radians(la)), 0.0), ["u", "v"])
    k = ST.kinematics(df, {"": ("u", "v")}, BY, NR, NC, D, D).collect()
    inner = [r for r in k if 0 < r["row_n"] < NR - 1 and 0 < r["col_n"] < NC - 1]
    for r in inner:
        want = 2 * u0 * math.sin(math.radians(r["lat"])) / 6.371e6 * 1e5
        assert r["vort"] == pytest.approx(want, abs=0.01) and r["div"] == pytest.approx(0.0, abs=1e-9)
    assert all(r["vort"] is None for r in k if r["row_n"] in (0, NR - 1) or r["col_n"] in (0, NC - 1))


def test_gradient_and_laplacian_of_a_plane(spark):
    df = field(spark, lambda la, lo, _: (3 * lo + 2 * la,), ["z"])
    km = math.radians(1) * 6371
    for r in ST.gradients(df, "z", BY, NR, NC, D, D, laplacian="lap").collect():
        assert r["grad_y"] == pytest.approx(2 / km * 100) and r["grad_x"] == pytest.approx(3 / (km * math.cos(math.radians(r["lat"]))) * 100)
        edge = r["row_n"] in (0, NR - 1) or r["col_n"] in (0, NC - 1)
        assert r["lap"] is None if edge else abs(r["lap"]) < 1e-9


def test_missing_neighbour_gives_null_not_a_wrong_difference(spark):
    df = field(spark, lambda la, lo, _: (lo,), ["z"]).where("NOT (row_n = 4 AND col_n = 3)")
    g = {(r["row_n"], r["col_n"]): r["grad_x"] for r in ST.gradients(df, "z", BY, NR, NC, D, D).collect()}
    assert g[(4, 2)] is None and g[(4, 4)] is None and g[(3, 3)] is not None


def test_tendency(spark):
    df = field(spark, lambda la, lo, ld: (-10.0 * ld,), ["z"], leads=(1, 2, 3, 4))
    assert {round(r["t"], 9) for r in ST.tendencies(df, {"t": "z"}, ["init_time", "row_n", "col_n"], 1, 4).collect()} == {10.0}


def _pair(spark, seed=0):
    rng = np.random.default_rng(seed)
    vals = {}

    def fn(la, lo, _):
        vals[(la, lo)] = (5500 + rng.normal(0, 30), 5500 + rng.normal(0, 40))
        return vals[(la, lo)]
    return field(spark, fn, ["f", "a"]), vals


def test_signature_decomposes_the_mse_exactly(spark):
    df, vals = _pair(spark)
    sig = {(r["row_n"], r["col_n"]): r for r in ST.failure_signature(df, "f", "a", S.area_weight("lat", D), BY, NR, NC, 3, centre=5500.0).collect()}
    for (r, c) in ((4, 3), (0, 0), (8, 6)):
        pts = [(-20 + D * i, 60 + D * j) for i in range(NR) for j in range(NC) if abs(i - r) <= 3 and abs(j - c) <= 3]
        w = np.array([math.sin(math.radians(la + D / 2)) - math.sin(math.radians(la - D / 2)) for la, _ in pts])
        f, a = (np.array([vals[p][i] for p in pts]) for i in (0, 1))
        assert sig[(r, c)]["sig_mse"] == pytest.approx((w * (f - a) ** 2).sum() / w.sum())
        assert sig[(r, c)]["sig_phase_share"] + sig[(r, c)]["sig_amp_share"] == pytest.approx(1.0)


def test_local_correlation_is_weighted_pearson(spark):
    df, vals = _pair(spark, 1)
    acc = {(r["row_n"], r["col_n"]): r["local_acc"] for r in ST.local_correlation(df, "f", "a", F.lit(1.0), BY, NR, NC).collect()}
    pts = [(-20 + D * i, 60 + D * j) for i in (3, 4, 5) for j in (2, 3, 4)]
    want = np.corrcoef([vals[p][0] for p in pts], [vals[p][1] for p in pts])[0, 1]
    assert acc[(4, 3)] == pytest.approx(want) and acc[(0, 0)] is None
    flat = ST.local_correlation(df.withColumn("a", F.lit(7.0)), "f", "a", F.lit(1.0), BY, NR, NC).where("local_acc IS NOT NULL")
    assert flat.isEmpty()


def test_box_sums_equal_direct_sums(spark):
    df, vals = _pair(spark, 2)
    s = {(r["row_n"], r["col_n"]): r["x"] for r in G.box_sums(df, BY, {"x": F.col("f")}, 2, NR, NC).collect()}
    for (r, c), x in s.items():
        assert x == pytest.approx(sum(v[0] for (la, lo), v in vals.items() if abs((la + 20) / D - r) <= 2 and abs((lo - 60) / D - c) <= 2))


def test_regions_and_half_open_bounds(spark):
    lats, lons = [-30.9375 + 5.625 * i for i in range(18)], [22.5 + 5.625 * i for i in range(23)]
    cells = spark.createDataFrame([(a, b) for a in lats for b in lons], "lat double, lon double")
    reg = G.build_regions(cells, {"lat_min": -5, "lat_max": 40, "lon_min": 60, "lon_max": 105})
    assert reg.count() == 64 and reg.agg(F.min("region_id"), F.max("region_id")).first() == ("R0000", "R0707")
    b = G.region_cells(reg, cells, width=5.625)
    assert b.count() == 64 and b.groupBy("region_id").count().agg(F.max("count")).first()[0] == 1
    assert G.neighbours(reg, 1, "region_id").groupBy("region_id").count().agg(F.min("count"), F.max("count")).first() == (4, 9)


def test_box_mean_excludes_missing(spark):
    fine = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (0, 0.5, 0.4, 3.0), (0, 0.9, 0.0, float("nan")), (0, 2.0, 2.0, None)],
                                 "t int, lat double, lon double, v double")
    got = {(r["row_n"], r["col_n"]): r["box_mean"] for r in G.conservative_box_mean(fine, ["t"], "v", "lat", "lon", 0.0, 2.0, 0.0, 2.0, 2, 2).collect()}
    w = math.cos(math.radians(0.5))
    assert got[(0, 0)] == pytest.approx((1 + 3 * w) / (1 + w)) and got[(1, 1)] is None


def test_member_statistics(spark):
    v = [1.0, 2.0, 2.5, 7.0, float("nan")]
    df = spark.createDataFrame([(0, x, 2.2, 2.4) for x in v], "c int, value double, k double, r double")
    r = E.member_statistics(df, ["c"], clim="k", ref="r").first()
    x = np.array(v[:4])
    d = x - x.mean()
    g1 = (d ** 3).mean() / (d ** 2).mean() ** 1.5
    assert r["n_members"] == 4 and r["ens_std"] == pytest.approx(x.std(ddof=1)) and r["ref_rank"] == 2
    assert r["m_skew"] == pytest.approx(g1 * math.sqrt(12) / 2) and r["m_sign_agree"] == pytest.approx(0.5)
    assert r["m_p10p90"] == pytest.approx(np.percentile(x, 90) - np.percentile(x, 10))
