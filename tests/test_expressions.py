"""Closed-form checks of the row-local expressions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.functions import probability as P
from windrose.functions import scalar as S
from windrose.models import calibration as CA


def one(df):
    return df.first()[0]


def values(spark, column, **cols):
    df = spark.createDataFrame(list(zip(*cols.values())), list(cols))
    return [r[0] for r in df.select(column).collect()]


def test_valid_time_season_case_id(spark):
    df = spark.sql("SELECT TIMESTAMP'2021-05-30 12:00:00' AS t, 72 AS h")
    r = df.select(S.valid_time("t", "h").cast("string"), S.season("t"), S.season_code(S.season("t")),
                  S.case_id("t", F.lit("R0203"), S.lead_day("h"))).first()
    assert tuple(r) == ("2021-06-02 12:00:00", "MAM", 1, "2021053012_R0203_D03")


def test_lead_day_rejects_partial_days(spark):
    with pytest.raises(Exception, match="not a whole day"):
        spark.sql("SELECT 30 AS h").select(S.lead_day("h")).collect()


def test_units(spark):
    got = values(spark, S.canonical_geopotential("v", "u"), v=[10.0, 10.0], u=["gpm", "m**2 s**-2"])
    assert got == pytest.approx([98.0665, 10.0])
    with pytest.raises(Exception, match="unsupported"):
        values(spark, S.canonical_geopotential("v", "u"), v=[1.0], u=["K"])


def test_area_weights_cover_the_sphere(spark):
    lats = [-87.5 + 5 * i for i in range(36)]
    assert sum(values(spark, S.area_weight("lat", 5.0), lat=lats)) == pytest.approx(2.0)


def test_embargo_and_split_edges(spark):
    df = spark.sql("SELECT TIMESTAMP'2020-12-31 00:00:00' AS t, TIMESTAMP'2021-01-01 00:00:00' AS v")
    split = S.split_of("t", {"train": ("2018-01-01", "2020-12-31 23:59:00")})
    ends = {"train": "2021-01-01 00:00:00"}
    assert tuple(df.select(split, S.embargo(split, "v", ends), S.embargo(split, F.col("v") + F.expr("INTERVAL 1 SECOND"), ends)).first()
                 ) == ("train", "train", "embargo")


def test_norm_cdf_is_double_precision(spark):
    xs = list(np.linspace(-39, 39, 313))
    got = values(spark, P.norm_cdf(F.col("x")), x=[float(x) for x in xs])
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-13
    sql = one(spark.sql(f"SELECT {P.norm_cdf_sql('x')} FROM (SELECT 0.37D AS x)"))
    assert sql == pytest.approx(0.5 * math.erfc(-0.37 / math.sqrt(2)), abs=1e-14)


def test_exceedance_is_exact_at_knots_and_monotone(spark):
    q = F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8, 1.0, 1.2)])
    at_knots = values(spark, P.exceedance_from_quantiles(q, F.col("t")), t=[0.2, 0.4, 0.6, 0.8, 1.0, 1.2])
    assert at_knots == pytest.approx([0.9, 0.75, 0.5, 0.25, 0.1, 0.05])
    curve = values(spark, P.exceedance_from_quantiles(q, F.col("t")), t=[float(x) for x in np.linspace(-1, 4, 200)])
    assert all(a >= b for a, b in zip(curve, curve[1:])) and 0 < curve[-1] < curve[0] <= 1
    assert values(spark, P.exceedance_from_quantiles(q, F.when(F.col("t") > 0, F.col("t"))), t=[-1.0]) == [None]


def test_missing_values_stay_missing(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS p, 1 AS lead, 0 AS ev, 0.5D AS q")
    assert df.select(S.logit("p"), S.clip("p", 0, 1), S.tail_bonus("p", "q")).first() == (None, None, None)


def test_evidence_precedence(spark):
    got = values(spark, S.evidence_strength("s", "n", "r", "p", 5), s=[0, 0, 1, 3, 0], n=[20, 20, 10, 50, 4], r=[0.3, 0.9, 0.1, 0.1, 0.1],
                 p=[0.2, 0.2, 0.9, 0.1, 0.1])
    assert got == [0, 1, 1, 3, 3]


def test_interpolation_matches_numpy(spark):
    xs, ys = [0.1, 0.4, 0.9], [0.0, 0.5, 0.6]
    pts = [float(x) for x in np.linspace(0, 1, 41)]
    arr = lambda v: F.array(*[F.lit(x) for x in v])                 # noqa: E731
    assert values(spark, CA.interpolate(F.col("x"), arr(xs), arr(ys)), x=pts) == pytest.approx(list(np.interp(pts, xs, ys)))
    assert values(spark, CA.interpolate(F.col("x"), arr([0.3]), arr([0.7])), x=[0.1, 0.3, 0.9]) == pytest.approx([0.7] * 3)
