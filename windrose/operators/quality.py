"""Data-quality operators: contracts, integrity checks, parity and causality; each returns a small report table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.functions import scalar as S
from windrose.operators.labels import TIE


def causality(neighbours: DataFrame, cases: DataFrame) -> DataFrame:
    """Every retrieved neighbour must be verified no later than the query's init time."""
    q = cases.select("case_id", F.col("init_time").alias("_t"))
    c = cases.select(F.col("case_id").alias("neighbour"), F.col("valid_time").alias("_v"))
    j = neighbours.join(q, "case_id").join(c, "neighbour")
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), F.count(F.when(F.col("_v") > F.col("_t"), 1)).alias("n_violations"))


def fit_causality(params: DataFrame) -> DataFrame:
    """Rolling parameters: the latest case used must be verified by the fit day."""
    return params.agg(F.count(F.lit(1)).alias("n_fits"),
                      F.count(F.when(F.col("last_verified") > F.col("fit_day").cast("timestamp"), 1)).alias("n_violations"))


def forecast_contract(members: DataFrame, units: str, min_members: int = C.MIN_MEMBERS,
                      required: Sequence[str] = ("init_time", "lead_day", "level", "lat", "lon", "member", "value")) -> DataFrame:
    """Violations of the canonical forecast contract as rows (check, detail); no rows = valid.

    Columns and units are decided on the schema; members and coordinate spacing need one aggregation each over
    distinct coordinates."""
    spark = members.sparkSession
    problems = [("missing_column", c) for c in required if c not in members.columns]
    if units not in C.GEOPOTENTIAL_UNITS:
        problems.append(("units", units))
    static = spark.createDataFrame(problems, "check string, detail string")
    if any(k == "missing_column" for k, _ in problems):
        return static
    few = (members.agg(F.count_distinct("member").alias("n")).where(F.col("n") < min_members)
           .select(F.lit("members").alias("check"), F.col("n").cast("string").alias("detail")))
    out = static.unionByName(few)
    lon = members.agg(F.min("lon").alias("a"), F.max("lon").alias("b")).where((F.col("a") < 0) | (F.col("b") >= 360))
    out = out.unionByName(lon.select(F.lit("lon_range").alias("check"), F.concat_ws("..", "a", "b").alias("detail")))
    steps = members.select("lat").distinct().select((F.lead("lat").over(W.partitionBy(F.lit(0)).orderBy("lat")) - F.col("lat")).alias("d"))
    irregular = steps.agg(F.min("d").alias("a"), F.max("d").alias("b")).where(F.abs(F.col("b") - F.col("a")) > 1e-6)
    return out.unionByName(irregular.select(F.lit("lat_spacing").alias("check"), F.concat_ws("..", "a", "b").alias("detail")))


def extras_integrity(extras: DataFrame, expected: DataFrame, keys: Sequence[str], ranges: Mapping[str, tuple[float, float]],
                     n_members: int) -> DataFrame:
    """Per block key: missing, orphan, member count, missing values and values outside plausible ranges."""
    problems = []
    for v, (lo, hi) in ranges.items():
        c = F.col(v)
        problems += [F.when(c.isNull() | F.isnan(c), F.lit(f"{v}: missing")), F.when((c < lo) | (c > hi), F.lit(f"{v}: range"))]
    problems.append(F.when(F.col("n_members") < n_members, F.lit("n_members")))
    checked = extras.withColumn("_p", F.filter(F.array(*problems), lambda x: x.isNotNull())).withColumn("_e", F.lit(True))
    j = checked.select(*keys, "_p", "_e").join(expected.select(*keys).distinct().withColumn("_x", F.lit(True)), list(keys), "full_outer")
    p = F.when(F.col("_e").isNull(), F.array(F.lit("missing"))).when(F.col("_x").isNull(), F.array(F.lit("orphan"))).otherwise(F.col("_p"))
    return j.select(*keys, F.array_join(p, "; ").alias("problems")).where("problems <> ''")


def retrieval_checks(members: DataFrame, leads: Sequence[int], domain: Mapping[str, float], spacing: float, plausible: tuple[float, float]) -> DataFrame:
    """One row of boolean checks on what a provider delivered."""
    v = S.nan_to_null(F.col("value").cast("double"))
    half = spacing / 2
    a = members.agg(F.count_distinct("member").alias("m"), F.sort_array(F.collect_set("lead_day")).alias("leads"), F.min("lat").alias("la0"),
                    F.max("lat").alias("la1"), F.min("lon").alias("lo0"), F.max("lon").alias("lo1"), F.avg(v).alias("mean"),
                    F.count(F.when(v.isNull(), 1)).alias("n_missing"), F.stddev_samp(v).alias("sd"), F.count(F.lit(1)).alias("n"))
    ok = lambda c: c.cast("int")                                          # noqa: E731
    want = F.array(*[F.lit(x) for x in leads])
    checks = {
        "members_present": ok(F.col("m") >= 2), "leads_complete": ok(F.size(F.array_except(want, F.col("leads"))) == 0),
        "domain_covered": ok((F.col("la0") <= domain["lat_min"] + half) & (F.col("la1") >= domain["lat_max"] - half)
                             & (F.col("lo0") <= domain["lon_min"] + half) & (F.col("lo1") >= domain["lon_max"] - half)),
        "longitude_range": ok((F.col("lo0") >= 0) & (F.col("lo1") < 360)), "plausible_mean": ok(F.col("mean").between(*plausible)),
        "spread_computed": ok(F.col("sd") >= 0)}
    allp = F.lit(1)
    for c in checks.values():
        allp = F.least(allp, F.coalesce(c, F.lit(0)))
    return a.select(*[c.alias(n) for n, c in checks.items()], allp.alias("all_passed"), (F.col("n_missing") / F.col("n")).alias("missing_share"))


def label_integrity(labels: DataFrame, thresholds: DataFrame, period_end: str) -> DataFrame:
    """Labels follow the rule, thresholds equal the recomputed TRAIN quantiles, valid = init + lead, no late TRAIN row."""
    t = thresholds.select(*C.GROUP, F.col("q_primary").alias("_q"))
    j = labels.join(t, list(C.GROUP), "left")
    n = lambda c: F.count(F.when(c, 1))                                   # noqa: E731
    rule = (F.col("norm_error") > F.col("q_primary") + TIE).cast("int")
    return j.agg(
        F.count(F.lit(1)).alias("n_rows"), n(F.coalesce(rule, F.lit(0)) != F.col("bust")).alias("bad_bust"),
        F.coalesce(F.max(F.abs(F.col("q_primary") - F.col("_q"))), F.lit(0.0)).alias("max_threshold_diff"),
        n(F.col("valid_time") != S.valid_time("init_time", F.col("lead_day") * 24)).alias("bad_valid_time"),
        n((F.col("split") == "train") & (F.col("valid_time") > F.lit(period_end).cast("timestamp"))).alias("late_train_rows"),
        n(F.col("hidden_bust") != F.col("bust") * F.col("low_spread")).alias("bad_hidden"))


def prediction_parity(stored: DataFrame, recomputed: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    j = stored.select("case_id", *by, value).join(recomputed.select("case_id", F.col(value).alias("_v")), "case_id")
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col(value) - F.col("_v"))).alias("max_abs_diff")]
    return j.groupBy(*by).agg(*aggs) if by else j.agg(*aggs)


def require_fitted_on(params: DataFrame, period: str) -> DataFrame:
    """Refuse parameters fitted on any other period (error at run time, row by row)."""
    ok = F.when(F.col("fitted_on") == period, True).otherwise(
        F.raise_error(F.concat(F.lit(f"parameters must be fitted on {period}, got "), F.coalesce("fitted_on", F.lit("NULL")))).cast("boolean"))
    return params.where(ok)
