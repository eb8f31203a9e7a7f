"""Streams that stop and go on, and rows that come too late."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from windrose.session import scratch_path
from windrose.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
FACTS = "region_id string, valid_time timestamp, norm_error double, bias_m double"


def day(spark, path, n, regions=("r1", "r2"), extra=()):
    rows = [(r, T0 + dt.timedelta(days=n, hours=h), float(n + h), float(h)) for r in regions for h in (0, 6, 12)] + list(extra)
    spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("append").parquet(path)
    return rows


def stream(spark, path):
    return spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(path)


def test_trailing_errors_resume_and_late_rows_go_to_the_side_table(spark):
    src, out, state, side, side_state = (scratch_path(spark, n) for n in ("src", "out", "state", "side", "side-state"))

    def run():
        J.run_available(J.trailing_errors(stream(spark, src), lateness="2 days"), "recent", mode="update", out=out, state=state)
        J.record_late_rows(stream(spark, src), "valid_time", "2 days", side, side_state)
        return J.latest(spark.read.parquet(out), ["region_id", "init_time"])
    kept = day(spark, src, 0) + day(spark, src, 1)
    run()                                                             # stops here; the rest arrives later
    kept += day(spark, src, 2) + day(spark, src, 30)
    late = ("r1", T0 + dt.timedelta(days=1), 1000.0, 1000.0)
    kept += day(spark, src, 31)
    day(spark, src, 32, extra=[late])
    kept += [(r, T0 + dt.timedelta(days=32, hours=h), 32.0 + h, float(h)) for r in ("r1", "r2") for h in (0, 6, 12)]
    got = {(r["region_id"], r["init_time"]): (r["rec_err"], r["rec_n"]) for r in run().collect()}
    want = {}
    for region in ("r1", "r2"):
        for n in range(0, 40):
            end = T0 + dt.timedelta(days=n)
            inside = [e for r, t, e, _ in kept if r == region and end - dt.timedelta(days=5) < t <= end]
            if inside:
                want[(region, end)] = (pytest.approx(sum(inside) / len(inside)), len(inside))
    assert got == want
    assert [tuple(r)[:4] for r in spark.read.parquet(f"{side}/late").collect()] == [late]
    assert spark.read.parquet(f"{side}/seen").agg(F.max("epoch")).first()[0] == 5          # six files, none twice


def test_verified_join_resumes_without_repeating_rows(spark):
    fsrc, vsrc, out, state = (scratch_path(spark, n) for n in ("f", "v", "out", "state"))
    F_SCHEMA, V_SCHEMA = "region_id string, init_time timestamp, valid_time timestamp, p double", "region_id string, valid_time timestamp, observed double"

    def put(n):
        t = T0 + dt.timedelta(days=n)
        spark.createDataFrame([("r", t, t + dt.timedelta(days=k), float(k)) for k in (1, 2)], F_SCHEMA).coalesce(1).write.mode("append").parquet(fsrc)
        spark.createDataFrame([("r", t, float(n))], V_SCHEMA).coalesce(1).write.mode("append").parquet(vsrc)

    def run():
        f = spark.readStream.schema(F_SCHEMA).option("maxFilesPerTrigger", 1).parquet(fsrc)
        v = spark.readStream.schema(V_SCHEMA).option("maxFilesPerTrigger", 1).parquet(vsrc)
        J.run_available(J.verified_forecasts(f, v, 2, "1 day"), "verified", out=out, state=state)
        return sorted((r["init_time"], r["p"], r["observed"]) for r in spark.read.parquet(out).collect())
    for n in range(3):
        put(n)
    first = run()
    for n in range(3, 6):
        put(n)
    day_of = lambda n: T0 + dt.timedelta(days=n)                       # noqa: E731
    pairs = lambda last: sorted((day_of(n), float(k), float(n + k)) for n in range(last + 1) for k in (1, 2) if n + k <= last)      # noqa: E731
    assert first == pairs(2) and run() == pairs(5)
    with pytest.raises(ValueError):
        J.run_available(spark.readStream.schema(V_SCHEMA).parquet(vsrc), "x", out=out)


def test_replayed_days_lose_no_rows_however_many_files_they_have(spark, monkeypatch):
    from windrose.plans import products as P
    rows = [("r", T0 + dt.timedelta(hours=h), float(h % 7), float(h % 5)) for h in range(1, 24 * 24)]
    facts = spark.createDataFrame(rows, FACTS).repartition(7)
    if hasattr(P, "FILE_ROWS"):
        monkeypatch.setattr(P, "FILE_ROWS", 5)
    s = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 2).parquet(P._files(facts, "valid_time", "facts"))
    out = J.run_available(J.trailing_errors(s, lateness="2 days"), "recent", mode="update")
    got = {r["init_time"]: r["rec_n"] for r in J.latest(spark.read.parquet(out), ["region_id", "init_time"]).collect()}
    ends = [T0 + dt.timedelta(days=n) for n in range(1, 30)]
    want = {e: sum(e - dt.timedelta(days=5) < t <= e for _, t, _, _ in rows) for e in ends}
    assert got == {e: n for e, n in want.items() if n}
