"""A value that equals an interpolated threshold is neither above nor below it, whatever the last bits of the quotients say."""

import datetime as dt
import random

import duckdb

from __spark_entry__ import oracle_sql, queries
from windrose.plans import bridge as B

T0 = dt.datetime(2024, 1, 2)


def events():
    """Nine regions x 12 TRAIN errors on two days; the threshold lies 0.9 of the way from 3.3 to 4.3, and later cases of 4.2 equal it."""
    rng, rows = random.Random(3), []
    for user in range(9):
        for day in (0, 1):
            at = T0 + dt.timedelta(days=day)
            values = [round(rng.uniform(0.5, 3.2), 2) for _ in range(9)] + [3.3, 4.3, 9.9]
            rng.shuffle(values)
            rows += [(at + dt.timedelta(hours=i), user, v) for i, v in enumerate(values)]
            rows += [(at + dt.timedelta(days=2 * k, hours=20), user, round(rng.uniform(0.5, 60), 2)) for k in (1, 2, 3)]       # other leads: they make the scale
            rows += [(at + dt.timedelta(days=24, hours=i), user, v) for i, v in enumerate((4.2, 4.21, 4.19))]
    lead = lambda ts: 0 if ts.hour != 20 else 1         # noqa: E731
    return [(5 * i + lead(ts), ts, user, "error", v, '{"k": %d}' % (i % 90)) for i, (ts, user, v) in enumerate(rows)]


def test_bust_labels_and_its_sql_agree_on_errors_equal_to_the_threshold(spark, tmp_path):
    spark.createDataFrame(events(), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(
        f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    errors = {r["case_id"]: r["error_m"] for r in B.cases(spark, str(tmp_path)).where("split = 'test'").collect()}
    cur = con.execute(oracle_sql()["bust_labels"])
    names = [d[0] for d in cur.description]
    sql = {r["case_id"]: r["bust"] for r in (dict(zip(names, x)) for x in cur.fetchall())}
    got = {r["case_id"]: r["bust"] for r in queries()["bust_labels"](spark, str(tmp_path)).collect()}
    assert got == sql
    assert sorted(errors.values()) == [4.19] * 18 + [4.2] * 18 + [4.21] * 18
    assert {k: got[k] for k in errors} == {k: int(v > 4.2) for k, v in errors.items()}
