"""Registry of runnable queries over the driver's tables, each with its cross-check SQL.

A query callable returns the library's result; the registry only normalises the output for comparison:
doubles are rounded to six digits, times are zone-free.  The rounding adds a tiny constant first, because
exact decimal ties (common when averaging two-decimal inputs) are rounded differently by different engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrose.session import pin_utc, ship_code

DIGITS, NUDGE = 6, 2e-8


@dataclass(frozen=True)
class Query:
    key: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def comparable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.ShortType, T.ByteType)):
            c = c.cast("int")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def comparable_sql(body: str, doubles: Sequence[str]) -> str:
    if not doubles:
        return f"SELECT * FROM ({body}) AS result"
    rep = ", ".join(f"round({d} + 2e-8, {DIGITS}) + 0e0 AS {d}" for d in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({body}) AS result"


def query(key: str, sql: str | None = None, ctes: str = "", doubles: str = ""):
    """Register ``fn(spark, sf_dir)`` under ``key``.  ``ctes`` is the WITH list the SQL body needs."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(ship_code(pin_utc(spark)), sf_dir))
        text = None
        if sql is not None:
            text = comparable_sql(sql, doubles.split())
            if ctes:
                text = f"WITH {ctes} {text}"
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = Query(key, run, text)
        return fn
    return register
