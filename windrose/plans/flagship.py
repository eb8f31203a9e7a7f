"""End-to-end slice and the label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windrose.operators import labels as L
from windrose.plans import bridge as B
from windrose.plans.registry import query


@query("split_summary", ctes=B.LABELLED, doubles="bust_rate bust_q95_rate hidden_rate", sql="""
  SELECT split, count(*) AS n_rows, avg(bust) AS bust_rate, avg(bust_q95) AS bust_q95_rate, avg(hidden_bust) AS hidden_rate,
         count(DISTINCT init_time) AS n_inits, min(init_time) AS first_init, max(init_time) AS last_init
  FROM labelled GROUP BY split""")
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return L.split_summary(B.labelled_plan(spark, sf))


@query("bust_labels", ctes=B.LABELLED_TIES, doubles="norm_error q_primary spread_low", sql="""
  SELECT case_id, split, norm_error, q_primary, spread_low, bust, bust_q95, low_spread, hidden_bust FROM labelled""")
def bust_labels(spark: SparkSession, sf: str) -> DataFrame:
    return B.labelled_plan(spark, sf).select("case_id", "split", "norm_error", "q_primary", "spread_low", "bust", "bust_q95",
                                        "low_spread", "hidden_bust")
