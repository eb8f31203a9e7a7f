"""Case selection: stress cases by verification, random cases by a seeded hash, representative cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.functions.random import seeded_hash


def stress_inits(test: DataFrame, n: int = 4) -> DataFrame:
    """The n initialisations with most hidden busts at Day 3-7; ties by earlier init."""
    mid = test.where(F.col("lead_day").between(3, 7)).groupBy("init_time").agg(F.sum("hidden_bust").alias("n_hidden"))
    return mid.orderBy(F.desc("n_hidden"), "init_time").limit(n)


def random_pool(test: DataFrame, n_stress: int = 4) -> DataFrame:
    return test.select("init_time").distinct().subtract(stress_inits(test, n_stress).select("init_time"))


def random_inits(test: DataFrame, seed: int, n: int = 8, n_stress: int = 4) -> DataFrame:
    """n initialisations without replacement outside the stress set; the hash order depends on the key and the seed
    only, never on partitioning."""
    h = seeded_hash(seed, F.date_format("init_time", "yyyyMMddHH"))
    return random_pool(test, n_stress).orderBy(h, "init_time").limit(n)


def representative_cases(drawn: DataFrame, stress: DataFrame) -> DataFrame:
    """First drawn case of each season plus the earliest stress case."""
    first = W.partitionBy("season").orderBy("init_time")
    rep = (drawn.withColumn("_r", F.row_number().over(first)).where("_r = 1")
           .select("init_time", "season", F.lit("representative").alias("role")))
    return rep.unionByName(stress.orderBy("init_time").limit(1).select("init_time", "season", F.lit("stress").alias("role")))


def sample_rows(rows: DataFrame, n: int, seed: int, key: str = "case_id") -> DataFrame:
    """Fixed-size sample in seeded hash order (TakeOrderedAndProject: n rows per task, then n rows)."""
    return rows.orderBy(seeded_hash(seed, F.col(key).cast("string")), key).limit(n)
