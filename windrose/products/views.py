"""Serving views: the tables a user interface or report reads, one row per served record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.functions import scalar as S


def feature_dimension(spark: SparkSession) -> DataFrame:
    """(feature, group_name, label): the lookup every feature listing joins (fixed size, far below the broadcast limit)."""
    rows = [(f, g, C.FEATURE_LABELS.get(f, f"pattern PC{f[2:]} coordinate" if f.startswith("pc") and f[2:].isdigit() else f))
            for g, fs in C.FEATURE_GROUPS.items() for f in fs]
    return spark.createDataFrame(rows, "feature string, group_name string, label string")


def top_drivers(rows: DataFrame, contributions: Mapping[str, Column], n: int, key: str = "case_id") -> DataFrame:
    """The n largest |contributions| of every row, as rows (rank, feature, contribution, direction).

    Sorting a short array per row needs no shuffle."""
    items = F.array(*[F.struct((-F.abs(c)).alias("o"), F.lit(f).alias("feature"), c.alias("contribution")) for f, c in contributions.items()])
    top = F.slice(F.array_sort(items), 1, n)
    out = rows.select(key, F.posexplode(top).alias("rank", "d")).select(
        key, (F.col("rank") + 1).alias("rank"), F.col("d.feature").alias("feature"), F.col("d.contribution").alias("contribution"))
    return out.withColumn("direction", F.when(F.col("contribution") > 0, "raises risk").otherwise("lowers risk"))


def name_of(level: str, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(level) + 1)


def cell_record(rows: DataFrame, p: str, p_clim: str, threshold: float, kmin: int = C.ANALOGUE_MIN) -> DataFrame:
    """One served record per case: probability, risk, support, evidence, priority.

    Needs support_level, n_within, n_used, analogue_rate and base_rate next to the case columns."""
    r = rows.withColumn("evidence_level", S.evidence_strength("support_level", "n_within", "analogue_rate", p, kmin))
    return r.select(
        "case_id", "init_time", "region_id", "lead_day", "valid_time", F.col(p).alias("bust_probability"), F.col(p_clim).alias("b0_probability"),
        S.risk_level(p, p_clim, threshold).alias("risk_level"), (F.col(p) >= threshold).cast("int").alias("alert"),
        S.criterion_level("analogue_rate", "base_rate", "n_used", kmin).alias("analogue_evidence"),
        name_of("support_level", C.SUPPORT_LEVELS).alias("support"), name_of("evidence_level", C.EVIDENCE_NAMES).alias("evidence_quality"),
        S.priority_score(p, "lead_day", "evidence_level").alias("priority_score"))


def case_overview(records: DataFrame, queue_length: int = 20) -> DataFrame:
    """Per initialisation: alert count, mean and peak probability, and its review queue (at most ``queue_length`` ids)."""
    rank = W.partitionBy("init_time").orderBy(F.desc("priority_score"), "case_id")
    queue = (records.select("init_time", "case_id", "priority_score").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= queue_length)
             .groupBy("init_time").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "case_id"))), lambda x: x["case_id"].cast("string")), ",").alias("queue")))
    g = records.groupBy("init_time").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("alert").alias("n_alerts"), F.avg("bust_probability").alias("mean_p"),
                                         F.max("bust_probability").alias("peak_p"))
    return g.join(queue, "init_time")


def default_lead(trajectories: DataFrame, p: str) -> DataFrame:
    """The row of each (init, region) shown when no lead is asked for: the first peak day."""
    best = trajectories.groupBy("init_time", "region_id").agg(F.max(F.struct(F.col(p).alias("v"), (-F.col("lead_day")).alias("d"))).alias("_m"))
    day = best.select("init_time", "region_id", (-F.col("_m.d")).alias("lead_day"))
    return trajectories.join(day, ["init_time", "region_id", "lead_day"])


def history_view(listing: DataFrame, expected: DataFrame) -> DataFrame:
    """Analogue ids in order of distance (a fixed number per case) with the expected signature."""
    ids = listing.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"].cast("string")), ",").alias("nearest"))
    return ids.join(expected, "case_id")


def reveal(cases: DataFrame, expected: DataFrame, p: str, threshold: float) -> DataFrame:
    """Forecast against verification: alert, outcome, expected and actual signature; the match is defined for busts only."""
    j = cases.join(expected.select("case_id", "expected_top"), "case_id", "left")
    return j.select("case_id", (F.col(p) >= threshold).cast("int").alias("alert"), F.col("bust").alias("actual_bust"), "norm_error", "expected_top",
                    F.when(F.col("bust") == 1, F.col("sig_class")).alias("actual_signature"),
                    F.when(F.col("bust") == 1, (F.col("expected_top") == F.col("sig_class")).cast("int")).alias("signature_match"))


def metrics_bundle(board: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return board.select("model", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def provider_status(provenance: DataFrame, expected_leads: Sequence[int], min_members: int) -> DataFrame:
    """Per provider: initialisations, first and last, smallest ensemble, inits with all leads, readiness."""
    full = ",".join(str(x) for x in expected_leads)
    g = provenance.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n_inits"), F.min("init_time").alias("first_init"), F.max("init_time").alias("last_init"),
        F.min("n_members").alias("min_members"), F.count(F.when(F.col("leads") == full, 1)).alias("complete_inits"))
    return g.withColumn("ready", ((F.col("min_members") >= min_members) & (F.col("complete_inits") == F.col("n_inits"))).cast("int"))


def field_arrays(cells: DataFrame, value: str, by: str = "init_time") -> DataFrame:
    """Nested arrays [lead][lon][lat] of one field per initialisation; the size is the grid times the lead set."""
    lat = cells.groupBy(by, "lead_day", "col_n").agg(F.sort_array(F.collect_list(F.struct("row_n", value))).alias("a"))
    lon = lat.groupBy(by, "lead_day").agg(F.sort_array(F.collect_list(F.struct("col_n", F.col(f"a.{value}").alias("v")))).alias("a"))
    return lon.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("lead_day", F.col("a.v").alias("v")))).alias("a")).select(by, F.col("a.v").alias("field"))
