"""Large-scale pattern features: principal components of forecast anomaly maps, fitted on TRAIN initialisations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def maps_to_vectors(cells: DataFrame, value: str, keys: Sequence[str], n_row: int, n_col: int) -> DataFrame:
    """One weighted anomaly map per (init, lead): sqrt(cos lat) x anomaly in fixed cell order; an absent cell is 0 (climatology).
    The array has one element per grid cell."""
    weighted = F.coalesce(F.col(value) * F.sqrt(F.cos(F.radians("lat"))), F.lit(0.0))
    g = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((F.col("row_n") * n_col + F.col("col_n")).alias("i"), weighted.alias("v")))).alias("_m"))
    arr = F.transform(F.sequence(F.lit(0), F.lit(n_row * n_col - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    return g.select(*keys, array_to_vector(arr).alias("map"))


def fit(train_maps: DataFrame, k: int = 8) -> PipelineModel:
    """MLlib's PCA projects without centring, so the mean is removed by a scaler stage in front of it."""
    return Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="map", outputCol="centred"),
                            PCA(k=k, inputCol="centred", outputCol="pcs")]).fit(train_maps)


def explained(model: PipelineModel) -> list[float]:
    return [float(x) for x in model.stages[1].explainedVariance]


def component_variances(model: PipelineModel, train_maps: DataFrame) -> list[float]:
    """Variance of each component = explained ratio x total TRAIN variance (one aggregation to one number)."""
    c = vector_to_array("centred")
    total = model.transform(train_maps).agg(F.sum(F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)).alias("s"),
                                            F.count(F.lit(1)).alias("n")).first()
    return [r * total["s"] / (total["n"] - 1) for r in explained(model)]


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def scores(maps: DataFrame, model: PipelineModel, variances: Sequence[float]) -> DataFrame:
    """pcs (array), pc_norm = sqrt(sum (pc / sd)^2), pc_resid = share of the map's variance outside the components."""
    p = model.transform(maps).withColumns({"pcs": vector_to_array("pcs"), "_c": vector_to_array("centred")})
    var = F.array(*[F.lit(float(v)) for v in variances])
    norm = F.sqrt(_sum(F.zip_with("pcs", var, lambda x, v: x * x / v)))
    whole = _sum(F.transform("_c", lambda x: x * x))
    inside = _sum(F.transform("pcs", lambda x: x * x))
    resid = F.greatest(whole - inside, F.lit(0.0)) / F.greatest(whole, F.lit(1e-9))
    return p.withColumns({"pc_norm": norm, "pc_resid": resid}).drop("map", "centred", "_c")


def pattern_revision(scored: DataFrame, previous_init: Column, variances: Sequence[float]) -> DataFrame:
    """Distance in scaled PC space to the previous cycle's forecast for the same valid time."""
    prev = scored.select("valid_time", F.col("init_time").alias("_init"), F.col("pcs").alias("_p"))
    var = F.array(*[F.lit(float(v)) for v in variances])
    d = F.zip_with("pcs", "_p", lambda a, b: a - b)
    j = scored.withColumn("_init", previous_init).join(prev, ["valid_time", "_init"], "left")
    return j.withColumn("rev_pc", F.when(F.col("_p").isNotNull(), F.sqrt(_sum(F.zip_with(d, var, lambda x, v: x * x / v))))).drop("_init", "_p")
