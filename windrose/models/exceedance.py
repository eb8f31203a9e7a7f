"""Exceedance learners under one protocol: fit on TRAIN, stop early and calibrate on VALIDATION.

Trees come from ``models.boosting``; the forest of ``QuantileForest`` from ``pyspark.ml``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from windrose import constants as C
from windrose.models import boosting as BO
from windrose.models import calibration as CA
from windrose.operators.ordered import grouped_quantiles, ordered_totals
from windrose.session import checkpoint_dir
from windrose.sources.sinks import forbidden_columns


def allowed(features: Sequence[str]) -> tuple[str, ...]:
    """``features``, refusing verification columns and support counts."""
    bad = forbidden_columns(features)
    if bad:
        raise ValueError(f"verification columns offered as model inputs: {bad}")
    bad = [f for f in features if f in C.NON_MODEL_FEATURES]
    if bad:
        raise ValueError(f"support counts are no model inputs: {bad}")
    return tuple(features)


def _inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"in_{f}": F.col(f).cast("double") for f in allowed(features)})


def preparation(features: Sequence[str], out: str = "features") -> list:
    """Median imputation plus missing indicators: MLlib trees accept no missing values, so missingness becomes an input."""
    return [Imputer(strategy="median", inputCols=[f"in_{f}" for f in features], outputCols=[f"im_{f}" for f in features]),
            VectorAssembler(inputCols=[f"im_{f}" for f in features] + [f"na_{f}" for f in features], outputCol=out)]


def with_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    d = _inputs(df, features)
    return d.withColumns({f"na_{f}": F.col(f"in_{f}").isNull().cast("double") for f in features})


def drop_inputs(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("in_", "im_", "na_"))], "features", "rawPrediction", "probability", "prediction")


@dataclass
class ExceedanceModel:
    """Fitted trees with their calibrator; everything needed to score a batch or a stream.

    A model with an ``offset`` adds log-odds to that column of the rows it scores."""

    trees: BO.Trees
    calibrator: DataFrame | None = None
    params: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.trees.features

    def margin(self, df: DataFrame, out: str = "margin") -> DataFrame:
        return self.trees.predict(df, out)

    def raw(self, df: DataFrame, out: str = "raw_probability") -> DataFrame:
        return self.trees.predict(df, out).withColumn(out, 1 / (1 + F.exp(-F.col(out))))

    def score(self, df: DataFrame) -> DataFrame:
        """raw_probability and calibrated bust_probability, kept apart."""
        if self.calibrator is None:
            raise RuntimeError("model is not calibrated")
        return CA.calibrate(self.raw(df), self.calibrator, "raw_probability", "bust_probability")

    def importance(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.trees.importance().items()), "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def loss_curve(self, spark: SparkSession) -> DataFrame:
        """(trees, loss, kept): mean loss on the stopping rows by number of trees, and whether the model keeps that many."""
        return spark.createDataFrame([(i, float(x), i <= self.trees.rounds) for i, x in enumerate(self.trees.losses)], "trees int, loss double, kept boolean")

    def save(self, path: str, spark: SparkSession) -> None:
        self.trees.save(spark, f"{path}/trees")
        if self.calibrator is not None:
            self.calibrator.write.mode("overwrite").parquet(f"{path}/calibrator")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ExceedanceModel":
        return cls(BO.Trees.load(spark, f"{path}/trees"), spark.read.parquet(f"{path}/calibrator"))


def calibrated(df: DataFrame, trees: BO.Trees, label: str, params: dict) -> ExceedanceModel:
    """The model with an isotonic fit on its VALIDATION scores."""
    model = ExceedanceModel(trees, params=params)
    raw = model.raw(df.where("split = 'validation'").where(F.col(label).isNotNull()))
    model.calibrator = CA.fit_isotonic(raw, "raw_probability", label)
    return model


def fit_exceedance(df: DataFrame, features: Sequence[str], label: str = "bust", calibrate: bool = True, offset: str | None = None, **params) -> ExceedanceModel:
    """Boosted trees: TRAIN rows are fitted, VALIDATION rows stop the boosting and then fit the calibrator."""
    return fit_several(df, {"one": features}, label, calibrate, offset, **params)["one"]


def fit_several(df: DataFrame, groups: dict, label: str = "bust", calibrate: bool = True, offset: str | None = None,
                seeds: Sequence[int] | None = None, **params) -> dict:
    """One model for each entry of ``groups`` (name -> features) and each seed, all grown in step; keys are names, or (name, seed)."""
    p = dict(params)
    base = [p.pop("seed", BO.PARAMS["seed"])] if seeds is None else list(seeds)
    todo = [(name, seed) for name in groups for seed in base]
    trees = BO.fit(df, [BO.Fit(allowed(groups[name]), label, offset=offset, seed=seed) for name, seed in todo], **p)
    made = [calibrated(df, t, label, p) if calibrate else ExceedanceModel(t, params=p) for t in trees]
    return {name if seeds is None else (name, seed): m for (name, seed), m in zip(todo, made)}


def crossfit_margin(df: DataFrame, model: ExceedanceModel, period: Column, label: str = "bust") -> DataFrame:
    """Baseline log-odds per row: TRAIN rows get the margin of a fit that did not see their period (leave one out), all other
    rows the full model's.  The fits, one a period (years: a handful), are grown in step."""
    d = df.withColumn("_period", period.cast("string"))
    train = d.where("split = 'train'")
    periods = [r["_period"] for r in train.select("_period").distinct().orderBy("_period").collect()]      # a handful of values
    # as many trees as the full model has: a fold has no stopping rows of its own
    p = {**model.params, "rounds": model.trees.rounds}
    folds = BO.fit(d, [BO.Fit(tuple(model.features), label, f"split = 'train' AND _period <> '{x}'", "false") for x in periods], **p)
    out = model.margin(d.where("split <> 'train'"))
    for x, t in zip(periods, folds):
        out = out.unionByName(t.predict(train.where(F.col("_period") == x), "margin"))
    return out.drop("_period")


def fit_residual(with_margin: DataFrame, features: Sequence[str], label: str = "bust", calibrate: bool = True, **params) -> ExceedanceModel:
    """Trees that start from ``margin`` and add log-odds to it; VALIDATION decides how many, possibly none."""
    return fit_exceedance(with_margin, features, label, calibrate, offset="margin", **params)


# --- quantile family -----------------------------------------------------------------------------------------------------

@dataclass
class QuantileForest:
    """Leaf-quantile forest: the trees of a regression forest partition the inputs, TRAIN quantiles per leaf are averaged."""

    features: list[str]
    pipeline: PipelineModel
    leaves: DataFrame
    _grid: np.ndarray | None = None

    def _with_leaves(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(with_inputs(df, self.features)).withColumn("leaf", vector_to_array("leaf"))

    def _leaf_rows(self, df: DataFrame, *keep: Column | str) -> DataFrame:
        return self._with_leaves(df).select(*keep, F.posexplode("leaf").alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))

    def grid(self) -> np.ndarray:
        """(trees, leaves, levels): the leaf table, part of the model like its trees; NaN where a leaf has no TRAIN row."""
        if self._grid is None:
            rows = self.leaves.select("tree", "leaf", *C.QUANTILE_COLUMNS).toPandas()
            self._grid = np.full((len(self.pipeline.stages[-1].trees), int(rows["leaf"].max()) + 1 if len(rows) else 1, len(C.QUANTILE_COLUMNS)), np.nan)
            self._grid[rows["tree"], rows["leaf"]] = rows[list(C.QUANTILE_COLUMNS)]
        return self._grid

    def quantiles(self, df: DataFrame, key: str = "case_id") -> DataFrame:
        """key, q (ordered array over the quantile levels): a row's leaves are looked up in the broadcast leaf table, no row is exploded."""
        held = df.sparkSession.sparkContext.broadcast(self.grid())

        @pandas_udf("array<double>")
        def averaged(leaf: pd.Series) -> pd.Series:
            at = np.stack(leaf.to_numpy()).astype(int) if len(leaf) else np.zeros((0, len(held.value)), int)
            inside = at < held.value.shape[1]
            q = held.value[np.arange(at.shape[1]), np.where(inside, at, 0)]
            known = inside & ~np.isnan(q[:, :, 0])
            n = known.sum(axis=1)
            mean = np.where(known[:, :, None], q, 0.0).sum(axis=1) / np.maximum(n, 1)[:, None]
            return pd.Series([np.sort(x) if k else None for x, k in zip(mean, n)], dtype=object)
        return self._with_leaves(df).select(key, averaged("leaf").alias("q")).where(F.col("q").isNotNull())


def fit_quantile_forest(df: DataFrame, features: Sequence[str], target: str = "norm_error", trees: int = 20, depth: int = 6,
                        min_leaf: int = 50, seed: int = 20260928, key: str = "case_id") -> QuantileForest:
    checkpoint_dir(df.sparkSession)
    train = df.where(F.col("split") == "train").where(F.col(target).isNotNull())
    forest = RandomForestRegressor(labelCol=target, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
                                   leafCol="leaf", seed=seed)
    m = QuantileForest(list(features), Pipeline(stages=[*preparation(features), forest]).fit(with_inputs(train, features)), leaves=train)
    rows = m._leaf_rows(train, F.col(target).alias("_t"))
    m.leaves = grouped_quantiles(rows, ["tree", "leaf"], "_t", dict(zip(C.QUANTILE_COLUMNS, C.QUANTILE_LEVELS)))
    return m


@dataclass
class QuantileBoost:
    """One boosted ensemble per quantile level, grown in step; crossing quantiles are measured before they are sorted."""

    trees: list[BO.Trees]

    @property
    def features(self) -> list[str]:
        return self.trees[0].features

    def raw_quantiles(self, df: DataFrame) -> DataFrame:
        """``df`` with q10 .. q95 as the ensembles give them."""
        for name, t in zip(C.QUANTILE_COLUMNS, self.trees):
            df = t.predict(df, name)
        return df

    def quantiles(self, df: DataFrame, key: str = "case_id") -> DataFrame:
        """key, q (ordered array over the quantile levels), crossed (whether two raw ones were out of order)."""
        raw = F.array(*C.QUANTILE_COLUMNS)
        d = self.raw_quantiles(df.select(key, *self.features))
        return d.select(key, F.array_sort(raw).alias("q"), (raw != F.array_sort(raw)).alias("crossed"))


def fit_quantile_boost(df: DataFrame, features: Sequence[str], target: str = "norm_error", seed: int = BO.PARAMS["seed"], **params) -> QuantileBoost:
    """Six ensembles on TRAIN rows, stopped by the pinball loss on VALIDATION rows."""
    p = {"rate": 0.1, "depth": 4, "min_cases": 50, "min_curvature": 0.0, "shrink": 1.0, "columns": 1.0, **params}
    fits = [BO.Fit(allowed(features), target, level=level, seed=seed) for level in C.QUANTILE_LEVELS]
    return QuantileBoost(BO.fit(df, fits, **p))


def permutation_donors(df: DataFrame, permutations: int, seed: int, key: str = "case_id") -> DataFrame:
    """(perm, key, donor): for each permutation 0..n-1 the row whose value every row receives, a bijection over all rows.

    The row that is r-th in one random order receives from the row that is r-th in another; all orders are ranked by one
    distributed prefix sum over 64-bit hashes of the key (which must be unique)."""
    sides = F.explode(F.array(*[F.struct(F.lit(p).alias("perm"), F.lit(side).alias("side")) for p in range(permutations) for side in (0, 1)]))
    rows = df.select(key, sides.alias("s")).select(key, "s.*").withColumn("h", F.xxhash64(F.col(key), "perm", "side", F.lit(seed)))
    rank = ordered_totals(rows, ["perm", "side"], "h", {"n": F.lit(1)}).select("perm", "side", "h", F.col("below_n").alias("r"))
    ranked = rows.join(rank, ["perm", "side", "h"])
    return ranked.where("side = 0").select("perm", "r", key).join(ranked.where("side = 1").select("perm", "r", F.col(key).alias("donor")), ["perm", "r"]).drop("r")


def permute_column(df: DataFrame, column: str, seed: int, key: str = "case_id") -> DataFrame:
    """The rows with ``column`` randomly permuted over all of them."""
    values = df.select(F.col(key).alias("donor"), F.col(column).alias("_v"))
    donors = permutation_donors(df, 1, seed, key).drop("perm").join(values, "donor").drop("donor")
    return df.join(donors, key).withColumn(column, F.col("_v")).drop("_v")


def group_attribution(df: DataFrame, model: ExceedanceModel, groups: dict[str, Sequence[str]], key: str = "case_id") -> DataFrame:
    """Per row and group the log-odds that the group's inputs add (Shapley values of the trees): with mean and offset they sum to the margin."""
    return BO.group_sums(BO.explain(model.trees, df, [key]), groups, [key])
