"""Historical support: shrunk-covariance distance of a case from the TRAIN cloud of its lead day."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.functions.scalar import clip
from windrose.operators.ordered import grouped_quantiles
from windrose.session import stored_once


def _shrink(moments: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second moments of one lead -> precision of the Ledoit-Wolf covariance (one small row in, one out)."""
    for block in moments:
        rows = []
        for r in block.itertuples(index=False):
            p = len(r.location)
            s = np.zeros((p, p))
            s[np.triu_indices(p)] = r.second
            s = s + np.triu(s, 1).T
            mu, d2 = np.trace(s) / p, float((s * s).sum())
            spread = (r.fourth - d2) / (p * r.n)
            gap = (d2 - 2 * mu * np.trace(s) + p * mu * mu) / p
            a = 0.0 if gap <= 0 else min(max(spread, 0.0), gap) / gap
            inv = np.linalg.inv((1 - a) * s + a * mu * np.eye(p))
            rows.append({"lead_day": r.lead_day, "location": list(r.location), "precision": inv.ravel().tolist(), "shrinkage": a, "n_train": r.n})
        yield pd.DataFrame(rows, columns=["lead_day", "location", "precision", "shrinkage", "n_train"])


def fit_covariance(cases: DataFrame, space: Sequence[str]) -> DataFrame:
    """Per lead: location, precision, shrinkage.  Two distributed passes over TRAIN rows (means, then centred second
    moments and mean fourth norm); the matrix algebra happens on one row per lead."""
    train = cases.where(F.col("split") == "train")
    for c in space:
        train = train.where(F.col(c).isNotNull())
    means = train.groupBy("lead_day").agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(space)])
    z = train.join(means, "lead_day").select("lead_day", *[(F.col(c) - F.col(f"_m{i}")).alias(f"_z{i}") for i, c in enumerate(space)],
                                             *[f"_m{i}" for i in range(len(space))])
    d = range(len(space))
    norm2 = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in d), F.lit(0.0))
    upper = [F.avg(F.col(f"_z{i}") * F.col(f"_z{j}")) for i in d for j in d if i <= j]
    mom = z.groupBy("lead_day").agg(F.array(*[F.max(f"_m{i}") for i in d]).alias("location"), F.array(*upper).alias("second"),
                                    F.avg(norm2 * norm2).alias("fourth"), F.count(F.lit(1)).alias("n"))
    return mom.mapInPandas(_shrink, "lead_day int, location array<double>, precision array<double>, shrinkage double, n_train bigint")


def distance(cases: DataFrame, params: DataFrame, space: Sequence[str], out: str = "support_distance") -> DataFrame:
    """sqrt((x - m)' P (x - m)); NULL when a coordinate is missing or the lead has no TRAIN rows."""
    p = len(space)
    j = cases.join(params.select("lead_day", "location", "precision"), "lead_day", "left")
    diff = [F.col(c) - F.col("location")[i] for i, c in enumerate(space)]
    quad = None
    for a in range(p):
        for b in range(p):
            term = diff[a] * F.col("precision")[a * p + b] * diff[b]
            quad = term if quad is None else quad + term
    return j.withColumn(out, F.sqrt(clip(quad, 0.0))).drop("location", "precision")


def fit_support(cases: DataFrame, space: Sequence[str], quantiles: Sequence[float] = C.SUPPORT_QUANTILES) -> DataFrame:
    """Covariance parameters with the TRAIN distance quantiles t0 < t1 < t2 that separate the support levels.

    The parameters are written once (one row per lead): thresholds and later distances follow from the same bits, so a case whose
    distance is a threshold reaches it."""
    params = stored_once(fit_covariance(cases, space), "covariance")
    d = distance(cases.where("split = 'train'"), params, space, "_d")
    names = {f"t{i}": q for i, q in enumerate(quantiles)}
    return params.join(grouped_quantiles(d, ["lead_day"], "_d", names), "lead_day").withColumn("fitted_on", F.lit("train"))


def support_levels(cases: DataFrame, support: DataFrame, space: Sequence[str], n_levels: int = 3) -> DataFrame:
    """Distance and level 0..3 (number of thresholds <= distance); a missing distance has no support."""
    d = distance(cases, support, space).join(support.select("lead_day", *[f"t{i}" for i in range(n_levels)]), "lead_day", "left")
    level = sum(((F.col("support_distance") >= F.col(f"t{i}")).cast("int") for i in range(n_levels)), F.lit(0))
    return d.withColumn("support_level", F.coalesce(level, F.lit(3)).cast("int")).drop(*[f"t{i}" for i in range(n_levels)])
