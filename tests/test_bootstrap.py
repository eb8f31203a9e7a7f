"""Vector bootstrap against replicates written out row by row."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.evaluation import bootstrap as BS
from windrose.evaluation import ranking as R

T0 = dt.datetime(2024, 1, 1)


def frame(spark, n=900, days=15, ties=False, seed=3):
    rng = np.random.default_rng(seed)
    score = rng.random(n) if not ties else np.round(rng.random(n), 1)
    rows = [("a" if i % 3 else "b", (T0 + dt.timedelta(days=int(rng.integers(days)))).date(), int(rng.random() < 0.3 * (1 + score[i])), float(score[i]))
            for i in range(n)] + [("a", T0.date(), 1, None), ("a", T0.date(), None, 0.5)]
    return spark.createDataFrame(rows, "model string, day date, y int, p double")


@pytest.mark.parametrize("ties,slot_rows", [(False, 40), (True, 40), (False, None)])
def test_metrics_equal_expanded_replicates(spark, ties, slot_rows):
    df = frame(spark, ties=ties)
    weights = BS.day_weights(df.select("day").distinct(), 6, 5)
    got = {(r["model"], r["rep"]): r for r in BS.replicate_metrics(df, weights, "y", "p", ["model"], slot_rows=slot_rows).collect()}
    fan = df.join(weights, "day").withColumn("_copy", F.expr("explode(sequence(1, int(weight)))")).where("p IS NOT NULL")
    want = R.ranking_metrics(fan, "y", "p", ["model", "rep"]).collect()
    assert len(want) == len(got) == 12
    for r in want:
        mine = got[(r["model"], r["rep"])]
        assert mine["auprc"] == pytest.approx(r["auprc"]) and mine["roc_auc"] == pytest.approx(r["roc_auc"])
        assert mine["recall_at_far"] == pytest.approx(r["recall_at_far_10"])


def test_replicates_in_batches_and_single_class(spark, monkeypatch):
    df = frame(spark, 200)
    weights = BS.day_weights(df.select("day").distinct(), 7, 5)
    rows = lambda d: sorted(tuple(r) for r in BS.replicate_metrics(d, weights, "y", "p", ["model"]).collect())      # noqa: E731
    whole = rows(df)
    monkeypatch.setattr(BS, "_MATRIX_CELLS", 45)                      # three replicates a batch
    again = rows(df)
    assert [r[:2] for r in again] == [r[:2] for r in whole]
    assert np.allclose([r[2:] for r in again], [r[2:] for r in whole])
    ones = BS.replicate_metrics(df.where("y = 1"), weights, "y", "p", ["model"]).collect()
    assert all(r["auprc"] == pytest.approx(1.0) and r["roc_auc"] is None for r in ones)
    zeros = BS.replicate_metrics(df.where("y = 0"), weights, "y", "p", ["model"]).collect()
    assert all(r["auprc"] is None and r["roc_auc"] is None and r["recall_at_far"] == 0.0 for r in zeros)
    assert BS.replicate_metrics(df.where("false"), weights, "y", "p", ["model"]).count() == 0


def test_long_ties_and_tiles_agree(spark, monkeypatch):
    df = frame(spark, 600, ties=True)
    weights = BS.day_weights(df.select("day").distinct(), 4, 1)
    rows = lambda: [tuple(r) for r in sorted(BS.replicate_metrics(df, weights, "y", "p", ["model"]).collect())]      # noqa: E731
    whole = rows()
    day, score, y, c = np.arange(40) % 5, np.repeat([0.5, 0.2], 20), np.arange(40) % 2, np.ones(40)
    matrix = np.arange(10).reshape(5, 2)
    total = np.stack([BS._weighted(day[y == k], c[y == k], matrix) for k in (1, 0)])
    a = BS._slot_metrics(day, score, y, c, matrix, np.zeros((2, 2)), total, 0.1)
    monkeypatch.setattr(BS, "_TILE_ROWS", 3)
    assert np.allclose(a, BS._slot_metrics(day, score, y, c, matrix, np.zeros((2, 2)), total, 0.1))
    assert len(whole) == 8
