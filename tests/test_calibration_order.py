"""The order of calibrated probabilities is checked over all scores, and trees draw their inputs."""

from types import SimpleNamespace

import pytest

from windrose.models import boosting as BO
from windrose.models import calibration as CA
from windrose.plans import models as M


@pytest.mark.parametrize("slot_rows", [3, None])
def test_falls_are_counted_over_any_distance(spark, slot_rows):
    rows = [(i / 100, i / 200) for i in range(40)] + [(0.9, 0.1), (0.95, 0.5), (0.97, 0.4), (0.97, 0.6), (None, 0.0)]
    df = spark.createDataFrame(rows, "s double, c double")
    assert CA.falls(df, "s", "c", slot_rows).first()[0] == 2            # 0.9 falls, 0.97 has two values
    assert CA.falls(df.where("s < 0.9"), "s", "c", slot_rows).first()[0] == 0


def test_a_fall_between_distant_scores_is_seen(spark, sf, monkeypatch):
    rows = [(int(i % 4 == 0), 0.1 + i / 1000, 0.5) for i in range(20)] + [(1, 0.8 + i / 1000, 0.3) for i in range(20)]
    df = spark.createDataFrame([("test", *r) for r in rows], "split string, hit int, raw_probability double, bust_probability double")
    model = SimpleNamespace(score=lambda d: d, trees=SimpleNamespace(losses=[0.6, 0.5], rounds=1))
    monkeypatch.setattr(M, "planted_model", lambda *a: model)
    monkeypatch.setattr(M, "planted", lambda *a: df)
    assert M.gbt_exceedance_check(spark, sf).first()["calibrated_is_monotone"] is False


def test_the_queries_draw_the_inputs_of_a_tree():
    assert {**BO.PARAMS, **M.FAST}["columns"] == BO.PARAMS["columns"] < 1
