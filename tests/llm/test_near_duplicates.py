import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import DOCS, components, edge_rows, edge_table, prose, words
from windrose.llm import jaccard_join, tokens
from windrose.llm import components as steps
from windrose.llm.components import components as connect


def test_word_hashes_follow_words():
    texts = [None, "", "  ", "Abc  def\tÉ x", "abc", " x y z", "a\x0bb\x0cc\rd"]
    w = tokens.words_of(pa.array(["skipped", *texts]).slice(1))
    flat = [x for t in texts for x in words(t)]
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    seen = {}
    for x, h in zip(flat, w.hash.tolist()):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def corpus(seed):
    """Prose, exact and near copies of two large groups, shared passages, short texts."""
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 60)
    for _ in range(60):
        rows.append(prose(rng, rng.randrange(1, 300)))
    for base in (prose(rng, 120), prose(rng, 40), prose(rng, 400)):
        for _ in range(80):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                w[rng.randrange(len(w))] = prose(rng, 1)[0]
            rows.append(w)
    for _ in range(40):
        rows.append(prose(rng, rng.randrange(0, 40)) + passage + prose(rng, rng.randrange(0, 30)))
    rows += [["x"] * n for n in (1, 2, 5, 6, 9)] + [["x", "y"]] * 3 + [[]] * 2
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == components(rows)


def test_edges(spark):
    df = edge_table(spark)
    got = sorted(jaccard_join.jaccard_components(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_shingles))
    assert len(got) == len(edge_rows())
    of = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert of[(5, 10)] == of[(4, 10)] == of[(None, 10)] == 4 and of[(4, 2)] == 4 and of[(8, 1)] == of[(9, 1)] == 8
    assert [of[(i, 0)] for i in (1, 2, 3, 11)] == [1, 2, 3, 11] and of[(None, 0)] is None
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 4, 6, 7, 8, 10, 11] and ids.count(None) == 1
    assert {r.text for r in kept.where("doc_id = 4").collect()} == {edge_rows()[5][1], "another text under a used id"}
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 50), (60, 60), (70, 71), (71, 72), (72, 70), (None, 5)]
    got = dict(map(tuple, connect(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 50: 40, 70: 70, 71: 70, 72: 70}


def test_settled_edges_need_no_rounds_and_steps_no_broadcasts(spark, monkeypatch):
    cuts = []
    keep = steps.cut_lineage
    monkeypatch.setattr(steps, "cut_lineage", lambda df: cuts.append(df) or keep(df))
    stars = [(1, i) for i in range(2, 20)] + [(40, 30)]
    got = dict(map(tuple, connect(spark.createDataFrame(stars, "u long, v long")).collect()))
    assert got == {i: 1 for i in range(1, 20)} | {30: 30, 40: 30} and len(cuts) == 1
    assert connect(spark.createDataFrame([], "u long, v long")).count() == 0 and len(cuts) == 2
    for large in (True, False):
        step = steps._star(spark.createDataFrame([(v, u) for u, v in stars], "u long, v long"), large)
        step.collect()
        assert "BroadcastHashJoin" not in step._jdf.queryExecution().executedPlan().toString()


def test_final_plan_of_one_row_of_each_group(spark):
    rows = [(i, " ".join(prose(random.Random(i // 2), 60))) for i in range(8)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6]
    # components are known once the rows to leave out are stored: the written plan does not derive them again
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4
