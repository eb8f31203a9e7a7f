"""The join's number of links counts every pair of rows that are similar enough, inside of components too."""

import random

import pytest

from helpers import DOCS, components, prose, shingles
from windrose.llm import jaccard_join


def near_copies(seed, size):
    """Two groups of near copies whose members are not all linked with each other, exact copies, prose, empty texts."""
    rng = random.Random(seed)
    rows = [prose(rng, rng.randrange(1, 200)) for _ in range(20)] + [[], ["x"], ["x"], ["x", "y"]]
    for base in (prose(rng, 120), prose(rng, 500)):
        for _ in range(size):
            w = list(base)[:rng.randrange(len(base) * 4 // 5, len(base))]
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                w[rng.randrange(len(w))] = prose(rng, 1)[0]
            rows += [w] * rng.choice((1, 1, 1, 2))
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def degrees(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    return {i: sum(bool(a) and i != j and 100 * (same := len(a & b)) >= 75 * (len(a) + len(b) - same) for j, b in sets) for i, a in sets}


@pytest.mark.parametrize("block, grams", [(512, 1 << 19), (7, 1 << 19), (512, 900)])
def test_number_of_links_equals_brute_force(spark, monkeypatch, block, grams):
    monkeypatch.setattr(jaccard_join, "BLOCK", block, raising=False)
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", grams, raising=False)
    rows = near_copies(4, 60)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(df).collect()}
    want = components(rows)
    assert got == {i: (*want[i], n) for i, n in degrees(rows).items()}
