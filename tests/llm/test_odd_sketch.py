import random

import numpy as np
import pytest

from helpers import DOCS, components, edge_rows, edge_table, prose
from test_near_duplicates import corpus
from windrose.llm import odd_sketch as OS


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


@pytest.mark.parametrize("seed", [1, 5])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed)
    for base in (prose(rng, 90), prose(rng, 900)):            # copies about the threshold: some link, some do not
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 18)):
                w[rng.randrange(len(w))] = prose(rng, 1)[0]
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in OS.near_duplicates(table(spark, rows)).collect()}
    want = components(rows, 85, 3)
    assert got == want and 100 < len({c for _, c in want.values()}) < len(rows) - 150


def test_sketches_estimate_and_never_overcount():
    rng = np.random.default_rng(0)
    for n, gone in ((50, 3), (400, 30), (3000, 240), (3000, 1500)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, gone).astype(np.uint64)]))
        (ka, kb), (wa, wb) = OS.sketches([a, b])
        bits = np.unpackbits((wa ^ wb).view(np.uint8)).reshape(-1, 64).sum(1)
        sampled, whole = bits[:OS.BITS // 64].sum(), bits[OS.BITS // 64:].sum()
        unequal = len(np.setxor1d(a, b))
        assert whole <= unequal and whole % 2 == unequal % 2
        jaccard = (len(a) + len(b) - unequal) / (len(a) + len(b) + unequal)
        estimate = 1 + OS.BITS / (4 * OS.BANDS * OS.ROWS) * np.log(1 - 2 * sampled / OS.BITS)
        assert abs(estimate - jaccard) < 0.17
        assert sampled <= OS.most_bits(85) or jaccard < 0.85
        assert (ka == kb).any() or jaccard < 0.85
    assert 60 < OS.most_bits(85) < 120


def test_large_group_is_not_expanded(spark):
    """400 unlike near copies: the pairs that become rows stay in proportion to the rows."""
    rng = random.Random(2)
    base = prose(rng, 300)
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"own{i}"
        rows.append((i, " ".join(w)))
    made = []
    real = OS.stored

    def counting(df, name, **how):
        out = real(df, name, **how)
        if name in ("sketch_star", "sketch_cross"):
            made.append(out.count())
        return out

    OS.stored = counting
    try:
        got = OS.near_duplicates(table(spark, rows)).collect()
    finally:
        OS.stored = real
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1 and sum(made) < 400 * 2 * OS.BANDS < 400 * 399 / 2


def test_edges(spark):
    df = edge_table(spark)
    got = OS.near_duplicates(df).collect()
    assert len(got) == len(edge_rows())
    of = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
    assert of[(4, 12)] == (4, True) and of[(5, 12)] == (4, False) == of[(None, 12)] and of[(8, 1)] == (8, True) and of[(9, 1)] == (8, False)
    assert [of[(i, 0)] for i in (1, 2, 3, 11)] == [(i, True) for i in (1, 2, 3, 11)] and of[(None, 0)] == (None, True)
    assert OS.near_duplicates(df.limit(0)).count() == 0
