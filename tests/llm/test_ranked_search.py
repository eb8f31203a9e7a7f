import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from helpers import DOCS, edge_rows, edge_table, lower, prose
from windrose.llm import ranked_search as RS

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, queries, k=10):
    tf = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n, length = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c in tf:
            m = 10 + 90 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(TERM.findall(lower(text or ""))) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if x else i, -s) for r, (s, x, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [RS.SHARD, 300])
def test_search_equals_brute_force(spark, monkeypatch, shard):
    rng = random.Random(4)
    common, rare = prose(rng, 12, 40), prose(rng, 400)
    docs = []
    for i in range(700):
        w = [rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randrange(0, 60))]
        docs.append((i if i % 97 else None, rng.choice([" ", ", ", "-"]).join(w)))
    docs += [(900 + i, docs[5][1]) for i in range(15)] + [(5, docs[5][1]), (None, docs[5][1])]          # ties, repeated rows
    queries = [(q, " ".join(rng.choice(common) for _ in range(3)) + " " + " ".join(rng.choice(rare) for _ in range(rng.randrange(0, 12)))) for q in range(25)]
    queries += [(100, docs[5][1]), (101, ""), (102, None), (103, "nowheretobefound"), (None, rare[3])]
    posts = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    monkeypatch.setattr(RS, "SHARD", shard)
    monkeypatch.setattr(RS, "QUERY_TERMS", 60)                                                          # several blocks
    got = RS.search(posts, spark.createDataFrame(queries, "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, queries)


def test_survivors_are_updated_exactly_and_few_terms_create():
    """Two rare terms decide; the common ones come too late for a document without an accumulator, yet count for those with one."""
    docs = np.array([0, 1, 0, 1, 2, 3, 0, 1, 2, 3, 4, 5])
    at, impact = np.array([0, 2, 6, 12]), np.full(12, 10)
    acc = np.zeros(6, np.int64)
    created = RS.search_shard(docs, impact, at, np.full(3, 10), np.array([0, 1, 2]), np.array([9, 2, 1]), acc, 2, 1)
    assert created == 1 and acc.tolist() == [120, 120, 0, 0, 0, 0]
    acc[:] = 0
    assert RS.search_shard(docs, impact, at, np.full(3, 10), np.array([0, 1, 2]), np.array([9, 2, 1]), acc, 2, 121) == 0 and not acc.any()


def test_weights_do_not_depend_on_rounding_of_logarithms():
    # the logarithm of a fraction of an even over an odd number is never within 1e-9 of a multiple of 1/1000 for these counts
    for n in (1000, 256_410):
        for d in range(1, n, 37):
            x = 1000 * math.log(Fraction(2 * n + 2, 2 * d + 1))
            assert abs(x - round(x)) > 1e-9


def test_edges(spark):
    edge = edge_table(spark)
    queries = spark.createDataFrame([(1, edge_rows()[1][1]), (1, edge_rows()[1][1]), (1, "É漢🙂"), (2, "a"), (3, "w17")], "item_id long, text string")
    want = brute([(r[0], r[1]) for r in edge_rows()], [(1, edge_rows()[1][1]), (1, "É漢🙂"), (2, "a"), (3, "w17")])
    got = RS.search(edge, queries.selectExpr("*", "1 as score", "2 as rank", "3 as query")).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    none = RS.search(edge.limit(0), queries)
    assert none.count() == 0 == RS.search(edge, queries.limit(0)).count() and none.columns == ["item_id", "rank", "doc_id", "score"]
