import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers import DOCS, edge_table, lower, prose
from windrose.llm import phrases as PH


def brute(rows, min_count=30, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        longer = [x for (g, q), x in f.items() if g == lang and len(q) > len(p) and x >= min_count and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * x >= 80 * a for x in longer):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    best = []
    for lang in n:
        best += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (_, s, a, p, l, r) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1)]
    return sorted(best)


def corpus(seed):
    rng = random.Random(seed)
    some, fixed = prose(rng, 9, 60), [" ".join(prose(rng, k)) for k in (2, 3, 4, 5)] + ["É漢 🙂x", "Of The\tway"]
    rows = []
    for i in range(260):
        w = []
        for _ in range(rng.randrange(0, 70)):
            w.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(some))
            if rng.random() < 0.1:
                w[-1] += rng.choice([".", ", ", "!\n", "\r\n", "-"])
        rows.append((rng.choice(["en", "fr", None, "und"]), rng.choice([" ", "  ", " \t"]).join(w)))
    return rows + [("en", None), (None, ""), ("de", "x y " * 40), ("zz", "a")]


@pytest.mark.parametrize("room,burst", [(PH.ROOM, PH.BURST), (300, 40)])
def test_phrases_equal_brute_force(spark, monkeypatch, room, burst):
    monkeypatch.setattr(PH, "BURST", burst)
    rows = corpus(room)
    docs = spark.createDataFrame([(i, t, g, None, None) for i, (g, t) in enumerate(rows)], DOCS)
    got = sorted(tuple(r) for r in PH.collocations(docs, room=room).collect())
    assert got == brute(rows) and len(got) > 40
    assert sorted(tuple(r) for r in PH.collocations(docs, top=3, room=room).collect()) == brute(rows, top=3)


def test_trie_bursts_and_spills_sorted_runs(monkeypatch):
    monkeypatch.setattr(PH, "BURST", 50)
    rng = np.random.default_rng(1)
    trie, want, runs = PH.HatTrie(2000), Counter(), []
    for _ in range(40):
        key = np.unique(rng.integers(0, 6000, 400)).astype(np.uint64)
        path = ((key % np.uint64(7)) << np.uint64(56)) + (key % np.uint64(2) << np.uint64(40)) + (key << np.uint64(20))
        count = rng.integers(1, 9, len(key))
        trie.add(path, key // np.uint64(3), key, count)
        want.update(dict(zip(key.tolist(), count.tolist())))
        if trie.full():
            runs += list(trie.spill(1000))
            assert trie.root.size <= 1000
    assert any(isinstance(kid, PH.Node) for kid in trie.root.kids.values())
    runs += list(trie.spill(0))
    got = Counter()
    for b in runs:
        prefix, key, count = (np.asarray(b.column(c)) for c in ("prefix", "last", "count"))
        path = (key % 7) * 2.0**56 + (key % 2) * 2.0**40 + key * 2.0**20
        assert (np.diff(path) > 0).all() and (prefix == key // 3).all()
        for k, c in zip(key.tolist(), count.tolist()):
            got[k] += c
    assert got == want and len(runs) > 8 and trie.root.size == 0


def test_phrases_are_fetched_once(monkeypatch):
    rng = np.random.default_rng(2)
    once, known = PH.Once(), set()
    for _ in range(60):
        key = np.unique(rng.integers(0, 20_000, 900)).astype(np.uint64)
        assert once.first(key).tolist() == [k not in known for k in key.tolist()]
        known.update(key.tolist())
    monkeypatch.setattr(PH, "SEEN", 1000)
    once, sent = PH.Once(), set()
    for _ in range(60):
        key = np.unique(rng.integers(0, 20_000, 900)).astype(np.uint64)
        sent.update(key[once.first(key)].tolist())
    assert len(once.large) <= 1000 and len(sent) > 15_000          # what is forgotten is sent again, nothing is lost


def test_exact_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("cast(9000000000000000000 as bigint) a", "cast(9000000000000000001 as bigint) l", "cast(9100000000000000000 as bigint) r")
    wide = row.selectExpr("(cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0))) s").first().s
    assert wide == 2_000_000 * 9 * 10**18 // (9 * 10**18 + 1 + 91 * 10**17)


def test_edges(spark):
    edge = edge_table(spark)
    assert PH.collocations(edge.limit(0)).count() == 0
    got = PH.collocations(edge, min_count=2).collect()
    rows = [(r.lang, r.text) for r in edge.collect()]
    # the long text has far more phrases than the brute-force containment test can take: compare the others
    assert {r.lang for r in got} == {"en"} and all(r.n == sum(len(re.findall(r"[^ \t.,;:!?\n-\r]+", lower(t or ""))) for g, t in rows if (g or "und") == r.lang) for r in got)
    short = edge.where("doc_id is null or doc_id <> 7")
    assert sorted(tuple(r) for r in PH.collocations(short, min_count=2).collect()) == brute([(r.lang, r.text) for r in short.collect()], 2)
