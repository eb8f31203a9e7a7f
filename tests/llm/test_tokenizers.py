import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import edge_rows, edge_table
from windrose.llm import token_counts, unigram

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    return unigram.load(MODEL)


def small_vocabulary():
    """Scores with many ties, a piece with a marker inside runs, byte pieces."""
    entries = [("<unk>", 0.0, "other")] + [(f"<0x{i:02X}>", -9.0, "byte") for i in range(256)]
    entries += [(p, s, "normal") for p, s in [("▁", -2.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -3.0), ("aba", -6.0), ("▁a", -4.0), ("▁▁", -3.0), ("abab", -7.0), ("é", -1.0)]]
    return entries


def brute(text, entries):
    """(ids, score): the plain left-to-right search over the whole text."""
    if not text:
        return [], 0.0
    s = "▁" + text.replace(" ", "▁")
    pieces = {p: (i, x) for i, (p, x, kind) in enumerate(entries) if kind == "normal"}
    bytes_ = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(entries) if kind == "byte"}
    unknown = min(x for p, x in [(p, x) for p, x, kind in entries if kind == "normal"]) - 10
    best: list = [(0.0, None, None)] + [None] * len(s)
    for a in range(len(s)):
        found = False
        for b in range(a + 1, min(len(s), a + 16) + 1):
            if s[a:b] in pieces:
                found |= b == a + 1
                c = best[a][0] + pieces[s[a:b]][1]
                if best[b] is None or c > best[b][0]:
                    best[b] = (c, a, [pieces[s[a:b]][0]])
        if not found and (best[a + 1] is None or best[a][0] + unknown > best[a + 1][0]):
            best[a + 1] = (best[a][0] + unknown, a, [bytes_[x] for x in s[a].encode()])
    out, at = [], len(s)
    while at:
        out = best[at][2] + out
        at = best[at][1]
    return out, best[-1][0]


def rows_of(texts, v):
    flat, count = unigram.encode_batch(pa.array(texts, pa.string()), v)
    cut = np.cumsum(count)[:-1]
    return [x.tolist() for x in np.split(flat, cut)], flat, count


def test_ties_and_bytes_equal_brute_force():
    rng = random.Random(5)
    entries = small_vocabulary()
    v = unigram.vocabulary(entries)
    texts = ["".join(rng.choice("aabb  é漢\n") for _ in range(rng.randrange(0, 25))) for _ in range(400)] + ["", " ", "a" * 500]
    got, flat, count = rows_of(texts, v)
    want = [brute(t, entries) for t in texts]
    assert got == [w[0] for w in want]
    assert unigram.decode_batch(flat, count, v).to_pylist() == texts
    seg = unigram.segments(pa.array(texts), v)
    n, s = token_counts.count_segments(seg, v)
    assert np.bincount(seg.row, n[seg.which], len(texts)).astype(int).tolist() == [len(w[0]) for w in want]
    assert np.allclose(np.bincount(seg.row, s[seg.which], len(texts)), [w[1] for w in want])


def test_equals_the_library(model):
    """As a unigram model with its lowest scores lifted: beyond 2**24 the library's single-precision sums are not exact."""
    sp, pb = pytest.importorskip("sentencepiece"), pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1 and p.score < -1e8:
            p.score = -40000
    lib = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    kinds = {1: "normal", 6: "byte"}
    v = unigram.vocabulary([(p.piece, p.score, kinds.get(p.type, "other")) for p in proto.pieces])
    rng = random.Random(2)
    texts = ["Hello world", "  two  spaces ", "naïve café", "tab\there", "漢字", "x\ny", "🙂 ok"]
    texts += ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    assert rows_of(texts, v)[0] == [lib.encode(t) for t in texts]
    ids = [lib.encode(t) for t in texts[:7]]
    assert unigram.decode_batch(np.concatenate(ids), np.array([len(i) for i in ids]), v).to_pylist() == [lib.decode(i) for i in ids]


def test_whole_table(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    enc = unigram.encode(docs, model).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in enc) and len(enc) == docs.count()
    n = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, model).collect()}
    assert n == {r.doc_id: r.n_tokens for r in enc}


def test_edges(spark, model):
    df = edge_table(spark)
    enc = unigram.encode(df, model)
    rows = enc.collect()
    assert len(rows) == len(edge_rows()) and all(r.round_trip for r in rows)
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0]
    texts = sorted(t or "" for _, t, *_ in edge_rows())
    assert sorted(r.text for r in unigram.decode(enc, model).collect()) == texts
    odd = spark.createDataFrame([(1, None), (2, [5, -7, 10**6, 0, 1]), (3, [3 + 0xC3])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in unigram.decode(odd, model).collect()} == {1: None, 2: "\x02", 3: "�"}
    assert sorted(r.n_tokens for r in token_counts.token_counts(df, model).collect()) == sorted(r.n_tokens for r in rows)
    assert unigram.encode(df.limit(0), model).count() == 0 == token_counts.token_counts(df.limit(0), model).count()
