"""Substring dedup, archives, language-model scores, the pipeline."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

import corpus_pipeline
from helpers import DOCS, components, edge_rows, edge_table, prose, words
from windrose.llm import decontaminate, jaccard_join, lm_score, pii, substring_dedup, toxicity, unigram, warc
from windrose.llm.queries import PIECES, RUNS, SQL
from windrose.llm.tokens import buffers


def test_gear_hash_and_chunks():
    rng = random.Random(1)
    texts = [" ".join(prose(rng, 200)) + "é漢" * 40, "", "ab", "x" * 1000]
    data, at = buffers(pa.array(texts))
    h = substring_dedup.gear_hash(data, at)
    for r, t in enumerate(texts):
        x = 0
        for i, c in enumerate(t.encode()):
            x = ((x << 1) + int(substring_dedup.GEAR[c])) & 0xFFFF
            assert h[at[r] + i] == x
    row, start, end = substring_dedup.chunks(data, at)
    assert start[0] == 0 and end[-1] == len(data) and (end[:-1] == start[1:]).all() and ((end - start) <= substring_dedup.MAX + 3).all()
    assert all(data[s:e].tobytes().decode() is not None for s, e in zip(start, end))
    # an insertion moves only the cuts near it
    moved = texts[0][:500] + "inserted" + texts[0][500:]
    a = {data[s:e].tobytes() for r, s, e in zip(row, start, end) if r == 0}
    d2, at2 = buffers(pa.array([moved]))
    b = {d2[s:e].tobytes() for _, s, e in zip(*substring_dedup.chunks(d2, at2))}
    assert len(a - b) <= 4


def test_repeated_passages_are_found(spark):
    rng = random.Random(4)
    passages = [prose(rng, 55) for _ in range(12)]
    rows, having = [], collections.defaultdict(list)
    for d in range(300):
        w = prose(rng, rng.randrange(20, 200))
        if d % 3 == 0:
            p = rng.randrange(12)
            at = rng.randrange(len(w))
            w[at:at] = passages[p]
            having[p].append(d)
        rows.append((d, " ".join(w), None, None, None))
    docs = spark.createDataFrame(rows, DOCS)
    every = substring_dedup.repeats(docs).collect()
    got = [r for r in every if not r.is_first]
    assert {r.doc_id for r in every if r.is_first} == {ds[0] for ds in having.values() if len(ds) > 1}
    dirty = {d for ds in having.values() for d in ds}
    assert {r.doc_id for r in got} == {d for ds in having.values() for d in ds[1:]}
    assert all(r.copy_of in dirty and r.copy_of < r.doc_id for r in got)
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    for d, text, *_ in rows:
        assert (cut[d] == text) == (d not in {r.doc_id for r in got})
        assert set(cut[d].split()) - set(text.split()) == set() or d in dirty
    whole = spark.createDataFrame([(9, rows[0][1], None, None, None), (3, rows[0][1], None, None, None), (3, rows[0][1], None, None, None)], DOCS)
    n = len(rows[0][1].encode())
    assert sorted((r.doc_id, r.start_byte, r.end_byte, r.copy_of, r.is_first) for r in substring_dedup.repeats(whole).collect()) == [(3, 0, n, 3, True), (9, 0, n, 3, False)]
    # the same over many small batches: runs of equal digests cross batch ends
    key = lambda r: (r.doc_id, r.start_byte, r.end_byte, r.is_first)      # noqa: E731
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        small = substring_dedup.repeats(docs.repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(key, small)) == sorted(map(key, every))


def test_repeats_edges(spark):
    edge = edge_table(spark)
    got = substring_dedup.repeats(edge, min_words=5).collect()
    assert {r.doc_id for r in got} >= {5} and not {r.doc_id for r in got} & {None, 1, 2, 3, 6}
    assert substring_dedup.repeats(edge.limit(0)).count() == 0
    assert substring_dedup.without_repeats(edge).columns == edge.columns


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("pages", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_archives_equal_sql(spark, sf, con):
    df = RUNS["op5_warc"](spark, sf)
    want = con.execute(SQL["op5_warc"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_archives_round_trip(spark):
    rows = [(5, "http://a", "<p>same</p>"), (3, "http://b\r\nX: y", "<p>same</p>"), (9, None, "<p>same</p>"), (None, "u", "<p>same</p>"), (4, "u", None), (2, "u", ""),
            (7, "u", "é漢" * 5000), (8, "u", "b"), (8, "u", "b")] + [(100 + i, "u", f"<html>{i % 50} common words of a page {i % 50}</html>" * 20) for i in range(200)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    archives = warc.write(pages, archive_bytes=40_000)
    listed = archives.collect()
    assert sum(r.n_records for r in listed) == len(rows) and len(listed) > 3
    for r in listed:
        data = open(r.path.removeprefix("file:"), "rb").read()
        assert len(data) == r.n_bytes and data[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(data[4:8], "little")
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
        assert d.decompress(data[8 + size:], read_across_frames=False).startswith(b"WARC/1.1\r\n") if len(data) > 8 + size else True
    got = warc.read(archives).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = [(i, len((h or "").encode()), warc.digest_of((h or "").encode()), *(("revisit", first[h or ""]) if i is not None and i > first[h or ""] else ("response", None))) for i, _, h in rows]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    small = [r for r in warc.read(warc.write(pages, min_bytes=100)).collect() if r.payload_bytes < 100]
    assert {r.record_type for r in small} == {"response"}


def brute_scores(rows):
    """Deleted interpolation without batches or fragments."""
    end, start = "\0end", "\0start"
    part = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 for i, _ in rows}
    text = [(i, words(t) + [end]) for i, t in rows]

    def count(keep):
        one, two = collections.Counter(), collections.Counter()
        ctx = collections.Counter()
        for i, w in text:
            if keep(part[i]):
                one.update(w), two.update(zip([start] + w, w)), ctx.update([start] + w[:-1])
        return one, two, ctx

    def estimate(one, two, ctx, h, w):
        c = ctx[h] if h == start else one[h]
        return c.bit_length(), two[h, w] / c if c else 0.0, one[w] / max(1, sum_of[id(one)])

    every, kept = count(lambda p: p != 2), count(lambda p: p not in (2, 6))
    sum_of = {id(every[0]): sum(every[0].values()), id(kept[0]): sum(kept[0].values())}
    steps = collections.Counter()
    for i, w in text:
        if part[i] == 6:
            for h, x in zip([start] + w, w):
                b, two, one = estimate(*kept, h, x)
                octave = lambda p: 2.0 ** (round(8 * math.log2(p)) / 8) if p > 0 else 0.0      # noqa: E731
                steps[b, octave(two), octave(one)] += 1
    k = np.array(list(steps), float).reshape(-1, 3)
    weights = lm_score.learn_weights(k[:, 0].astype(int), k[:, 1], k[:, 2], 1 / (len(kept[0]) + 1), np.array(list(steps.values()), float))
    n, v = sum_of[id(every[0])], len(every[0])
    out = []
    for i, w in text:
        score = 0.0
        for h, x in zip([start] + w, w):
            b, two, one = estimate(*every, h, x)
            l2, l1, l0 = weights[:, min(b, weights.shape[1] - 1)]
            if b == 0:
                l2, l1, l0 = 0, l1 / (l1 + l0), l0 / (l1 + l0)
            score += math.log10(l2 * two + l1 * one + l0 / (v + 1))
        out.append((i, part[i] == 2, len(w), sum(every[0][x] > 0 for x in w), n, sum(math.log10((every[0][x] + 1) / (n + v + 1)) for x in w), score))
    return out


def same(got, want):
    key = lambda r: tuple(str(x) for x in r[:5])      # noqa: E731
    order = lambda r: (key(r), round(r[5], 6), r[6])      # noqa: E731
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [key(r) for r in got] == [key(r) for r in want]
    for a, b in zip(got, want):
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-6), (a, b)


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_CHARS", 4000)
    monkeypatch.setattr(lm_score, "FRAGMENT_CHARS", 9000)
    rng = random.Random(6)
    rows = [(i, " ".join(prose(rng, rng.randrange(0, 60), 40))) for i in range(400)] + [(1000, None), (1001, ""), (1002, " \n"), (None, "a b")]
    rows += [(None, " ".join(prose(rng, rng.randrange(0, 60), 40))) for _ in range(150)] + [(7, " ".join(prose(rng, 30, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    same(lm_score.scores(docs).collect(), brute_scores(rows))
    held = [r for r in lm_score.scores(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_counts_beyond_31_bits():
    b = lm_score.Batch(pa.array(["x"]))
    n = [2_000_000_000] * len(b.words)
    asked = pa.table([pa.array([0, 1, 2]), pa.array([1, 1, 1], pa.int32()), pa.array([0, 0, 0]), pa.array([b.words.view(np.int64).tolist()] * 3, pa.list_(pa.int64())),
                      pa.array([n, n, [5] * len(n)], pa.list_(pa.int32()))], names=["batch", "part", "frag", "gram", "n"])
    answer = lm_score._answer((2, 1, 1))(asked)
    for batch, kind in ((0, lm_score.RETAINED), (2, lm_score.DELETED)):
        (r, d), _ = lm_score._known(b, kind, answer.filter(pa.compute.equal(answer.column("batch"), batch)), 1)
        assert r.tolist() == [4_000_000_000] * len(n) and d.tolist() == [5] * len(n)


def test_scores_edges(spark):
    edge = edge_table(spark)
    got = lm_score.scores(edge).collect()
    assert len(got) == len(edge_rows()) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lm_score.scores(edge.limit(0)).count() == 0
    few = spark.createDataFrame([(2, "a b", None, None, None)], DOCS)
    assert len(lm_score.scores(few).collect()) == 1


def test_pipeline_stages(spark, sf):
    """Each stage against a plain version of its decision on the same input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "personal_data", "sentencepiece"]
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert docs.columns == before.columns
        old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, docs))
        if name == "toxicity":
            assert set(new) == {r.doc_id for r in toxicity.toxicity(before, labels).where("score < 0.3").collect()}
        elif name == "ngram_jaccard_join":
            assert set(new) == {c for _, c in components(sorted(old.items())).values()}
        elif name == "benchmark_decontamination":
            assert set(old) - set(new) == {r.doc_id for r in decontaminate.overlaps(before, bench).collect()} and len(set(old) - set(new)) > 0
        else:
            assert set(old) == set(new) and any(old[i] != new[i] for i in old)
            assert all("@" not in new[i] or not pii.spans_of(new[i])[1] for i in new)
        rows = new
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id: r.n_tokens for r in last.collect()} == dict(zip(rows, unigram.encode_batch(pa.array(list(rows.values())), unigram.load(PIECES))[1].tolist()))


def test_pipeline_takes_edge_rows(spark, sf):
    docs = edge_table(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = corpus_pipeline.stored(stage(spark, d, sf), name)
        assert corpus_pipeline.STAGES[-1][1](spark, d, sf).count() == d.count()


def test_every_operator_is_registered():
    assert {k.split("_")[0] for k in RUNS} == {f"op{i}" for i in range(1, 14)} and set(SQL) <= set(RUNS)
    assert jaccard_join.RARE > 1


def test_first_occurrence_may_hold_an_earlier_chunk(spark):
    w = prose(random.Random(8), 44)
    passage = " ".join(w)
    data, at = buffers(pa.array([passage]))
    _, start, end = substring_dedup.chunks(data, at)
    m = len(start) // 2
    rows = [(1, passage[max(0, start[m] - 20):end[m]], None, None, None)] + [(d, f"own{d} " * 9 + passage + f" end{d}" * 9, None, None, None) for d in (2, 3)]
    got = collections.defaultdict(list)
    for r in substring_dedup.repeats(spark.createDataFrame(rows, DOCS)).collect():
        got[r.doc_id].append((r.start_byte, r.end_byte, r.n_words, r.is_first))
    assert {x[3] for x in got[2]} == {True} and max(x[2] for x in got[2]) < 25 <= sum(x[2] for x in got[2])
    assert {x[3] for x in got[3]} == {False} and len(got[3]) == 1
