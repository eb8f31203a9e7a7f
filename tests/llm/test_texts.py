"""Personal data, toxicity, quality rules, decontamination."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import CLASHES, DOCS, edge_rows, edge_table, prose, words
from windrose.llm import decontaminate, pii, quality, toxicity

# the contract's patterns, applied as they stand
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in pii.CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.@+-() aé%_", max_size=60) | st.lists(st.sampled_from(["4929583550668540", "+1 (486) 555-3667", "a.b@c.de", "@x.y", "1.2.3.4", "256.1.1.1", "9.9.9.9.9.9.9.9", " ", "-", ".", "7"]), max_size=12).map("".join))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_added_spans():
    def kinds(t):
        base, every = pii.spans_of(t)
        return [pii.KINDS[k] for _, k, _ in every if (_, k) not in [(s, b) for s, b, _ in base]]

    assert "iban" in kinds("pay to DE89 3704 0044 0532 0130 00 now") and "iban" not in kinds("pay to DE88 3704 0044 0532 0130 00 now")
    assert kinds("call me: 212-555-0199") == ["national"] and kinds("order 212-555-0199") == [] == kinds("see 212-555-0199")
    assert kinds("my SSN is 123-45-6789") == ["ssn"] and kinds("id 123-45-6789") == []
    assert pii.masked("a x@y.zz b", pii.spans_of("a x@y.zz b")[1]) == "a <EMAIL> b"
    assert len(pii.spans_of("1" * 200_000 + "a" * 200_000 + "@" + ".")[0]) == 0       # linear on long runs


def test_personal_data_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for r in docs.collect():
        base, g = brute_spans(r.text or ""), got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(g.spans.split(","))
    edge = edge_table(spark)
    assert pii.find(edge).count() == len(edge_rows()) and pii.redact(edge).schema == edge.schema
    assert sorted(map(str, pii.redact(edge).collect())) == sorted(map(str, edge.collect()))
    assert pii.find(edge.limit(0)).count() == 0


def test_toxicity_is_learned_and_located(spark):
    rng = random.Random(3)
    bad = ["vexword", "grimterm", "foulname"]
    rows, labels, where = [], [], {}
    for i in range(900):
        sentences = [" ".join(prose(rng, rng.randrange(3, 12), 300)) + "." for _ in range(rng.randrange(1, 40))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = f"so {rng.choice(bad)}{rng.choice(['', 'ed', 'ing'])} " + sentences[at]
            where[i] = (sum(len(s) + 1 for s in sentences[:at]), sentences[at])
        rows.append((i, " ".join(sentences), "en", "s", None))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels + [(5, 0, None), (None, 1, 1), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    held = [r for r in out.values() if r.held_out]
    assert 100 < len(held) and sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    found = [r for r in held if r.doc_id in where and r.predicted]
    assert sum((r.worst_start, rows[r.doc_id][1][r.worst_start:r.worst_end]) == where[r.doc_id] for r in found) >= 0.95 * len(found)
    kept = toxicity.keep_clean(docs, lab)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.score < 0.3}


def test_toxicity_edges(spark):
    edge = edge_table(spark)
    for rows in ([], [(1, 1, 1)], [(4, 1, 1), (7, 1, 0), (9, 0, 0)]):
        lab = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        out = toxicity.toxicity(edge, lab).collect()
        assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 for r in out)
        assert all(r.score == 0 for r in out if r.doc_id in (1, 2, 3, 11))
    assert toxicity.toxicity(edge.limit(0), lab).count() == 0
    assert toxicity.keep_clean(edge, lab).columns == edge.columns


def test_held_out_labels_are_never_read(spark):
    """With a bound under the class counts no held-out label may take a place in the sample or move a class weight."""
    rng = random.Random(12)
    rows = [(i, " ".join(prose(rng, 30, 200)) + (" vexword here." if i % 3 == 0 else "."), "en", "s", None) for i in range(240)]
    docs = spark.createDataFrame(rows, DOCS)
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    lab = [(i, int(i % 3 == 0)) for i in range(240)]
    runs = []
    for flip in (0, 1):
        y = spark.createDataFrame([(i, t ^ flip if i in held else t) for i, t in lab], "doc_id long, toxic int")
        runs.append(({r.doc_id: r.score for r in toxicity.toxicity(docs, y, max_rows=40).collect()},
                     {r.doc_id for r in toxicity.keep_clean(docs, y, max_rows=40).collect()}))
    assert len(held) > 30 and runs[0] == runs[1] and len(set(runs[0][0].values())) > 1


def brute_quality(text):
    text = text or ""
    w = words(text, False)
    lines = [x for x in text.split("\n") if words(x)]
    c = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
    covered = {i for j in range(len(w) - 7) if c[tuple(w[j:j + 8])] > 1 for i in range(j, j + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_equals_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = edge_table(spark).drop(*CLASHES).where("doc_id is null or doc_id <> 4").withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["x"]).col("doc_id") + 10**6)
    docs = docs.select(*(c for c in odd.columns)).union(odd)
    rows = docs.collect()
    vocabulary = sorted({x for r in rows for x in words(r.text, False)})
    h = {r.w: r.h for r in spark.createDataFrame([(x,) for x in vocabulary], "w string").selectExpr("w", "xxhash64(w) h").collect()}
    pairs = sorted({(h[a], h[b]) for r in rows for w in [words(r.text, False)] for a, b in zip(w, w[1:])})
    h2 = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").selectExpr("a", "b", "xxhash64(a, b) h").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    grams, raw, target = {}, Counter(), Counter()
    for at, r in enumerate(rows):
        w = [h[x] for x in words(r.text, False)]
        grams[at] = [x % quality.BUCKETS for x in w + [h2[p] for p in zip(w, w[1:])]]
        raw.update(grams[at])
        if r.doc_id in good:
            target.update(grams[at])
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: round(1e6 * math.log((target[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR))) for b in raw}
    want = []
    for at, r in enumerate(rows):
        base = brute_quality(r.text)
        score = sum(ratio[b] for b in grams[at]) / len(grams[at]) / 1e6 if grams[at] else None
        want.append((r.doc_id, *base, not base[5] and score >= quality.THRESHOLD))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.quality(docs, labels).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    edge = edge_table(spark)
    assert quality.quality(edge, labels.limit(0)).count() == len(edge_rows()) and quality.quality(edge.limit(0), labels).count() == 0


def test_quality_counts_every_trusted_text(spark):
    n = 24_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id % 40) as text")
    docs = docs.union(spark.createDataFrame([(None, "w1"), (0, "w0")], "doc_id long, text string"))
    trusted = spark.range(n).where("id % 40 < 38 or id < 400").selectExpr("id as doc_id")
    bucket = {r.w: r.b for r in docs.selectExpr("text w", "pmod(xxhash64(text), 16384) b").distinct().collect()}
    raw, target = Counter(), Counter()
    for i in [*range(n), None, 0]:
        b = bucket[f"w{(1 if i is None else i) % 40}"]
        raw[b] += 1
        target[b] += i is not None and (i % 40 < 38 or i < 400)
    share = sum(target.values()) / sum(raw.values())
    want = [round(1e6 * math.log((target[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR))) for b in range(quality.BUCKETS)]
    for cells in (quality.CELLS, 5_000, 1):          # a small filter leaves more rows to the exact join
        assert quality.ratios(docs, trusted, cells=cells) == want


def test_quality_runs_without_python(spark, sf):
    plan = quality.rated(spark.read.parquet(f"{sf}/documents.parquet"), [0, 1])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_repeated_windows_cover_overlaps(spark):
    block = [f"b{i}" for i in range(10)]
    texts = [" ".join(block + ["x"] + block), " ".join(["z"] * 30), " ".join(block[:8] * 2), " ".join(block[:7] * 2 + ["q"])]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.n_repeat_words for r in quality.rated(df, [0]).collect()}
    assert got == {i: brute_quality(t)[4] for i, t in enumerate(texts)} and got[1] == 30 and got[0] == 20


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(9)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate([60, 30, 20, 15, 6, 3, 0])] + [(7, None)]
    rows, want = [], set()
    for d in range(200):
        w = prose(rng, rng.randrange(5, 200))
        if d % 4 == 0:
            i = rng.randrange(6)
            p = items[i][1].split()
            if d % 8 == 0 and len(p) >= 30:
                for at in range(4, len(p), 9):      # every ninth word replaced
                    p[at] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = p
            want.add((d, i))
        elif d % 4 == 1:                             # a few words of an item are no leak
            w[3:3] = items[0][1].split()[10:17]
        rows.append((d, " ".join(w).upper() if d % 3 else " ".join(w), "en", None, None))
    docs = spark.createDataFrame(rows + edge_rows()[:4], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id != 1} == want
    for r in got:
        assert r.n_match <= r.n_aligned <= r.n_item
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows + edge_rows()[:4]} - {d for d, i in want if len(words(items[i][1])) >= decontaminate.FLOOR}
    edge = edge_table(spark)
    assert decontaminate.overlaps(edge, bench.limit(0)).count() == 0 == decontaminate.overlaps(edge.limit(0), bench).count()
    own = decontaminate.overlaps(edge, spark.createDataFrame([(1, edge_rows()[1][1])], "item_id long, text string")).collect()
    assert {str(r.doc_id) for r in own} == {"4", "5", "None"}
    # null and shared ids of texts and items neither save nor lose a text
    leak = edge_rows()[1][1]
    bench = spark.createDataFrame([(None, leak), (3, "unlike item of six other words"), (3, "Zwei drei vier, acht neun zehn elf")], "item_id long, text string")
    more = docs.limit(0).union(spark.createDataFrame([(20, "x zwei drei vier acht neun zehn elf y", None, None, None), (4, "a clean row", None, None, None)], DOCS))
    kept = decontaminate.clean(edge.drop(*CLASHES).union(more), bench).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(
        (str(r[0]), r[1]) for r in [*edge_rows(), (4, "a clean row")] if r[1] != leak)
    assert decontaminate.clean(edge, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == len(edge_rows())


def test_decontamination_misses_no_diagonal(spark):
    rng = random.Random(31)
    items = [prose(rng, n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 40, 59)]
    rows = []
    for p in items:
        for how in [*range(2, 11), 0.1, 0.2, 0.3, 0.3, 0.35]:
            w = list(p)
            off = rng.randrange(how) if how > 1 else 0
            for at in range(len(w)):
                if (at % how == off) if how > 1 else rng.random() < how:
                    w[at] = "changed"
            rows.append((len(rows), " ".join(prose(rng, rng.randrange(9)) + w + prose(rng, rng.randrange(9))), None, None, None))
    want = set()
    for d, t, *_ in rows:
        x = words(t)
        for i, p in enumerate(items):
            n = 0
            for a in range(-len(p) + 1, len(x)):
                lo, hi = max(0, -a), min(len(p), len(x) - a)
                n = max(n, decontaminate.best_stretch(np.array([p[j] == x[j + a] for j in range(lo, hi)]))[2])
            if n >= min(12, math.ceil(0.75 * len(p))):
                want.add((d, i, n))
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_match) for r in decontaminate.overlaps(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got == want and any(d % 14 == 3 for d, _, _ in want)          # every fifth word replaced
