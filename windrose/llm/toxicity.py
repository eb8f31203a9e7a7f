"""Toxicity by multiple-instance learning: only texts are labelled, sentences are scored.

A sentence's probability is the sigmoid of the summed weights of its words (whole word and its first bytes, hashed); a text's is
the noisy-or of its sentences, ``1 - prod(1 - p)``.  The weights are fitted to the labels of texts through the noisy-or, so the
offending sentences of a text need no labels and are the ones with high probability.

The classifier is fitted on a sample bounded by ``max_rows`` per class (those with the smallest hash of doc_id), reweighted to the
class counts of all labelled rows whose crc32(doc_id) mod 4 is not 2, in one task; the bound keeps it small at every size.  Scoring is one pass over all texts with the
weights (``2**BITS`` floats) broadcast.

Defined cases: a text without words has no sentence and scores 0.  Several labels of a doc_id count as the largest; labels without a
doc_id, without a value or without a text are left out.  Without labels of both classes every weight is zero and every score that of
the base rate (0 without any label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import crc_part, mix, pieces, salt
from windrose.llm.tokens import BYTE, powers, words_of

BITS = 20
SIGNAL = 4.0           # standard errors by which a feature's share of toxic texts must exceed that of the others
PREFIXES = (4, 5, 6)
ENDS = np.isin(np.arange(256), list(b".!?"))
TRAIL = np.isin(np.arange(256), list(b".!?,;:\"')"))


def parsed(text: pa.Array):
    """Words of a batch; a hash per word (final punctuation off) and per prefix; the first word of each sentence; sentences' rows."""
    w = words_of(text)
    n = len(w.hash)
    if not n:
        return w, np.zeros((1 + len(PREFIXES), 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = w.end.copy()
    for _ in range(3):
        end -= TRAIL[w.data[end - 1]] & (end - 1 > w.start)
    power, inverse = powers(len(w.data))
    total = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum(BYTE[w.data] * power[:len(w.data)], out=total[1:])
    keys = np.empty((1 + len(PREFIXES), n), np.uint64)
    for k, stop in enumerate([end] + [np.minimum(w.start + p, end) for p in PREFIXES]):
        keys[k] = mix((total[stop] - total[w.start]) * inverse[w.start] + salt(k + 1))
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    lines = np.concatenate(([0], np.cumsum(w.data == 10)))
    fresh = np.ones(n, bool)
    fresh[1:] = (row[1:] != row[:-1]) | ENDS[w.data[w.end[:-1] - 1]] | (lines[w.start[1:]] != lines[w.end[:-1]])
    first = np.flatnonzero(fresh)
    return w, keys, first, row[first]


def features(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BITS)).astype(np.int32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_weights(vocabulary: np.ndarray, token: np.ndarray, sentence: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray,
                chosen: np.ndarray, rounds: int = 120, rate: float = 0.15, shrink: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and offset by Adam steps on the likelihood of the labels under the noisy-or.

    vocabulary: (features, distinct words) ids; token: distinct word of each word; sentence: first word of each sentence; doc: first
    sentence of each text; label and weight of each text; chosen: which features may get a weight.
    """
    kept, dense = np.unique(np.where(chosen[vocabulary], vocabulary, -1), return_inverse=True)
    dense = dense.reshape(vocabulary.shape)
    free = kept >= 0
    w, b, m, v, mb, vb = np.zeros(len(kept)), -5.0, np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    size = np.diff(np.append(sentence, len(token)))
    many = np.diff(np.append(doc, len(sentence)))
    total = weight.sum()
    for t in range(1, rounds + 1):
        z = np.add.reduceat(w[dense].sum(0)[token], sentence) + b
        p = sigmoid(z)
        none = np.add.reduceat(-np.logaddexp(0, np.clip(z, -40, 40)), doc)       # log prod(1 - p)
        pull = np.where(label == 1, -np.exp(none) / np.maximum(-np.expm1(none), 1e-12), 1.0) * weight / total
        g = p * np.repeat(pull, many)
        gu = np.bincount(token, np.repeat(g, size), dense.shape[1])
        gw = sum(np.bincount(f, gu, len(w)) for f in dense) * free + shrink * w
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step, fix1, fix2 = rate * (1 - 0.9 * t / rounds), 1 - 0.9**t, 1 - 0.99**t
        w -= step * (m / fix1) / (np.sqrt(v / fix2) + 1e-7)
        b -= step * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-7)
    out = np.zeros(1 << BITS)
    out[kept[free]] = w[free]
    return out, b


def _fit(batches):
    ids, keys, sizes, many, label, weight = [], [], [], [], [], []
    texts, having = np.zeros(2), np.zeros((2, 1 << BITS))
    for b in pieces(batches):
        w, k, first, row = parsed(b.column("text"))
        has = np.flatnonzero(np.diff(w.first) > 0)
        u, where, back = np.unique(k[0], return_index=True, return_inverse=True)
        keys.append(np.vstack([u[None], features(k[:, where]).astype(np.uint64)])), ids.append(u[back])
        sizes.append(np.diff(np.append(first, len(w.hash))))
        many.append(np.bincount(row, minlength=len(w.first) - 1)[has])
        y = np.asarray(b.column("label"))
        label.append(y[has]), weight.append(np.asarray(b.column("weight"))[has])
        row_of = np.repeat(np.arange(len(y)), np.diff(w.first))
        pair = np.unique((row_of[None] << BITS) + features(k))
        for c in (0, 1):
            texts[c] += (y == c).sum()
            having[c] += np.bincount(pair[y[pair >> BITS] == c] & ((1 << BITS) - 1), minlength=1 << BITS)
    out, offset = np.zeros(1 << BITS), -40.0
    if label and sum(map(len, label)):
        y, c = np.concatenate(label), np.concatenate(weight)
        if 0 < y.sum() < len(y):
            word, where = np.unique(np.concatenate([k[0] for k in keys]), return_index=True)
            vocabulary = np.concatenate([k[1:] for k in keys], axis=1)[:, where].astype(np.int32)
            token = np.searchsorted(word, np.concatenate(ids)).astype(np.int32)
            s, d = np.concatenate(sizes), np.concatenate(many)
            share, both = having / texts[:, None], having.sum(0) / texts.sum()
            error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / texts).sum())
            chosen = (share[1] - share[0] > SIGNAL * error) & (having[1] >= 2)
            out, offset = fit_weights(vocabulary, token, np.cumsum(s) - s, np.cumsum(d) - d, y, c, chosen)
        else:
            offset = 40.0 if y.sum() else -40.0
    yield pa.RecordBatch.from_arrays([pa.array([offset]), pa.array([out.astype(np.float32).tobytes()])], ["offset", "weights"])


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and offset from the (text, label, weight) rows of a bounded sample."""
    labelled = labelled.where("text is not null")
    got = labelled.repartition(1).mapInArrow(_fit, "offset double, weights binary").first()
    if got is None:            # no row at all
        return np.zeros(1 << BITS, np.float32), -40.0
    return np.frombuffer(got[1], np.float32), float(got[0])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = 6000) -> DataFrame:
    """(text, label, weight): the bounded sample of the rows that may be learned from, weighted to their class counts.

    Labels of held-out rows take no part: neither in the sample nor in the counts.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    y = y.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_part("doc_id", 4) != 2))
    y = y.groupBy("doc_id").agg(F.max("label").alias("label"))
    count = {r[0]: r[1] for r in y.groupBy("label").count().collect()}
    sample = None
    for c in (0, 1):
        part = y.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        part = part.withColumn("weight", F.lit(count.get(c, 0) / max(1, min(max_rows, count.get(c, 0)))))
        sample = part if sample is None else sample.union(part)
    # at most 2 * max_rows rows of three numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "label", "weight")


SCORED = ("score double, n_sentences int, worst_score double, worst_start int, worst_end int, toxic_sentences array<struct<start:int,end:int,score:double>>")


def _score(weights, offset, names, threshold):
    def run(batches):
        w = weights.value.astype(np.float64)
        for b in pieces(batches):
            words, keys, first, row = parsed(b.column("text"))
            n = len(words.first) - 1
            score, count, worst, lo, hi = np.zeros(n), np.bincount(row, minlength=n), np.zeros(n), np.zeros(n, int), np.zeros(n, int)
            marked: list[list[dict]] = [[] for _ in range(n)]
            if len(first):
                z = np.clip(np.add.reduceat(w[features(keys)].sum(0), first) + offset, -40, 40)
                p = sigmoid(z)
                has = np.flatnonzero(count)
                at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                score[has] = -np.expm1(np.add.reduceat(-np.logaddexp(0, z), at))
                order = np.lexsort((np.arange(len(p)), -p, row))
                top = order[np.flatnonzero(np.concatenate(([True], row[order][1:] != row[order][:-1])))]
                last = np.append(first[1:], len(words.hash)) - 1
                chars = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))      # code points before each byte
                base = chars[words.at[:-1]]
                s, e = chars[words.start[first]] - base[row], chars[words.end[last]] - base[row]
                worst[has], lo[has], hi[has] = p[top], s[top], e[top]
                for i in np.flatnonzero(p >= threshold).tolist():
                    marked[row[i]].append({"start": int(s[i]), "end": int(e[i]), "score": float(p[i])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(score), pa.array(count, pa.int32()), pa.array(worst), pa.array(lo, pa.int32()),
                                                pa.array(hi, pa.int32()), pa.array(marked, kind)],
                list(names) + ["score", "n_sentences", "worst_score", "worst_start", "worst_end", "toxic_sentences"])
    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], keys: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """``keys`` and: score, n_sentences, the worst sentence's score and code point span, all sentences of at least ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model[0])
    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return rows.mapInArrow(_score(held, model[1], keys, threshold), f"{fields}, {SCORED}")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, threshold: float = 0.3) -> DataFrame:
    """Every text's score, learned from the labelled rows whose crc32(doc_id) mod 4 is not 2."""
    model = train(training_rows(docs, labels, "toxic", max_rows))
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ("doc_id",), threshold)
    return out.select("doc_id", (crc_part("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                      "n_sentences", "worst_score", "worst_start", "worst_end", "toxic_sentences")


def keep_clean(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the texts that score at least ``threshold``."""
    model = train(training_rows(docs, labels, "toxic", max_rows))
    held = docs.sparkSession.sparkContext.broadcast(model[0])
    names = docs.columns

    def run(batches):
        inner = _score(held, model[1], (), threshold)
        for b in pieces(batches):
            one = next(inner(iter([b])))
            yield pa.RecordBatch.from_arrays(b.columns, names).filter(pa.array(np.asarray(one.column("score")) < threshold))

    return docs.mapInArrow(run, docs.schema)
