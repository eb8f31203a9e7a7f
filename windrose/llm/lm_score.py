"""Language-model scores by deleted interpolation.

A word's probability after the word before it is a mixture of the bigram, unigram and uniform maximum-likelihood estimates.  The
weights depend on how often the context was seen (a bucket for each power of two) and are learned by expectation-maximisation on
*deleted* texts: a seventh of the training texts (crc32(doc_id) mod 7 = 6) is scored with counts of the others, and the weights that
explain it best are used with the counts of all training texts.

Counting and looking up are one exchange.  Texts are dealt to batches of a bounded number of characters; a batch sends each
distinct word and bigram once, with its own count, to the fragment of the hash range that sums it, and gets back only counts that
differ from its own.  So a word that is everywhere is one entry per batch, no table of all n-grams is ever broadcast or joined row by
row, and what moves is in proportion to the distinct n-grams of the batches.  Numbers of batches and fragments follow from the total
length of the texts.  For the weights, a histogram over (bucket, bigram estimate, unigram estimate) of all deleted tokens in steps of
1/8 octave goes to the driver; its size is bounded by the number of steps.

Defined cases: null and empty texts have the end token alone.  A text without doc_id counts as the text "" in the split (training).  A
context that training never saw uses the unigram and uniform parts.  Without training or deleted texts the weights are equal.
N-grams are 64-bit digests.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import crc_part, lists, salt, stored
from windrose.llm.tokens import grams, words_of

BATCH_CHARS, FRAGMENT_CHARS = 6 << 20, 6 << 20
END, START = salt(101), salt(102)
STEPS = 8                      # of the histogram in an octave
RETAINED, DELETED, UNSEEN = 0, 1, 2


class Batch:
    """Tokens of a batch's texts, their distinct words (with START) and bigrams."""

    def __init__(self, text: pa.Array):
        step, hashes, sizes = 1 << 20, [], []
        text = text.fill_null("").cast(pa.large_string())
        size = np.concatenate(([0], np.cumsum(np.diff(np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)))))
        lo = 0
        while lo < len(text):
            hi = min(max(lo + 1, int(np.searchsorted(size, size[lo] + step, "right")) - 1), len(text))
            w = words_of(text.slice(lo, hi - lo))
            hashes.append(w.hash), sizes.append(np.diff(w.first))
            lo = hi
        n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.count = n + 1                                    # tokens of each text, its end included
        self.first = np.cumsum(self.count) - self.count
        total = int(self.count.sum())
        is_end = np.zeros(total, bool)
        is_end[self.first + n] = True
        token = np.full(total, END)
        token[~is_end] = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        before = np.full(total, START)
        before[1:] = token[:-1]
        before[self.first] = START
        self.words, own = np.unique(np.append(token, START), return_inverse=True)
        self.word = own[:-1]
        start = own[-1]
        self.context = np.full(total, start)
        self.context[1:] = self.word[:-1]
        self.context[self.first] = start
        self.word_count = np.bincount(self.word, minlength=len(self.words))
        self.word_count[start] = len(n)
        pairs = grams(np.stack([before, token], 1).ravel(), 2)[::2] if total else np.zeros(0, np.uint64)
        self.pairs, self.pair, self.pair_count = np.unique(pairs, return_inverse=True, return_counts=True)


def _kind(batch: int, plan: tuple[int, int, int]) -> int:
    return RETAINED if batch < plan[0] else DELETED if batch < plan[0] + plan[1] else UNSEEN


def _fragment(h: np.ndarray, fragments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


ASK = "batch long, part int, frag long, gram array<long>, n array<int>"


def _ask(plan, fragments):
    def run(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        b = Batch(table.column("text").combine_chunks())
        rows = []
        for part, h, n in ((1, b.words, b.word_count), (2, b.pairs, b.pair_count)):
            cut = np.searchsorted(_fragment(h, fragments), np.arange(fragments + 1))
            used = np.flatnonzero(np.diff(cut))
            rows.append(pa.table([pa.array(np.full(len(used), batch)), pa.array(np.full(len(used), part), pa.int32()), pa.array(used),
                                  lists(h.view(np.int64), np.diff(cut)[used], pa.int64()), lists(n, np.diff(cut)[used], pa.int32())],
                                 ["batch", "part", "frag", "gram", "n"]))
        return pa.concat_tables(rows)
    return run


ANSWER = "batch long, part int, frag long, at array<int>, retained array<int>, deleted array<int>, high array<int>, tokens long, types long, tokens_kept long, types_kept long"


def _answer(plan):
    """Sums the counts of a fragment; a batch gets those entries that differ from its own.  A row without a batch has the totals.

    Counts travel as 31 bits; ``high`` has the bits above of (retained, deleted) pairs and is empty where all are zero.
    """
    def run(table: pa.Table) -> pa.Table:
        frag = table.column("frag")[0].as_py()
        batches, parts = np.asarray(table.column("batch")), np.asarray(table.column("part"))
        gram, n = table.column("gram").combine_chunks(), table.column("n").combine_chunks()
        size = np.asarray(gram.value_lengths(), np.int64)
        flat, count = np.asarray(gram.flatten()).view(np.uint64), np.asarray(n.flatten(), np.int64)
        kind = np.array([_kind(int(x), plan) for x in batches])
        part_of, kind_of = np.repeat(parts, size), np.repeat(kind, size)
        out, tokens = [], [0, 0, 0, 0]
        retained, deleted = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        for part in (1, 2):
            own = np.flatnonzero(part_of == part)
            u, back = np.unique(flat[own], return_inverse=True)
            r = np.bincount(back, count[own] * (kind_of[own] == RETAINED), len(u)).astype(np.int64)
            d = np.bincount(back, count[own] * (kind_of[own] == DELETED), len(u)).astype(np.int64)
            retained[own], deleted[own] = r[back], d[back]
            if part == 1:
                real = u != START
                tokens = [int((r + d)[real].sum()), int(((r + d) > 0)[real].sum()), int(r[real].sum()), int((r > 0)[real].sum())]
        differs = (retained != np.where(kind_of == RETAINED, count, 0)) | (deleted != np.where(kind_of == DELETED, count, 0))
        hit = np.flatnonzero(differs)
        del differs, count, part_of, kind_of, flat
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        sizes = np.bincount(row[hit], minlength=len(size))
        place = hit - (np.cumsum(size) - size)[row[hit]]
        zero = np.zeros(len(size), np.int64)
        retained, deleted = retained[hit], deleted[hit]
        large, high = np.zeros(len(size), bool), zero[:0]
        if len(hit) and max(retained.max(), deleted.max()) > LOW:
            large[row[hit][np.maximum(retained, deleted) > LOW]] = True
            high = (np.stack([retained, deleted], 1)[large[row[hit]]] >> 31).ravel()
            retained, deleted = retained & LOW, deleted & LOW
        out.append(pa.table([pa.array(batches), pa.array(parts, pa.int32()), pa.array(np.full(len(size), frag)), lists(place, sizes, pa.int32()),
                             lists(retained, sizes, pa.int32()), lists(deleted, sizes, pa.int32()),
                             lists(high, 2 * sizes * large, pa.int32())] + [pa.array(zero)] * 4, names=ANSWER_NAMES))
        none = lists(zero[:0], np.zeros(1, np.int64), pa.int32())
        out.append(pa.table([pa.array([-1]), pa.array([0], pa.int32()), pa.array([frag]), none, none, none, none] + [pa.array([x]) for x in tokens], names=ANSWER_NAMES))
        return pa.concat_tables(out)
    return run


LOW = (1 << 31) - 1
ANSWER_NAMES = [x.split()[0] for x in ANSWER.split(", ")]


def _known(b: Batch, kind: int, answers: pa.Table, fragments: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(retained, deleted) counts of the batch's words and of its bigrams."""
    out = []
    for part, h, n in ((1, b.words, b.word_count), (2, b.pairs, b.pair_count)):
        r, d = (n.astype(np.int64) if kind == k else np.zeros(len(n), np.int64) for k in (RETAINED, DELETED))
        own = answers.filter(pa.compute.equal(answers.column("part"), part))
        if own.num_rows:
            cut = np.searchsorted(_fragment(h, fragments), np.arange(fragments + 1))
            at = own.column("at").combine_chunks()
            place = np.asarray(at.flatten(), np.int64) + np.repeat(cut[np.asarray(own.column("frag"))], np.asarray(at.value_lengths()))
            r[place] = np.asarray(own.column("retained").combine_chunks().flatten())
            d[place] = np.asarray(own.column("deleted").combine_chunks().flatten())
            high = own.column("high").combine_chunks()
            more = np.asarray(high.flatten(), np.int64).reshape(-1, 2) << 31
            if len(more):
                large = np.repeat(np.asarray(high.value_lengths()) > 0, np.asarray(at.value_lengths()))
                r[place[large]] += more[:, 0]
                d[place[large]] += more[:, 1]
        out.append((r, d))
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context not seen, else 1 + floor(log2)."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def _estimates(b: Batch, words: np.ndarray, pairs: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the context, bigram and unigram estimate of every token."""
    c = words[b.context]
    two = np.divide(pairs[b.pair], c, out=np.zeros(len(c)), where=c > 0)
    return bucket(c), two, words[b.word] / max(tokens, 1)


def _octaves(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.rint(STEPS * np.log2(np.maximum(p, 1e-300))), -(1 << 20)).astype(np.int64)


def _histogram(plan, fragments, tokens_kept):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=["b", "two", "one", "n"])
        b = Batch(texts.column("text").combine_chunks())
        (words, _), (pairs, _) = _known(b, DELETED, answers, fragments)
        k, two, one = _estimates(b, words, pairs, tokens_kept)
        key, n = np.unique(np.stack([k, _octaves(two), _octaves(one)]), axis=1, return_counts=True)
        return pa.table([pa.array(x) for x in key] + [pa.array(n)], names=["b", "two", "one", "n"])
    return run


def learn_weights(b: np.ndarray, two: np.ndarray, one: np.ndarray, uniform: float, n: np.ndarray, rounds: int = 60, prior: float = 1.0) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each bucket by expectation-maximisation; ``prior`` tokens keep weights above 0."""
    size = int(b.max()) + 1 if len(b) else 1
    p = np.stack([two, one, np.full(len(two), uniform)])
    w = np.full((3, size), 1 / 3)
    for _ in range(rounds):
        share = p * w[:, b]
        share *= n / share.sum(0)
        w = np.stack([np.bincount(b, s, size) for s in share]) + prior / 3
        w /= w.sum(0)
    return w


def _score(plan, fragments, totals, weights):
    tokens, types = totals

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        if not texts.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())] * 2, names=names)
        b = Batch(texts.column("text").combine_chunks())
        (wr, wd), (pr, pd) = _known(b, _kind(texts.column("batch")[0].as_py(), plan), answers, fragments)
        words, pairs = wr + wd, pr + pd
        base = np.log10((words + 1) / (tokens + types + 1))[b.word]
        k, two, one = _estimates(b, words, pairs, tokens)
        w = weights[:, np.minimum(k, weights.shape[1] - 1)]
        unseen = k == 0
        lift = np.where(unseen, 1 / np.maximum(w[1] + w[2], 1e-300), 1.0)
        p = np.where(unseen, 0.0, w[0] * two) + lift * (w[1] * one + w[2] / (types + 1))
        return pa.table([texts.column("doc_id"), pa.array(b.count), pa.array(np.add.reduceat((words[b.word] > 0).astype(np.int64), b.first)),
                         pa.array(np.add.reduceat(base, b.first)), pa.array(np.add.reduceat(np.log10(p), b.first))], names=names)
    return run


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; see the module's text."""
    part = crc_part("doc_id", 7)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = lambda x, size: max(1, math.ceil(x / size))       # noqa: E731
    plan = (many(chars * 5 / 7, BATCH_CHARS), many(chars / 7, BATCH_CHARS), many(chars / 7, BATCH_CHARS))
    fragments = many(chars, FRAGMENT_CHARS)
    spread = F.xxhash64("doc_id", "text", F.lit(6))          # rows without a doc_id, or with a common one, are spread as well
    of = lambda base, n: F.lit(base) + F.pmod(spread, F.lit(n))      # noqa: E731
    dealt = docs.withColumn("batch", F.when(part == 2, of(plan[0] + plan[1], plan[2])).when(part == 6, of(plan[0], plan[1])).otherwise(of(0, plan[0])).cast("long"))
    asked = dealt.groupBy("batch").applyInArrow(_ask(plan, fragments), ASK)
    answers = stored(asked.groupBy("frag").applyInArrow(_answer(plan), ANSWER), "answers")
    tokens, types, tokens_kept, types_kept = (x or 0 for x in answers.where("batch = -1").agg(*(F.sum(c) for c in ("tokens", "types", "tokens_kept", "types_kept"))).first())
    back = answers.where((F.col("batch") >= 0) & (F.size("at") > 0)).select("batch", "part", "frag", "at", "retained", "deleted", "high")
    gone = (F.col("batch") >= plan[0]) & (F.col("batch") < plan[0] + plan[1])
    steps = dealt.where(gone).groupBy("batch").cogroup(back.where(gone).groupBy("batch")).applyInArrow(
        _histogram(plan, fragments, tokens_kept), "b long, two long, one long, n long")
    h = steps.groupBy("b", "two", "one").agg(F.sum("n").alias("n")).toPandas()
    real = lambda x: np.where(x > -(1 << 20), 2.0 ** (np.maximum(x, -8000) / STEPS), 0.0)       # noqa: E731
    weights = learn_weights(h["b"].to_numpy(np.int64), real(h["two"].to_numpy(np.int64)), real(h["one"].to_numpy(np.int64)), 1 / (types_kept + 1), h["n"].to_numpy(np.float64))
    out = dealt.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(
        _score(plan, fragments, (tokens, types), weights), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (part == 2).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
