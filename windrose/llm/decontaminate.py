"""Benchmark decontamination by spaced-seed hashing.

Masks lay over windows of words and ignore the positions marked 0, so a window still matches if words there were
replaced.  Hashes of all benchmark windows are joined with those of all text windows; each hit names a diagonal (an alignment of
an item with a text), on which the best stretch that tolerates substitutions is verified word by word.

No accepted diagonal is missed: the score of a best stretch never falls below 0 on its way, so there are few ways in which its first
WEIGHT equal words can lie, and each of them is a mask (``starts``).  Items that need fewer equal words have masks of that weight.

Scale: a Bloom filter of fixed size (built by a distributed aggregation) is broadcast to keep windows that no
item has from the shuffle (two filters with independent bits, as there are many windows); what passes is joined with the item windows by an ordinary join, so any number of items is handled.
A hit carries positions only; the words of texts with hits are stored once.

Texts and items are told apart by (id, text), never by an id alone: equal rows are one, items or texts that share an id are not.

Defined cases: items without words match nothing.  Null and blank texts have no hits.  Rows and items without an id take part and
are reported with a null id.  ``clean`` leaves out items of fewer than FLOOR words: a single common word is no contamination.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import GOLD, bloom_filter, fresh, lists, may_contain, mix, pieces, salt, stored
from windrose.llm.tokens import words_of

MATCH, MISS = 1.0, -1.5          # scores of an equal and of a replaced word on a diagonal
WEIGHT = 5                       # equal words of a seed
FLOOR = 5                        # words of an item for which a text may be dropped


def starts(weight: int) -> list[str]:
    """Every way in which the first ``weight`` equal words of a best stretch can lie."""
    out = []

    def grow(mask: str, score: float) -> None:
        if mask.count("1") == weight:
            out.append(mask)
            return
        grow(mask + "1", score + MATCH)
        if score + MISS >= 0:
            grow(mask + "0", score + MISS)

    grow("", 0.0)
    return out


def second(s: np.ndarray) -> np.ndarray:
    """Other bits of the same seeds, for the second filter."""
    return mix(s ^ GOLD)


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Entry i hashes the marked words of the window at i (windows across rows included)."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    v = np.full(m, salt(int(mask, 2)))
    for j, c in enumerate(mask):
        if c == "1":
            v = v * np.uint64(0x5851F42D4C957F2D) + h[j:j + m]
    return mix(v)


def _windows(w, masks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in the row and hash of every window that lies in one row."""
    row_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    rows, pos, seeds = [], [], []
    for mask in masks:
        s = seed_hashes(w.hash, mask)
        m = len(s)
        ok = np.flatnonzero(row_of[:m] == row_of[len(mask) - 1:len(mask) - 1 + m]) if m else np.zeros(0, np.int64)
        rows.append(row_of[ok]), pos.append(ok - w.first[row_of[ok]]), seeds.append(s[ok])
    return np.concatenate(rows), np.concatenate(pos), np.concatenate(seeds)


def _items(min_words: int, share: float):
    def run(batches):
        for b in pieces(batches):
            w = words_of(b.column("text"))
            n = np.diff(w.first)
            weight = np.minimum(WEIGHT, np.maximum(1, np.minimum(min_words, np.ceil(n * share)))).astype(np.int64)
            seeds: list[list[int]] = [[] for _ in n]
            at: list[list[int]] = [[] for _ in n]
            for k in np.unique(weight).tolist():
                r, p, s = _windows(w, starts(k))
                ok = weight[r] == k
                for i, q, x in zip(r[ok].tolist(), p[ok].tolist(), s[ok].view(np.int64).tolist()):
                    seeds[i].append(x), at[i].append(q)
            also = [second(np.array(x, np.int64).view(np.uint64)).view(np.int64).tolist() for x in seeds]
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), b.column("item_key"), pa.array(n, pa.int64()), pa.array(weight, pa.int64()), lists(w.hash.view(np.int64), n, pa.int64()),
                 pa.array(seeds, pa.list_(pa.int64())), pa.array(also, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))],
                ["item_id", "item_key", "n_item", "weight", "item", "seeds", "also", "at"])
    return run


def _hits(masks, bloom):
    def run(batches):
        for b in pieces(batches):
            w = words_of(b.column("text"))
            r, p, s = _windows(w, masks)
            hit = may_contain(bloom.value[0], s)
            hit = hit[may_contain(bloom.value[1], second(s[hit]))]
            if not len(hit):
                continue
            hit = hit[np.argsort(r[hit], kind="stable")]
            rows, count = np.unique(r[hit], return_counts=True)
            ids, uid = (b.column(c).take(pa.array(rows)) for c in ("doc_id", "uid"))
            words = [w.hash[w.first[i]:w.first[i + 1]] for i in rows]
            yield pa.RecordBatch.from_arrays(
                [ids, uid, lists(np.concatenate(words).view(np.int64), np.array([len(x) for x in words]), pa.int64()),
                 lists(s[hit].view(np.int64), count, pa.int64()), lists(p[hit], count, pa.int32())], ["doc_id", "uid", "words", "seeds", "at"])
    return run


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and number of equal words of the highest scoring stretch (the first one of equal scores)."""
    s = np.concatenate(([0.0], np.cumsum(np.where(equal, MATCH, MISS))))
    low = np.minimum.accumulate(s)
    end = int(np.argmax(s - low))
    start = int(np.argmax(s[:end + 1] == low[end]))
    return start, end, int(equal[start:end].sum())


def _verify(batches):
    for b in batches:
        out = []
        for doc_id, uid, item_id, words, item, diagonals in zip(*(b.column(c) if c in ("words", "item") else b.column(c).to_pylist()
                                                                  for c in ("doc_id", "uid", "item_id", "words", "item", "diagonals"))):
            d, t = np.asarray(words.values), np.asarray(item.values)
            best = (-1, 0, 0, 0)
            for x in sorted(diagonals):
                lo, hi = max(0, -x), min(len(t), len(d) - x)
                s, e, n = best_stretch(t[lo:hi] == d[lo + x:hi + x])
                best = max(best, (n, -(lo + x + s), lo + s, e - s))
            out.append((doc_id, uid, item_id, -best[1], best[2], best[3], best[0], len(t)))
        cols = list(zip(*out)) if out else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                         ["doc_id", "uid", "item_id", "word_start", "item_start", "n_aligned", "n_match", "n_item"])


def _uid(id_: str) -> Column:
    """Tells texts apart by (id, text)."""
    return F.xxhash64(F.col(id_).cast("long"), F.col("text").cast("string"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int, share: float) -> DataFrame:
    """The columns of ``overlaps`` and the text's uid."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _uid("doc_id").alias("uid"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _uid("item_id").alias("item_key"), F.col("text").cast("string").alias("text"))
    items = stored(items.mapInArrow(_items(min_words, share), "item_id long, item_key long, n_item long, weight long, item array<long>, seeds array<long>, also array<long>, at array<int>"), "items")
    weights = [r[0] for r in items.where("n_item > 0").select("weight").distinct().collect()]   # at most WEIGHT
    seeds = items.select("item_key", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("item_key", F.col("s.seeds").alias("seed"), F.col("s.at").alias("item_at")).distinct()
    held = spark.sparkContext.broadcast((bloom_filter(seeds, "seed"), bloom_filter(items.select(F.explode("also").alias("seed")), "seed")))
    every = [m for k in sorted(weights) or [WEIGHT] for m in starts(k)]
    hits = stored(docs.mapInArrow(_hits(every, held), "doc_id long, uid long, words array<long>, seeds array<long>, at array<int>"), "hits",
                  **{"parquet.enable.dictionary": "false"})
    at = hits.select("uid", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("uid", F.col("s.seeds").alias("seed"), F.col("s.at").alias("at"))
    pairs = at.join(seeds, "seed").groupBy("uid", "item_key").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"))
    found = pairs.join(hits.select("doc_id", "uid", "words").dropDuplicates(["uid"]), "uid").join(items.select("item_id", "item_key", "item").dropDuplicates(["item_key"]), "item_key")
    out = found.select("doc_id", "uid", "item_id", "words", "item", "diagonals").mapInArrow(
        _verify, "doc_id long, uid long, item_id long, word_start long, item_start long, n_aligned long, n_match long, n_item long")
    return out.where(F.col("n_match") >= F.least(F.lit(min_words), F.ceil(F.col("n_item") * share)))


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, share: float = 0.75) -> DataFrame:
    """One row per (text, item) that overlap in at least ``min(min_words, ceil(share * item words))`` equal words on one diagonal.

    Columns doc_id, item_id, word_start (in the text), item_start, n_aligned (words of the stretch), n_match, n_item.
    """
    return _overlaps(docs, benchmark, min_words, share).drop("uid")


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, share: float = 0.75) -> DataFrame:
    """``docs`` without the rows that overlap with an item of at least FLOOR words."""
    own, key = fresh(docs, "id", "uid")
    bad = _overlaps(docs, benchmark, min_words, share).where(F.col("n_item") >= FLOOR).select(F.col("uid").alias(own)).distinct()
    return docs.withColumn(key, _uid("doc_id")).join(bad, F.col(key) == F.col(own), "left_anti").drop(key)
