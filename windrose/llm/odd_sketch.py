"""Near duplicates: MinHash bands find candidates, odd sketches verify them, full sets confirm the links.

1. One pass hashes every text's k-word shingles, digests the set (equal sets are one node from here on) and takes BANDS x ROWS
   MinHash samples.  The samples of a band make its key.  The samples are also folded into a parity bitmap (odd sketch): each
   (index, sample) pair flips one of BITS bits.  The bits in which two sketches differ count the samples in which the sets
   differ, twice each, less what falls together: few for very similar sets, where a plain MinHash estimate is coarse.
2. Nodes that share a band key are candidates.  A candidate stays if its sketches differ in at most ``most_bits`` bits, a bound that
   a pair of the wanted similarity passes all but once in 1e10, and if odd sketches of the *whole* sets (WIDE bits) differ in no more
   bits than the sets may have unequal shingles: differing bits never outnumber unequal shingles, so this drops no link at all.
3. What stays is confirmed on the full sets.
4. In each bucket all nodes are first compared with two hub nodes; that collapses large groups of copies with a number of pairs
   in proportion to their rows.  Then the pairs of a bucket that are still in different components are compared; the sketches are
   compared inside the join, so only pairs that pass become rows.  Components are exact and no group is expanded into its pairs.

A pair at the threshold shares no band once in ``(1 - 0.85**4)**-32``, about 2e10, times.

Defined cases: words are maximal runs of other than space and \\t-\\r, A-Z count as a-z.  Texts of fewer than k words have their
whole word sequence as one shingle; null, empty and blank texts have an empty set, no links, and are kept.  Rows are told apart by
their sets: repeated rows share a node.  A null doc_id never names a component: component_id is null, and the rows kept, if all ids in it
are.  Shingles and sets are 64-bit digests; two unlike sets with one digest are detected by a second one and end the job.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import bloom_filter, lists, may_contain, mix, pieces, salt, stored
from windrose.llm.components import components
from windrose.llm.jaccard_join import shingle_sets

BANDS, ROWS = 32, 4
BITS, WIDE = 512, 1024       # bits of the sketches of the samples and of the whole set
SEEN = 200_000               # digests a task remembers to send a set's sketches once
MISS = 1e-10                 # chance to lose a pair at the threshold by its sampled sketch
PLAIN = {"parquet.enable.dictionary": "false"}
WORDS = (BITS + WIDE) // 64
_XOR = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * salt(1))
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * salt(2)) | np.uint64(1)


def most_bits(percent: int) -> int:
    """Differing bits beyond which a pair of the wanted similarity comes at most with chance MISS.

    Unequal samples are binomial; each puts two balls into the joint bitmap, and odd cells never outnumber balls.
    """
    n, p = BANDS * ROWS, 1 - percent / 100
    tail, x = 0.0, n
    while x > 0 and (tail := tail + math.comb(n, x) * p**x * (1 - p) ** (n - x)) <= MISS:
        x -= 1
    return 2 * x


def _parity(row: np.ndarray, bit: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """(rows, bits / 64) words in which a bit is set if it was hit an odd number of times."""
    odd = np.bincount(row * bits + bit, minlength=rows * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, bits), axis=1, bitorder="little").view(np.int64)


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (BANDS a set) and sketch words (samples' first, then the whole set's) of non-empty sets of hashes."""
    rows, size = len(sets), np.array([len(s) for s in sets])
    flat, first = np.concatenate(sets), np.cumsum(size) - size
    low = np.empty((BANDS * ROWS, rows), np.uint64)
    for i in range(BANDS * ROWS):
        low[i] = np.minimum.reduceat((flat ^ _XOR[i]) * _ODD[i], first)
    keys = np.empty((rows, BANDS), np.uint64)
    for b in range(BANDS):
        v = np.full(rows, salt(b + 3))
        for r in range(ROWS):
            v = mix(v + low[b * ROWS + r])
        keys[:, b] = v
    places = mix(low + (np.arange(BANDS * ROWS, dtype=np.uint64) * salt(5))[:, None]) % np.uint64(BITS)
    sampled = _parity(np.tile(np.arange(rows), BANDS * ROWS), places.ravel().astype(np.int64), rows, BITS)
    whole = _parity(np.repeat(np.arange(rows), size), (mix(flat) % np.uint64(WIDE)).astype(np.int64), rows, WIDE)
    return keys.view(np.int64), np.hstack([sampled, whole])


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return d >> 65, d & 0x7FFFFFFFFFFFFFFF


def _mark(k: int):
    def run(batches):
        seen: set[int] = set()
        for b in pieces(batches):
            n, node, twin, new, sets = [], [], [], [], []
            for s in shingle_sets(b.column("text"), k):
                d, t = _digest(s)
                if len(seen) >= SEEN:
                    seen.clear()
                new.append(len(s) > 0 and d not in seen)
                if new[-1]:
                    seen.add(d), sets.append(s)
                n.append(len(s)), node.append(d), twin.append(t)
            keys, words = sketches(sets) if sets else (np.zeros((0, BANDS), np.int64), np.zeros((0, WORDS), np.int64))
            has = np.array(new, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, node, twin)),
                                              lists(keys.ravel(), has * BANDS, pa.int64()), lists(words.ravel(), has * WORDS, pa.int64())],
                                             ["doc_id", "n", "node", "twin", "bands", "words"])
    return run


def _full(k: int, wanted):
    """Sets of the texts whose (mixed) doc_id the filter may hold."""
    def run(batches):
        for b in pieces(batches):
            b = b.take(pa.array(may_contain(wanted.value, np.asarray(b.column("id_hash")).view(np.uint64))))
            sets = list(shingle_sets(b.column("text"), k))
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s)[0] for s in sets], pa.int64()),
                                                  lists(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64())], ["node", "full"])
    return run


def _close(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and both sketches of the sides named ``a`` and ``b`` allow the wanted similarity."""
    n = F.col(f"n_{a}") + F.col(f"n_{b}")
    bits = [F.bit_count(F.col(f"w{i}_{a}").bitwiseXOR(F.col(f"w{i}_{b}"))) for i in range(WORDS)]
    sampled, whole = sum(bits[1:BITS // 64], bits[0]), sum(bits[BITS // 64 + 1:], bits[BITS // 64])
    return ((100 * F.least(f"n_{a}", f"n_{b}") >= percent * F.greatest(f"n_{a}", f"n_{b}")) & (sampled <= most_bits(percent))
            & ((100 + percent) * whole <= (100 - percent) * n))


def _side(df: DataFrame, s: str, *keep: str) -> DataFrame:
    """``df`` with its columns named for one side of a pair."""
    return df.select(*keep, *(F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in df.columns if c not in keep))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...): see the module's text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = stored(docs.mapInArrow(_mark(k), "doc_id long, n long, node long, twin long, bands array<long>, words array<long>"), "sketch_marks", **PLAIN)
    same = F.when(F.col("t0") == F.col("t1"), F.lit(0)).otherwise(F.raise_error(F.lit("two shingle sets have one digest")))
    nodes = stored(marks.groupBy("node").agg(F.min("doc_id").alias("min_id"), F.min("twin").alias("t0"), F.max("twin").alias("t1")).select(
        "node", "min_id", same.alias("ok")), "sketch_nodes")

    # buckets of at least two nodes
    posts = marks.select("node", F.explode("bands").alias("key"))
    shared = stored(posts.groupBy("key").agg(F.min("node").alias("h0"), F.max("node").alias("h1")).where("h0 < h1"), "sketch_buckets", **PLAIN)
    posts = stored(posts.join(shared, "key").select("key", "node", "h0", "h1").distinct(), "sketch_posts", **PLAIN)
    alive = posts.select("node").distinct()
    held = marks.where(F.size("bands") > 0).join(alive, "node", "left_semi").select("node", "n", *(F.col("words")[i].alias(f"w{i}") for i in range(WORDS)))
    held = stored(held.dropDuplicates(["node"]), "sketches", **PLAIN)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of the (a, b, n_a, n_b) pairs those that are similar enough on their full sets."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        of = nodes.join(ends, "node", "left_semi").select(F.xxhash64("min_id").alias("h"))
        wanted = spark.sparkContext.broadcast(bloom_filter(of, "h"))
        sets = docs.select(F.xxhash64("doc_id").alias("id_hash"), "text").mapInArrow(_full(k, wanted), "node long, full array<long>")
        sets = stored(sets.join(ends, "node", "left_semi"), "full_sets", **PLAIN)
        both = pairs.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b").withColumn("same", F.size(F.array_intersect("full_a", "full_b")))
        return both.where(100 * F.col("same") >= percent * (F.col("n_a") + F.col("n_b") - F.col("same"))).select(
            F.col("a").alias("u"), F.col("b").alias("v")).distinct()

    star = posts.select("node", F.explode(F.array("h0", "h1")).alias("hub")).where("node <> hub")
    star = star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    star = star.join(_side(held, "a"), "a").join(_side(held, "b"), "b").where(_close("a", "b", percent)).select("a", "b", "n_a", "n_b")
    star = stored(star, "sketch_star", **PLAIN)
    near = stored(confirmed(star), "sketch_near")
    comps = stored(components(near), "sketch_comps")

    # what shares a bucket and is not connected yet
    kind = posts.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = kind.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    kind = stored(kind.join(mixed, "key").join(held, "node"), "sketch_mixed", **PLAIN)
    open_ = (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & _close("a", "b", percent)
    left, right = _side(kind, "a", "key"), _side(kind, "b", "key").withColumnRenamed("key", "key_b")
    cross = left.join(right, (F.col("key") == F.col("key_b")) & open_).select("a", "b", "n_a", "n_b").distinct()
    cross = stored(cross.join(star.select("a", "b"), ["a", "b"], "left_anti"), "sketch_cross", **PLAIN)
    every = comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(confirmed(cross))
    final = stored(components(every), "sketch_all")

    named = nodes.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    out = marks.select("doc_id", "n", "node").join(named.join(ids, "comp").select("node", "component_id"), "node")
    # an empty set links with nothing, so such rows stand for themselves
    out = out.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
