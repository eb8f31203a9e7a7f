"""Ranked lexical search, term at a time with a limited set of accumulators.

1. One pass cuts every document into terms and keeps, per document, its length and the occurrences of the terms that some
   query has (a Bloom filter of fixed size, then an exact lookup).
2. Document counts of the query terms, the number of documents and their total length are ordinary aggregations; a term's weight
   follows from them, the same in every task.
3. Documents are searched in shards of a bounded number of postings.  A query takes its terms rarest first and adds each term's
   contributions to the accumulators of the shard's documents.  As soon as the sum of the bounds of the terms still to come is
   below the k-th best partial score (or the k-th best score of the task's earlier shards), no document without an accumulator can
   get among the best: no new ones are created, and the survivors alone are updated, exactly, by the remaining terms.
4. A task sends its k best of each query; the best of these are the answer.  Nothing grows with a term's postings.

Queries are taken in blocks of a bounded number of (query, term) pairs, each broadcast by itself.

A term's bound is its weight times the largest contribution in the shard.  Weights are doubles rounded down once; everything else is 64-bit
integer arithmetic, so partitioning and order of addition do not change a score.

Defined cases: null, empty and term-less texts are no documents; queries without terms, or whose terms no document has, have no
result.  Queries are told apart by (item_id, text), equal rows are one.  Rows that share a doc_id are separate documents;
rows without one rank behind others of the same score.  Terms are 64-bit digests of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.llm.common import bloom_filter, lists, may_contain, pieces, stored
from windrose.llm.tokens import bounds, buffers, span_hashes

#: Bytes between terms: ASCII other than digits and letters.
BETWEEN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
SHARD = 1 << 20            # postings of a shard (one longer document stands alone)
QUERY_TERMS = 1 << 18      # (query, term) pairs of a block of queries


def terms_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and where each row's begin (one more entry than rows)."""
    data, at = buffers(text)
    first, start, end = bounds(data, at, BETWEEN)
    return (span_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)), first


def counted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs in order and how often each occurs."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def _query_terms(batches):
    for b in pieces(batches):
        h, first = terms_of(b.column("text"))
        row, term, _ = counted(h, np.repeat(np.arange(b.num_rows), np.diff(first)))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column("item_id").take(take), b.column("query").take(take), pa.array(term.view(np.int64))], ["item_id", "query", "term"])


def _postings(bloom):
    def run(batches):
        for b in pieces(batches):
            h, first = terms_of(b.column("text"))
            n = np.diff(first)
            row = np.repeat(np.arange(b.num_rows), n)
            hit = may_contain(bloom.value, h)
            row, term, tf = counted(h[hit], row[hit])
            size = np.bincount(row, minlength=b.num_rows)
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), lists(term.view(np.int64), size, pa.int64()), lists(tf, size, pa.int32())],
                                             ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))
    return run


def shards(b: pa.RecordBatch):
    """Parts of a batch with at most SHARD postings: doc_id (as they are), n, document of each posting, term, tf."""
    off = np.asarray(b.column("terms").offsets, np.int64)
    lo = 0
    while lo < b.num_rows:
        hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(off, off[lo] + SHARD, "right")) - 1))
        part = b.slice(lo, hi - lo)
        terms, tf = (np.asarray(part.column(c).flatten()) for c in ("terms", "tfs"))
        yield part.column("doc_id"), np.asarray(part.column("n")), np.repeat(np.arange(hi - lo), np.diff(off[lo:hi + 1])), terms, tf.astype(np.int64)
        lo = hi


def search_shard(docs: np.ndarray, impact: np.ndarray, at: np.ndarray, bound: np.ndarray, terms: np.ndarray, weight: np.ndarray, acc: np.ndarray,
                 k: int, floor: int) -> int:
    """Adds a query's scores to ``acc`` (zero on entry); returns how many of its terms created accumulators.

    Postings of term t are docs[at[t]:at[t + 1]] and their impacts; ``terms`` come rarest first.  Entries that end below the k-th best
    score, or below ``floor``, need not be complete.
    """
    rest = np.append(np.cumsum((weight * bound[terms])[::-1])[::-1], 0)      # bound of what terms j and later can add
    if rest[0] < floor:
        return 0
    created = len(terms)
    for j, (t, w) in enumerate(zip(terms.tolist(), weight.tolist())):
        acc[docs[at[t]:at[t + 1]]] += w * impact[at[t]:at[t + 1]]
        if rest[j + 1] < floor or rest[j + 1] < acc.max() and len(acc) >= k and rest[j + 1] < np.partition(acc, len(acc) - k)[len(acc) - k]:
            created = j + 1
            break
    kept = acc > 0
    for t, w in zip(terms[created:].tolist(), weight[created:].tolist()):
        d, f = docs[at[t]:at[t + 1]], impact[at[t]:at[t + 1]]
        live = kept[d]
        acc[d[live]] += w * f[live]
    return created


def _rank(held, n_docs: int, length: int, k: int):
    def run(batches):
        vocabulary, first, term, weight, names = held.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * (len(first) - 1)     # score, doc_id, no doc_id
        for b in batches:
            for ids, n, doc, flat, tf in shards(b):
                m = 100 - 90 + 90 * n * n_docs // length
                t = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[t] == flat)
                hit = hit[np.argsort(t[hit], kind="stable")]
                docs, impact = doc[hit], 1_000_000_000 * tf[hit] // (1000 * tf[hit] + 8 * m[doc[hit]])
                at = np.searchsorted(t[hit], np.arange(len(vocabulary) + 1))
                bound = np.zeros(len(vocabulary), np.int64)
                has = np.flatnonzero(at[1:] > at[:-1])
                if not len(has):
                    continue
                bound[has] = np.maximum.reduceat(impact, at[has])
                none, number = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
                for q in range(len(first) - 1):
                    ts, w = term[first[q]:first[q + 1]], weight[first[q]:first[q + 1]]
                    use = (bound[ts] > 0) & (w > 0)
                    s0, d0, x0 = best[q]
                    floor = int(s0[-1]) if len(s0) == k else 1
                    acc = np.zeros(len(n), np.int64)
                    search_shard(docs, impact, at, bound, ts[use], w[use], acc, k, floor)
                    good = np.flatnonzero(acc >= floor)
                    if len(good) > k:
                        good = good[acc[good] >= np.partition(acc[good], len(good) - k)[len(good) - k]]
                    if len(good):
                        s, d, x = np.append(s0, acc[good]), np.append(d0, number[good]), np.append(x0, none[good])
                        top = np.lexsort((d, x, -s))[:k]
                        best[q] = s[top], d[top], x[top]
        for q, (s, d, x) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), names[q])), pa.array(d, mask=x), pa.array(s)], ["query", "doc_id", "score"])
    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of ``docs`` (doc_id, text) for each row of ``queries`` (item_id, text)."""
    spark = docs.sparkSession
    items = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = items.withColumn("query", F.xxhash64("item_id", "text"))
    wanted = stored(items.mapInArrow(_query_terms, "item_id long, query long, term long"), "query_terms")
    bloom = spark.sparkContext.broadcast(bloom_filter(wanted, "term"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posts = stored(rows.mapInArrow(_postings(bloom), "doc_id long, n long, terms array<long>, tfs array<int>"), "postings")
    n_docs, length = posts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = posts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    plan = stored(wanted.join(df, "term").withColumn("weight", weight), "query_plan")
    blocks = -(-plan.count() // QUERY_TERMS)
    out = None
    for i in range(blocks):
        part = plan.where(F.pmod("query", F.lit(blocks)) == i).toPandas()          # about QUERY_TERMS rows of numbers
        part = part.sort_values(["query", "df", "term"], kind="stable")
        if part.empty:
            continue
        vocabulary, term = np.unique(part["term"].to_numpy(), return_inverse=True)
        query = part["query"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1], [True])))
        held = spark.sparkContext.broadcast((vocabulary, first, term, part["weight"].to_numpy(), query[first[:-1]]))
        found = posts.mapInArrow(_rank(held, n_docs, length, k), "query long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
