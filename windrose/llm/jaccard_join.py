"""N-gram Jaccard self-join by vertical partitioning.

The n-grams of all texts have one global order.  The order is cut into fragments, every text into one segment per fragment;
the overlap of two texts is counted fragment by fragment and the partial counts are summed per pair.

Which pairs are counted follows from the same order (prefix principle: texts of at least the wanted similarity share one of
their first ``n - ceil(t n) + 1`` n-grams).  The order puts n-grams of the *low* hash range first, and there those found in
one text only, then those found in few texts, then all others:

1. One pass hashes every text, digests its n-gram set (equal sets are one node from here on) and keeps the low range.
2. The low range is dealt by n-gram; runs of the sorted rows tell which n-grams are shared.  A node whose prefix consists of
   n-grams found nowhere else is settled: it has no partner.  That is most of a corpus.
3. Nodes whose prefix would reach past the low range, or into n-grams found in many texts, are joined among themselves over
   all of their n-grams, rarest first.
4. For each prefix n-gram and length class two hub nodes are compared with the others.  That collapses large groups of near
   copies with a number of pairs in proportion to their rows.
5. Every pair of nodes that share a prefix n-gram, fit in length and are still in different components is compared.  Pairs
   inside a component need no comparison, so components are exact and no group is expanded into its pairs.
6. Links are inside components.  For their number the nodes of a component are dealt into blocks by length; every two blocks of
   fitting lengths meet in a task, which counts the links of each of their nodes.  A pair of nodes is never a row.

Defined cases: words are maximal runs of other than space and \\t-\\r, A-Z count as a-z.  Texts of fewer than k words have
their whole word sequence as one n-gram; null, empty and blank texts have an empty set and no links.  Rows are told apart by
their text: repeated rows share a node.  A null doc_id never names a component (component_id is null if all ids in it are).
N-grams and sets are 64-bit digests; two unlike sets with one digest are detected by a second digest and end the job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import bloom_filter, fresh, lists, may_contain, pieces, stored
from windrose.llm.components import components
from windrose.llm.tokens import grams, words_of

LOW = 0.3            # share of the hash range that is searched first
RARE = 64            # n-grams in fewer nodes than this count as rare
FRAGMENTS = 4        # cuts of the order in which overlaps are counted
SEEN = 200_000       # digests a task remembers to send a set's n-grams once
BLOCK = 512          # nodes of a block whose links are counted at once
BLOCK_GRAMS = 1 << 19      # n-grams of a block, and half the cells of the matrices of two blocks


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its k-word shingles."""
    w = words_of(text)
    g = grams(w.hash, k)
    first = w.first
    for r in range(len(first) - 1):
        lo, hi = first[r], first[r + 1]
        if hi - lo >= k:
            s = np.sort(g[lo:hi - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif hi > lo:
            yield grams(w.hash[lo:hi], int(hi - lo))
        else:
            yield g[:0]


def _digests(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 65), d & 0x7FFFFFFFFFFFFFFF


MARKS = "doc_id long, row_key long, n long, node long, twin long, n_low long, low array<long>"


def _mark(k: int, low: float):
    limit = np.uint64(int(low * 2.0**64))

    def run(batches):
        seen: set[int] = set()
        for b in pieces(batches):
            n, node, twin, n_low, kept = [], [], [], [], []
            for s in shingle_sets(b.column("text"), k):
                d, t = _digests(s)
                m = int(np.searchsorted(s, limit))
                if len(seen) >= SEEN:
                    seen.clear()
                kept.append(s[:0] if d in seen else s[:m])
                seen.add(d)
                n.append(len(s)), node.append(d), twin.append(t), n_low.append(m)
            flat = np.concatenate(kept).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(twin, pa.int64()),
                 pa.array(n_low, pa.int64()), lists(flat, np.array([len(x) for x in kept]), pa.int64())],
                ["doc_id", "row_key", "n", "node", "twin", "n_low", "low"])
    return run


def _runs(batches):
    """Rows sorted by (tok, node) -> rows of n-grams that at least two nodes have, with their number of nodes, 0 for RARE or more.

    Keeps at most RARE rows.
    """
    tok, held, hot = None, [], False      # the open run

    def close():
        return (tok, held, True) if tok is not None and not hot and len(held) > 1 else None

    for b in batches:
        t, d = (np.asarray(b.column(c)) for c in ("tok", "node"))
        if not len(t):
            continue
        fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])))
        t, d = t[fresh], d[fresh]
        if tok is not None and held and t[0] == tok and d[0] == held[-1]:
            t, d = t[1:], d[1:]
        if not len(t):
            continue
        cut = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]))
        size = np.diff(cut)
        ot, on, odf = [], [], []
        inner = np.ones(len(size), bool)
        inner[0] = inner[-1] = False      # the first and last run may go on in other batches
        good = np.flatnonzero(inner & (size > 1))
        if len(good):
            rows = np.repeat(good, size[good])
            pos = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in good])
            ot.append(t[pos]), on.append(d[pos]), odf.append(np.where(size[rows] < RARE, size[rows], 0))
        for i in ([0] if len(size) == 1 else [0, len(size) - 1]):
            own, ids = int(t[cut[i]]), d[cut[i]:cut[i + 1]].tolist()
            if own != tok:
                if done := close():
                    ot.append(np.full(len(done[1]), done[0])), on.append(np.array(done[1])), odf.append(np.full(len(done[1]), len(done[1])))
                tok, held, hot = own, [], False
            held += ids
            if len(held) >= RARE or hot:
                ids = held if not hot else ids
                ot.append(np.full(len(ids), tok)), on.append(np.array(ids)), odf.append(np.zeros(len(ids), np.int64))
                hot, held = True, held[-1:]
        if ot:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ot), pa.int64()), pa.array(np.concatenate(on), pa.int64()),
                                              pa.array(np.concatenate(odf), pa.int64())], ["tok", "node", "df"])
    if done := close():
        yield pa.RecordBatch.from_arrays([pa.array([done[0]] * len(done[1]), pa.int64()), pa.array(done[1], pa.int64()),
                                          pa.array([len(done[1])] * len(done[1]), pa.int64())], ["tok", "node", "df"])


def _segments(k: int, wanted):
    """Segments of the texts whose (mixed) doc_id the filter may hold; a few others pass it and find no partner."""
    def run(batches):
        inner = [np.uint64(int(i / FRAGMENTS * 2.0**64)) for i in range(1, FRAGMENTS)]
        for b in pieces(batches):
            b = b.take(pa.array(may_contain(wanted.value, np.asarray(b.column("id_hash")).view(np.uint64))))
            node, frag, seg = [], [], []
            if not b.num_rows:
                continue
            for s in shingle_sets(b.column("text"), k):
                d = _digests(s)[0]
                for f, x in enumerate(np.split(s, np.searchsorted(s, inner))):
                    node.append(d), frag.append(f), seg.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(frag, pa.int32()),
                 lists(np.concatenate(seg).view(np.int64), np.array([len(x) for x in seg]), pa.int64())], ["node", "frag", "seg"])
    return run


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of the (a, b) pairs those similar enough: an overlap for each fragment, summed per pair."""
    sa = segments.select(F.col("node").alias("a"), "frag", F.col("seg").alias("sa"))
    sb = segments.select(F.col("node").alias("b"), "frag", F.col("seg").alias("sb"))
    part = pairs.join(sa, "a").join(sb, ["b", "frag"]).select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("sa", "sb")).alias("part"))
    # the maximum leaves one count of a fragment where a text stands in several rows
    counts = part.groupBy("a", "b", "na", "nb").agg(*(F.max(F.when(F.col("frag") == f, F.col("part"))).alias(f"p{f}") for f in range(FRAGMENTS)))
    same = counts.withColumn("same", sum(F.coalesce(f"p{f}", F.lit(0)) for f in range(FRAGMENTS)))
    return same.where(100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def row_key(docs: DataFrame) -> Column:
    """A digest of all of a row's columns: rows that differ anywhere have different ones."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def _block_links(sizes: np.ndarray, weight: np.ndarray, side: np.ndarray | None, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Per node the rows it links with: on the other side of a pair of blocks, or in the same block (no side)."""
    grams_, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = np.bincount(at, minlength=len(grams_)) > 1
    at, row = (np.cumsum(shared) - 1)[at][shared[at]], row[shared[at]]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    n_shared = int(shared.sum())
    width = max(1, min(n_shared, 2 * BLOCK_GRAMS // len(sets)))
    same = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, n_shared, width):
        i, j = np.searchsorted(at, [lo, lo + width])
        held = np.zeros((len(sets), width), np.float32)
        held[row[i:j], at[i:j] - lo] = 1
        same += held @ held.T
    link = 100 * same >= percent * (sizes[:, None] + sizes[None, :] - same)
    if side is not None:
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    return (link @ weight.astype(np.float64)).astype(np.int64)


PAIR = ["comp", "xb", "xi", "yb", "yi"]


def _count_links(percent: int):
    """Rows sorted by pair of blocks -> (node, linked) of every pair.  Keeps one pair of blocks."""
    def run(batches):
        open_key, held = None, []

        def close():
            node, n, copies, side = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("node", "n", "copies", "side"))
            _, xb, xi, yb, yi = open_key
            one = (xb, xi) == (yb, yi)
            if len(node) > 1 and (one or 0 < side.sum() < len(side)):
                sets = [x for b in held for x in _sets_of(b)]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_block_links(n, copies, None if one else side, sets, percent))], ["node", "linked"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in PAIR], 1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cut, cut[1:]):
                if held and tuple(keys[lo]) != open_key:
                    yield from close()
                    held = []
                open_key = tuple(keys[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from close()
    return run


def _sets_of(b: pa.RecordBatch) -> list[np.ndarray]:
    col = b.column("seg")
    off, flat = np.asarray(col.offsets), np.asarray(col.values)
    return [flat[x:y] for x, y in zip(off, off[1:])]


def _degrees(comps: DataFrame, nodes: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(node, linked) of the nodes in ``comps`` (node, comp): rows of other nodes of the component that are similar enough."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")      # links reach into the next band at most
    held = stored(comps.join(nodes.select("node", "n", "copies").hint("merge"), "node").withColumn("band", band), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    many = held.groupBy("comp", "band").agg(blocks.alias("k")).groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("k"))
    of = lambda step: F.coalesce(F.try_element_at("k", F.col("band") + step), F.lit(0))      # noqa: E731
    placed = held.join(many.hint("merge"), "comp").withColumn("i", F.pmod(F.xxhash64("node"), of(0)).cast("int"))
    none = F.array().cast("array<int>")
    upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(none)      # noqa: E731
    pair = lambda xb, xi, yb, yi, side: F.struct(xb.alias("xb"), xi.alias("xi"), yb.alias("yb"), yi.alias("yi"), side.cast("int").alias("side"))      # noqa: E731
    b, i = F.col("band"), F.col("i")
    own = F.transform(upto(of(0)), lambda j: pair(b, F.least(i, j), b, F.greatest(i, j), j < i))
    above = F.transform(upto(of(1)), lambda j: pair(b, i, b + 1, j, F.lit(0)))
    below = F.transform(upto(of(-1)), lambda j: pair(b - 1, j, b, i, F.lit(1)))
    dealt = placed.select("node", "comp", "n", "copies", F.inline(F.concat(own, above, below)))
    # a fragment stands in several rows where a text does
    sets = segments.join(held.select("node"), "node", "left_semi").groupBy("node").agg(
        *(F.first(F.when(F.col("frag") == f, F.col("seg")), ignorenulls=True).alias(f"s{f}") for f in range(FRAGMENTS))).select(
            "node", F.concat(*(f"s{f}" for f in range(FRAGMENTS))).alias("seg"))
    parts = max(int(comps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = dealt.join(sets.hint("merge"), "node").repartition(parts, *PAIR).sortWithinPartitions(*PAIR)
    return met.mapInArrow(_count_links(percent), "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def _classes(docs: DataFrame, k: int, percent: int, low: float) -> tuple[DataFrame, DataFrame, Callable[[], DataFrame]]:
    """(doc_id, row_key, n, node) of every row, (node, min_id, copies, root) of every set, root naming the component, and what counts the links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), F.col("text").cast("string").alias("text"))
    marks = stored(docs.mapInArrow(_mark(k, low), MARKS), "marks", **{"parquet.enable.dictionary": "false"})
    nodes = stored(marks.groupBy("node").agg(
        F.min("doc_id").alias("min_id"), F.first("n").alias("n"), F.first("n_low").alias("n_low"),
        F.count("*").alias("copies"), F.min("twin").alias("t0"), F.max("twin").alias("t1")).select(
            "node", "min_id", "n", "n_low", "copies",
            F.when(F.col("t0") == F.col("t1"), F.lit(0)).otherwise(F.raise_error(F.lit("two n-gram sets have one digest"))).alias("ok")), "nodes")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    # shared n-grams of the low range
    rows = marks.select(F.explode("low").alias("tok"), "node").repartition(parts, "tok").sortWithinPartitions("tok", "node")
    shared = stored(rows.mapInArrow(_runs, "tok long, node long, df long"), "shared", **{"parquet.enable.dictionary": "false"})
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    lists_ = shared.groupBy("node").agg(F.collect_list(F.when(F.col("df") > 0, F.struct("df", "tok"))).alias("rare"), F.count("*").alias("n_shared"))
    # an n-gram of no other node comes first in the order: enough of them and the node is settled
    open_ = nodes.where("n > 0").join(lists_.hint("merge"), "node", "left").select(
        "node", "min_id", "n", F.coalesce("rare", F.array().cast("array<struct<df:bigint,tok:bigint>>")).alias("rare"),
        (F.col("n_low") - F.coalesce("n_shared", F.lit(0))).alias("own")).withColumn("need", prefix - F.col("own")).where("need > 0")
    open_ = stored(open_, "open", **{"parquet.enable.dictionary": "false"})
    far = F.col("need") > F.size("rare")
    first = open_.select("node", "n", (F.col("own") / F.col("n")).alias("own"), F.col("own").alias("at"),
                         F.posexplode(F.slice(F.array_sort("rare"), F.lit(1), F.col("need").cast("int")))).select(
        "node", "n", "own", (F.col("at") + F.col("pos")).alias("pos"), F.col("col.tok").alias("tok"))

    # whole sets of the open nodes
    mixed_id = lambda c: F.xxhash64(F.col(c).cast("long"))      # noqa: E731
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_filter(open_.select(mixed_id("min_id").alias("h")), "h"))
    segments = docs.select(mixed_id("doc_id").alias("id_hash"), "text").mapInArrow(_segments(k, wanted), "node long, frag int, seg array<long>")
    segments = stored(segments, "segments", **{"parquet.enable.dictionary": "false"})
    distant = open_.where(far).select("node", "n", "own")
    every = segments.join(distant, "node").select("node", "n", "own", F.explode("seg").alias("tok")).distinct()
    often = every.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    ranked = every.join(often.hint("merge"), "tok").groupBy("node", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("toks"), F.first("own").alias("own"))
    # n-grams without a partner come first in the order and use up places of the prefix
    alone = F.col("n") - F.size("toks")
    second = ranked.select("node", "n", (alone / F.col("n")).alias("own"), alone.alias("at"),
                           F.posexplode(F.slice("toks", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int")))).select(
        "node", "n", "own", (F.col("at") + F.col("pos")).alias("pos"), F.xxhash64("col.tok", F.lit(1)).alias("tok"))
    posts = first.unionByName(second).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int"))
    posts = stored(posts, "posts", **{"parquet.enable.dictionary": "false"})

    # if this is the first n-gram that the two share, they can share no more than what follows it in the shorter rest
    fits = (100 + percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= percent * (F.col("na") + F.col("nb"))
    hubs = posts.groupBy("tok", "band").agg(F.min(F.struct("own", "node", "n", "pos")).alias("h0"), F.max(F.struct("node", "n", "pos")).alias("h1"), F.count("*").alias("c")).where("c > 1")
    hubs = hubs.select("tok", "band", F.explode(F.array(F.struct(F.col("h0.node").alias("hub"), F.col("h0.n").alias("nh"), F.col("h0.pos").alias("ph")),
                                                         F.struct(F.col("h1.node").alias("hub"), F.col("h1.n").alias("nh"), F.col("h1.pos").alias("ph")))).alias("h"))
    star = posts.join(hubs.hint("merge"), ["tok", "band"]).where(F.col("node") != F.col("h.hub"))
    up = F.col("node") < F.col("h.hub")
    either = lambda x, y: F.when(up, F.col(x)).otherwise(F.col(y))      # noqa: E731
    star = star.select(F.least("node", "h.hub").alias("a"), F.greatest("node", "h.hub").alias("b"), either("n", "h.nh").alias("na"), either("h.nh", "n").alias("nb"),
                       either("pos", "h.ph").alias("pa"), either("h.ph", "pos").alias("pb")).where(fits)
    star = stored(star.select("a", "b", "na", "nb").distinct(), "star")
    near = stored(_links(star, segments, percent), "near")
    comps = stored(components(near), "comps")

    # what shares a prefix n-gram and is not connected yet
    kind = posts.join(comps.hint("merge"), "node", "left").select("tok", "node", "n", "pos", F.coalesce("comp", "node").alias("comp"))
    mixed = kind.groupBy("tok").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("tok")
    kind = stored(kind.join(mixed.hint("merge"), "tok"), "mixed")
    x = kind.select("tok", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    y = kind.select("tok", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
    cross = x.join(y.hint("merge"), "tok").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits).select("a", "b", "na", "nb").distinct()
    cross = cross.join(star.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
    more = stored(_links(cross, segments, percent), "more")
    all_ = stored(components(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(more)), "all")

    named = nodes.join(all_.hint("merge"), "node", "left").select("node", "min_id", "copies", F.coalesce("comp", "node").alias("root"))
    return marks.select("doc_id", "row_key", "n", "node"), named, lambda: _degrees(all_, nodes, segments, percent)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, low: float = LOW) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs`` (doc_id, text, ...): see the module's text.

    ``n_links`` is the number of other rows with an equal or similar enough set.
    """
    rows, sets, degrees = _classes(docs, k, percent, low)
    ids = sets.groupBy("root").agg(F.min("min_id").alias("component_id"))
    sets = sets.join(ids.hint("merge"), "root").join(degrees().hint("merge"), "node", "left").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    # an empty set links with nothing, so such rows stand for themselves
    own = lambda c, empty: F.when(F.col("n") == 0, empty).otherwise(F.col(c)).alias(c)      # noqa: E731
    return rows.join(sets, "node").select(
        "doc_id", F.col("n").alias("n_shingles"), own("component_id", F.col("doc_id")), own("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id, rows without one last.

    Rows are told apart by all of their columns, never by doc_id alone: unlike texts under one doc_id both stay, near copies
    without a doc_id go, of rows that repeat in every column one stays.  Rows with an empty set are in no group and all stay.
    """
    key, many = fresh(docs, "row_key", "row_many")
    rows, sets, _ = _classes(docs, k, percent, LOW)
    rows = rows.where("n > 0")
    twice = rows.groupBy("row_key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("row_key").alias(key))
    rows = rows.join(sets.select("node", "root").hint("merge"), "node")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("best"), F.count("*").alias("c"))
    gone = stored(rows.join(best.where("c > 1").hint("merge"), "root").where(F.col("row_key") != F.col("best.row_key")).select(F.col("row_key").alias(key)).distinct(), "gone")
    left = docs.withColumn(key, row_key(docs)).join(gone, key, "left_anti").join(twice.withColumn(many, F.lit(1)), key, "left")
    out = left.where(F.col(many).isNotNull()).dropDuplicates([key]).unionByName(left.where(F.col(many).isNull()))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
