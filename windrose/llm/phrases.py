"""Phrase collocations: exact counts of word sequences in HAT-tries, scored by their weakest cut.

Counting goes by phrase length.  A phrase of ``min_count`` occurrences has parts of at least as many, so from two words on only
occurrences whose two parts of one word less may be frequent (a Bloom filter of fixed size) are counted; all of those are,
so every count that is kept is exact.

A task counts in a trie over word ids (``HatTrie``).  Its inner nodes branch on bytes of the ids of the leading words; its
leaves are containers of counts in hash order, which burst into a node of 256 once they are too large.  When the trie has more
entries than its room, its largest subtrees leave as sorted runs of (prefix, last word, count); the prefix is the digest of all
words but the last.  A partition of prefixes sorts its runs together and adds up equal neighbours as they stream by.  The last word
takes part in the dealing, so the continuations of one common prefix are spread.

Prefix and last word lead from a frequent phrase to its words, so parts and scores need no further look at the texts.  One more
pass fetches the spelling of the words of the best phrases.

Defined cases: a null text is empty, a null lang is ``und``.  Repeated rows count each time.  Without a phrase of ``min_count``
occurrences the result is empty.  Words and phrases are 64-bit digests until their texts are fetched; lang is part of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.llm.common import bloom_filter, lists, may_contain, mix, pieces, salt, stored
from windrose.llm.tokens import bounds, buffers, span_hashes

STOP = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))        # between pieces
GAP = STOP | np.isin(np.arange(256), list(b" \t"))                  # between words
WORDS = 4                # longest phrase
ROOM = 1 << 20           # entries of a task's trie
BURST = 1 << 14          # entries of a container
BITS = 24                # of the Bloom filters (2 MB; a fuller one prunes less, the counts stay exact)
SEEN = 1 << 22           # words a task remembers to fetch them once (8 bytes each)
PLAIN = {"parquet.enable.dictionary": "false"}


class Container:
    """(path, prefix, last word, count) in hash order, and a tail of entries not folded in yet."""

    def __init__(self):
        self.body, self.tail, self.size = (*(np.zeros(0, np.uint64),) * 3, np.zeros(0, np.int64)), [], 0

    def add(self, *entries):
        self.tail.append(entries)
        self.size += len(entries[0])
        if self.size > 2 * len(self.body[0]) + 1024:
            self.fold()

    def fold(self):
        if self.tail:
            path, prefix, last, count = (np.concatenate([b, *t]) for b, t in zip(self.body, zip(*self.tail)))
            h = prefix + mix(last)
            order = np.argsort(h, kind="stable")
            h = h[order]
            at = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
            own = order[at]
            self.body, self.tail = (path[own], prefix[own], last[own], np.add.reduceat(count[order], at)), []
            self.size = len(at)
        return self.body

    def entries(self):
        body = self.fold()
        order = np.lexsort((body[2], body[1], body[0]))
        yield tuple(x[order] for x in body)


class Node:
    """Branches on one byte of the path."""

    def __init__(self, level: int):
        self.level, self.kids, self.size = level, {}, 0

    def add(self, path, *rest):
        """Entries in order of path."""
        byte = (path >> np.uint64(56 - 8 * self.level)) & np.uint64(255)
        cut = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1], [True])))
        for lo, hi, b in zip(cut[:-1].tolist(), cut[1:].tolist(), byte[cut[:-1]].tolist()):
            kid = self.kids.get(b)
            if kid is None:
                kid = self.kids[b] = Container()
            before = kid.size
            kid.add(path[lo:hi], *(x[lo:hi] for x in rest))
            if isinstance(kid, Container) and kid.size > BURST and self.level < 7:
                kid.fold()
                if kid.size > BURST:
                    burst = self.kids[b] = Node(self.level + 1)
                    burst.add(*next(kid.entries()))
                    kid = burst
            self.size += kid.size - before

    def entries(self):
        for b in sorted(self.kids):
            yield from self.kids[b].entries()


RUNS = "prefix long, last long, count long"


class HatTrie:
    """Counts of (prefix, last word) in at most about ``room`` entries; ``spill`` gives up whole subtrees as sorted runs."""

    def __init__(self, room: int):
        self.root, self.room = Node(0), room

    def add(self, path: np.ndarray, prefix: np.ndarray, last: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(path, kind="stable")
        if len(order):
            self.root.add(*(x[order] for x in (path, prefix, last, count)))

    def spill(self, keep: int):
        """Runs of the largest subtrees, until at most ``keep`` entries are left."""
        for b, kid in sorted(self.root.kids.items(), key=lambda x: -x[1].size):
            if self.root.size <= keep:
                break
            self.root.size -= kid.size
            del self.root.kids[b]
            for _, prefix, last, count in kid.entries():
                yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(last.view(np.int64)), pa.array(count)], ["prefix", "last", "count"])

    def full(self) -> bool:
        return self.root.size > self.room


def words_in(b: pa.RecordBatch):
    """Word ids (lang included), whether a word begins a piece, and start, end, row of each, with the bytes."""
    data, at = buffers(b.column("text"))
    first, start, end = bounds(data, at, GAP)
    row = np.repeat(np.arange(b.num_rows), np.diff(first))
    lang = np.asarray(b.column("lang_id")).view(np.uint64)
    h = mix(span_hashes(data, start, end) ^ lang[row]) if len(start) else np.zeros(0, np.uint64)
    stops = np.concatenate(([0], np.cumsum(STOP[data])))
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (stops[start[1:]] != stops[end[:-1]])
    return h, new, start, end, row, data


def whole(new: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words lie in one piece."""
    m = max(len(new) - k + 1, 0)
    ok = np.ones(m, bool)
    for j in range(1, k):
        ok &= ~new[j:j + m]
    return ok


BASE = np.uint64(0x5851F42D4C957F2D)


def longer(prefix: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Digests of phrases of k words from those of their first k - 1 words and their last one."""
    return mix(prefix * BASE + last + salt(k))


def phrase_keys(h: np.ndarray, k: int) -> np.ndarray:
    """Entry i is the digest of words i .. i + k - 1."""
    key = mix(h + salt(1))
    for j in range(2, k + 1):
        key = longer(key[:max(len(h) - j + 1, 0)], h[j - 1:], j)
    return key


def _count(k: int, frequent, room: int):
    """Partial counts of phrases of k words, as sorted runs.  A word's prefix is its lang; last word 0 counts all words of a lang."""
    def run(batches):
        trie = HatTrie(room)
        for b in pieces(batches):
            h, new, _, _, row, _ = words_in(b)
            lang = np.asarray(b.column("lang_id")).view(np.uint64)
            ok = whole(new, k)
            if k > 1:
                part = phrase_keys(h, k - 1)
                known = np.zeros(len(part), bool)
                known[may_contain(frequent.value, part)] = True
                ok &= known[:len(ok)] & known[1:len(ok) + 1]
            at = np.flatnonzero(ok)
            _, where, count = np.unique(phrase_keys(h, k)[at], return_index=True, return_counts=True)
            at = at[where]
            path = np.zeros(len(at), np.uint64)
            for j in range(k):
                path |= (h[at + j] >> np.uint64(48)) << np.uint64(48 - 16 * j)
            trie.add(path, part[at] if k > 1 else lang[row[at]], h[at + k - 1], count)
            if k == 1:
                lang, count = np.unique(lang[row], return_counts=True)
                trie.add(lang, lang, np.zeros(len(lang), np.uint64), count)
            if trie.full():
                yield from trie.spill(room // 2)
        yield from trie.spill(0)
    return run


FOUND = "key long, prefix long, last long, count long"


def _merged(k: int, min_count: int):
    """Rows in order of (prefix, last) -> phrases whose total is at least ``min_count``, with their digest."""
    def made(prefix, last, count):
        good = np.flatnonzero(count >= min_count)
        prefix, last = prefix[good].view(np.uint64), last[good].view(np.uint64)
        key = longer(prefix, last, k) if k > 1 else np.where(last == 0, prefix, mix(last + salt(1)))
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, prefix, last)), pa.array(count[good])], ["key", "prefix", "last", "count"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3                      # the last phrase and its sum so far
        for b in batches:
            if not b.num_rows:
                continue
            prefix, last, count = (np.append(x, np.asarray(b.column(c))) for x, c in zip(held, ("prefix", "last", "count")))
            at = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (last[1:] != last[:-1]))))
            prefix, last, count = prefix[at], last[at], np.add.reduceat(count, at)
            held = [x[-1:] for x in (prefix, last, count)]
            yield made(prefix[:-1], last[:-1], count[:-1])
        yield made(*held)
    return run


def _parts(batches):
    """Phrases with the digests of both sides of every cut."""
    for b in batches:
        words = b.column("words")
        size = np.asarray(words.value_lengths(), np.int64)
        flat, at = np.asarray(words.flatten()).view(np.uint64), np.cumsum(size) - size
        firsts, rests = np.zeros((len(size), WORDS - 1), np.uint64), np.zeros((len(size), WORDS - 1), np.uint64)
        for k in range(2, WORDS + 1):
            own = np.flatnonzero(size == k)
            ids = flat[at[own][:, None] + np.arange(k)]
            for c in range(1, k):
                for out, part in ((firsts, ids[:, :c]), (rests, ids[:, c:])):
                    key = mix(part[:, 0] + salt(1))
                    for j in range(1, part.shape[1]):
                        key = longer(key, part[:, j], j + 1)
                    out[own, c - 1] = key
        used = np.arange(WORDS - 1) < (size - 1)[:, None]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "a", "lang_key", "words")), lists(firsts[used].view(np.int64), size - 1, pa.int64()),
                                          lists(rests[used].view(np.int64), size - 1, pa.int64())], ["key", "a", "lang_key", "words", "firsts", "rests"])


class Once:
    """Which keys come for the first time; forgets all it knows beyond SEEN of them."""

    def __init__(self):
        self.large, self.small = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def first(self, key: np.ndarray) -> np.ndarray:
        """A mask of distinct ``key``."""
        new = ~np.isin(key, self.small)
        if len(self.large):
            at = np.minimum(np.searchsorted(self.large, key), len(self.large) - 1)
            new &= self.large[at] != key
        self.small = np.append(self.small, key[new])
        if len(self.small) > 4096 + len(self.large) // 8:
            self.large, self.small = np.sort(np.append(self.large, self.small)), self.small[:0]
            if len(self.large) > SEEN:
                self.large = self.large[:0]
        return new


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _spelling(wanted):
    """Wanted words: id, lang, spelling."""
    def run(batches):
        seen = Once()
        for b in pieces(batches):
            h, _, start, end, row, data = words_in(b)
            at = may_contain(wanted.value, h)
            key, where = np.unique(h[at], return_index=True)
            new = seen.first(key)
            key, at = key[new], at[where[new]]
            low = _LOWER[data].tobytes()
            word = [low[i:j].decode("utf-8", "surrogatepass") for i, j in zip(start[at].tolist(), end[at].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("lang").take(pa.array(row[at])), pa.array(word, pa.string())], ["id", "lang", "word"])
    return run


def collocations(docs: DataFrame, min_count: int = 30, inside: int = 80, top: int = 2000, room: int = ROOM) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's ``top`` phrases of 2 to 4 words, see the module's text.

    A phrase is left out if a longer one that holds it has at least ``inside`` percent of its occurrences; only phrases of one word
    more need a look, as a longer one's parts occur at least as often.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_id"), F.col("text").cast("string").alias("text"))
    found, frequent = {}, None
    for k in range(1, WORDS + 1):
        runs = rows.select("lang_id", "text").mapInArrow(_count(k, frequent, room), RUNS)
        sums = runs.repartition("prefix", "last").sortWithinPartitions("prefix", "last").mapInArrow(_merged(k, min_count), FOUND)
        found[k] = stored(sums, f"phrases{k}", **PLAIN)
        if frequent is not None:
            frequent.destroy()          # its job is done and its result stored
        if k < WORDS:
            frequent = spark.sparkContext.broadcast(bloom_filter(found[k], "key", BITS))
    # from prefix to prefix to the words of each phrase
    chain = found[1].where("last <> 0").select("key", F.col("count").alias("a"), F.col("prefix").alias("lang_key"), F.array("last").alias("words"))
    named = None
    for k in range(2, WORDS + 1):
        front = chain.select(F.col("key").alias("prefix"), "lang_key", "words")
        chain = found[k].join(front, "prefix").select("key", F.col("count").alias("a"), "lang_key", F.concat("words", F.array("last")).alias("words"))
        named = chain if named is None else named.union(chain)
    named = stored(named.mapInArrow(_parts, "key long, a long, lang_key long, words array<long>, firsts array<long>, rests array<long>"), "phrases", **PLAIN)

    counts = found[1].where("last <> 0").select("key", "count")
    for k in range(2, WORDS):
        counts = counts.union(found[k].select("key", "count"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")      # noqa: E731
    part = lambda c: counts.select(F.col("key").alias(f"{c}_key"), F.col("count").alias(c))      # noqa: E731
    cuts = named.select("key", "a", F.posexplode(F.arrays_zip("firsts", "rests")).alias("cut", "p")).select(
        "key", "a", "cut", F.col("p.firsts").alias("l_key"), F.col("p.rests").alias("r_key")).join(part("l"), "l_key").join(part("r"), "r_key")
    cuts = cuts.withColumn("both", wide("l") + wide("r")).withColumn("twice", wide("a") * 2_000_000).withColumn("score", F.expr("twice div both"))
    worst = cuts.groupBy("key").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    holder = named.where(F.size("words") > 2).select(F.explode(F.array(F.element_at("firsts", -1), F.get("rests", F.lit(0)))).alias("key"), F.col("a").alias("longer"))
    holder = holder.groupBy("key").agg(F.max("longer").alias("longer"))
    alone = named.join(holder, "key", "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * inside))
    out = alone.select("key", "words", "lang_key", "a").join(worst, "key").select("key", "words", "lang_key", "a", "worst.l", "worst.r", "worst.score")
    # all that may be among the best, ties of the last one included
    order = W.partitionBy("lang_key").orderBy(F.desc("score"), F.desc("a"))
    best = stored(out.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place"), "best_phrases")

    ids = best.select("key", F.posexplode("words").alias("pos", "id"))
    wanted = spark.sparkContext.broadcast(bloom_filter(ids.select("id").distinct(), "id", BITS))
    spelled = rows.mapInArrow(_spelling(wanted), "id long, lang string, word string").dropDuplicates(["id"])
    text = ids.join(spelled, "id").groupBy("key").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))     # at most WORDS
    total = found[1].where("last = 0").select(F.col("key").alias("lang_key"), F.col("count").alias("n"))
    done = best.join(text.select("key", "lang", F.concat_ws(" ", "w.word").alias("phrase")), "key").join(total, "lang_key")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return done.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
