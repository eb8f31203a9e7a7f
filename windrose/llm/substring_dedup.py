"""Repeated passages by content-defined chunking.

A gear rolling hash (the last 16 bytes) cuts a text where its top bits are zero, so cuts depend on nearby bytes only and an
insertion moves no cut beyond its own chunk.  A cut closer than MIN bytes to the candidate before it is dropped and chunks over MAX
bytes are divided from their start, both rules local too.  Chunks with equal digests are copies of the first one (smallest doc_id,
then position); neighbouring repeated chunks in a text join to a run, whether they are first ones or copies, and runs of at least
``min_words`` words are reported, as one span for each stretch of one kind (not those of a kind that is short beside the other).  The default of 25
is meant for passages of over 50 words, without a guarantee: up to a chunk at either end is not covered.

Scale: a block of texts is deduplicated before the shuffle, so a chunk that a third of all texts share reaches its task once a
block; runs of equal digests stream through sorted partitions, and only spans meet again by doc_id.  A single false match of the
64-bit digests is shorter than any reported span.

Defined cases: null and empty texts have no chunks.  Rows without a doc_id are left out.  Repeated rows (same doc_id and text) are one
row and no copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import GOLD, fresh, mix, pieces
from windrose.llm.tokens import RAW_BYTE, bounds, buffers, span_hashes

GEAR = (mix((np.arange(256, dtype=np.uint64) + np.uint64(777)) * GOLD) >> np.uint64(48)).astype(np.uint16)
CUT_BITS, MIN, MAX = 4, 16, 128
ROW = "digest long, doc_id long, place long, copy_of long, copied boolean"


def gear_hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte; it starts afresh in each row."""
    h = GEAR[data]
    inside = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    for k in (1, 2, 4, 8):
        low = h[:-k] << np.uint16(k)
        low[inside[k:] < k] = 0
        h = h.copy()
        h[k:] += low
    return h


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every chunk."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cand = np.flatnonzero(gear_hash(data, at) >> np.uint16(16 - CUT_BITS) == 0) + 1
    for _ in range(3):                                                 # not inside a character
        cand = np.where((cand < n) & ((data[np.minimum(cand, n - 1)] & 0xC0) == 0x80), cand + 1, cand)
    cand = np.unique(cand)
    row = np.searchsorted(at, cand - 1, "right") - 1
    near = np.zeros(len(cand), bool)
    near[1:] = (np.diff(cand) < MIN) & (row[1:] == row[:-1])
    cut = np.unique(np.concatenate((cand[~near & (cand < at[row + 1])], at)))
    start, size = cut[:-1], np.diff(cut)
    parts = -(-size // MAX)
    if (parts > 1).any():
        extra = np.repeat(start, parts) + MAX * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        for _ in range(3):
            extra = np.where((data[np.minimum(extra, n - 1)] & 0xC0) == 0x80, extra + 1, extra)
        cut = np.unique(np.append(extra, cut))
        start, size = cut[:-1], np.diff(cut)
    return np.searchsorted(at, start, "right") - 1, start, start + size


def _chunk(batches):
    """One row for each chunk: a block's first of a digest waits for its copies elsewhere, its others are copies already."""
    for b in pieces(batches, block=1 << 22):
        data, at = buffers(b.column("text"))
        row, start, end = chunks(data, at)
        if not len(row):
            continue
        _, first, _ = bounds(data, at)
        words = np.diff(np.searchsorted(first, np.append(start, end[-1])))
        doc = np.asarray(b.column("doc_id"))[row]
        digest = span_hashes(data, start, end, RAW_BYTE).view(np.int64)
        place = ((start - at[row]) << 20) | ((end - start) << 8) | np.minimum(words, 255)
        order = np.lexsort((place, doc, digest))
        digest, doc, place = digest[order], doc[order], place[order]
        new = np.ones(len(digest), bool)
        new[1:] = digest[1:] != digest[:-1]
        twin = np.zeros(len(digest), bool)
        twin[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        keep = ~twin
        copied = np.bincount(lead, keep, len(new))[lead] > 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(digest[keep]), pa.array(doc[keep]), pa.array(place[keep]), pa.array(doc[lead][keep], mask=new[keep]), pa.array(copied[keep])],
            ["digest", "doc_id", "place", "copy_of", "copied"])


def _copies(batches):
    """Rows sorted by (digest, doc_id, place).  Of those that wait, a digest's first is told if it has copies, the others are copies."""
    names = ["doc_id", "place", "copy_of", "is_first"]
    digest = lead = last = pending = None        # the open digest, its first doc_id, last row, and first row while it has no copy
    for b in batches:
        d, doc, place = (np.asarray(b.column(c)) for c in ("digest", "doc_id", "place"))
        own, copied = b.column("copy_of"), np.asarray(b.column("copied"))
        done = np.asarray(own.is_valid())
        if not len(d):
            continue
        out = [(doc[done], place[done], np.asarray(own.drop_null()), np.zeros(done.sum(), bool))]
        d, doc, place, copied = d[~done], doc[~done], place[~done], copied[~done]
        if len(d):
            new = np.ones(len(d), bool)
            new[1:] = d[1:] != d[:-1]
            new[0] = digest is None or d[0] != digest
            twin = np.zeros(len(d), bool)
            twin[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
            twin[0] = not new[0] and (doc[0], place[0]) == last
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            of = np.where(at >= 0, doc[np.maximum(at, 0)], lead if lead is not None else 0)
            keep = ~new & ~twin
            out.append((doc[keep], place[keep], of[keep], np.zeros(keep.sum(), bool)))
            again = np.bincount(at + 1, keep, len(new) + 1)          # copies of the open digest, then of each first row
            if pending and again[0]:
                out.append(tuple(np.array([x]) for x in (*pending, pending[0], True)))
                pending = None
            first = np.flatnonzero(new & (copied | (again[1:] > 0)))
            out.append((doc[first], place[first], doc[first], np.ones(len(first), bool)))
            if new.any():
                i = int(np.flatnonzero(new)[-1])
                pending = None if copied[i] or again[i + 1] else (doc[i], place[i])
            digest, lead, last = d[-1], of[-1], (doc[-1], place[-1])
        cols = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3].astype(bool))], names)


SPAN = ["doc_id", "start_byte", "end_byte", "n_words", "copy_of", "is_first"]


def _spans(min_words: int):
    """Repeated chunks sorted by (doc_id, place) -> spans of neighbouring chunks of one kind, of runs that are long enough."""
    def rows_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "is_first" else pa.int64()) for c, n in zip(zip(*rows), SPAN)], SPAN)

    def told(spans):
        """Of a run's spans those whose kind has enough words in it; all if only both kinds together have enough."""
        of = {k: sum(x[3] for x in spans if x[5] == k) for k in (True, False)}
        if max(of.values()) >= min_words:
            return [x for x in spans if of[x[5]] >= min_words]
        return spans if sum(of.values()) >= min_words else []

    def run(batches):
        open_: list[list] = []      # the spans of the open run
        for b in batches:
            doc, place, of, lead = (np.asarray(b.column(c)) for c in ("doc_id", "place", "copy_of", "is_first"))
            if not len(doc):
                continue
            start, words = place >> 20, place & 255
            end = start + ((place >> 8) & 4095)
            apart = np.ones(len(doc), bool)
            apart[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
            apart[0] = not open_ or open_[-1][0] != doc[0] or start[0] > open_[-1][2]
            new = apart.copy()
            new[1:] |= lead[1:] != lead[:-1]
            new[0] = True
            first = np.flatnonzero(new)
            rows = [list(x) for x in zip(doc[first].tolist(), start[first].tolist(), np.maximum.reduceat(end, first).tolist(),
                                         np.add.reduceat(words, first).tolist(), of[first].tolist(), lead[first].tolist())]
            done = []
            for r, cut in zip(rows, apart[first].tolist()):
                if cut:
                    done += told(open_)
                    open_ = [r]
                elif open_[-1][5] == r[5]:              # the span goes on in this batch
                    open_[-1][2], open_[-1][3] = max(open_[-1][2], r[2]), open_[-1][3] + r[3]
                else:
                    open_.append(r)
            if done:
                yield rows_of(done)
        if done := told(open_):
            yield rows_of(done)
    return run


def repeats(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """(doc_id, start_byte, end_byte, n_words, copy_of, is_first): the spans of text found more than once.

    A first occurrence has is_first and its own doc_id; of the others copy_of is a doc_id that has the text earlier.
    ``min_words`` holds for a run of neighbouring spans, so a span may be shorter.

    Positions are bytes of the UTF-8 text.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.mapInArrow(_chunk, ROW)
    # known copies only pass through, so they are dealt evenly
    key = F.when(F.col("copy_of").isNull(), F.col("digest")).otherwise(F.xxhash64("doc_id", "place"))
    found = found.withColumn("deal", key).repartition(parts, "deal").drop("deal").sortWithinPartitions("digest", "doc_id", "place")
    copies = found.mapInArrow(_copies, "doc_id long, place long, copy_of long, is_first boolean")
    return copies.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "place", "is_first").mapInArrow(
        _spans(min_words), "doc_id long, start_byte long, end_byte long, n_words long, copy_of long, is_first boolean")


def without_repeats(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """``docs`` with the spans of ``repeats`` cut out of the texts; the first occurrence stays, also where it holds a short copy."""
    own, parts = fresh(docs, "id", "cuts")
    cuts = repeats(docs, min_words).where(~F.col("is_first") & (F.col("n_words") >= min_words)).groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias(parts))
    joined = docs.join(cuts, docs["doc_id"].cast("long") == cuts[own], "left").drop(own)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in batches:
            texts = []
            for text, spans in zip(b.column("text").to_pylist(), b.column(len(names)).to_pylist()):
                if text and spans:
                    raw, out, done = text.encode(), [], 0
                    for s in spans:
                        out.append(raw[done:s["start_byte"]])
                        done = s["end_byte"]
                    text = b"".join(out + [raw[done:]]).decode("utf-8", "replace")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(i).type) if n == "text" else b.column(i) for i, n in enumerate(names)], names)

    return joined.mapInArrow(run, schema)
