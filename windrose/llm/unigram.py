"""SentencePiece unigram encoding and decoding of whole batches of texts.

The pieces of a model file lie in a double-array trie.  A batch is cut into segments that no piece can cross (before a run of
whitespace markers, around characters that no piece holds), equal segments are looked at once, and a Viterbi search runs over all
distinct segments in step: trie walks start at every character at once, then the offsets are settled from left to right.

Rules, as published for unigram models: a marker stands for a space and one is put in front of a text; the path with the largest
sum of scores wins, of equal sums the one that reaches a position from the earliest start; a character that is no piece costs the
smallest score minus ten and is spelled by its UTF-8 byte pieces.  Sums are exact (double), per segment.  Decoding joins the
pieces, turns markers into spaces, byte pieces into bytes (bytes that are no UTF-8 become U+FFFD) and drops the first space.

Defined cases: null and empty texts have no pieces.  A literal U+2581 in a text counts as a space, so it comes back as one.  Ids
outside the vocabulary and control pieces decode to nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import lists, pieces
from windrose.llm.tokens import RAW_BYTE, buffers, span_hashes

MARKER = "▁"
UNKNOWN_COST = 10.0


class Vocabulary(NamedTuple):
    """What a task needs of a model; its size is that of the vocabulary."""

    alphabet: np.ndarray      # sorted code points; the code of alphabet[i] is i + 1, others are 0
    base: np.ndarray          # child of state s by code c: t = base[s] + c if check[t] == s
    check: np.ndarray
    value: np.ndarray         # piece that ends in a state, or -1
    parent_fail: np.ndarray   # state of the longest proper suffix that is in the trie
    out: np.ndarray           # nearest state on the suffix chain, itself included, in which a piece ends, or 0
    depth: np.ndarray         # characters of a state
    score: np.ndarray         # of each piece
    byte_ids: np.ndarray      # piece of each byte value
    spelled: np.ndarray       # bytes that the pieces decode to, one after the other
    spelled_at: np.ndarray    # where a piece's bytes begin; one more entry than pieces
    unknown: float            # score of a character that is no piece
    cut: bool                 # no piece holds a line feed


def double_array(children: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and the place of each node; node 0 is the root and gets place 1."""
    size = 4 * len(children) + 2 * width + 64
    used = np.zeros(size, bool)
    base, check, place = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(len(children), np.int64)
    used[:2] = True
    place[0], low, order = 1, 2, [0]
    for n in order:
        kids = sorted(children[n])
        if not kids:
            continue
        codes = np.array(kids)
        at = max(low - kids[0], 1)
        while True:
            if at + codes[-1] >= size:
                grow = size
                used, base, check = np.append(used, np.zeros(grow, bool)), np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32))
                size += grow
            if not used[at + codes].any():
                break
            at += 1
        base[place[n]] = at
        used[at + codes] = True
        check[at + codes] = place[n]
        for c in kids:
            place[children[n][c]] = at + c
            order.append(children[n][c])
        while low < size - 1 and used[low]:
            low += 1
        if len(kids) > 1 and at > low + 4096:       # a crowded stretch is left behind
            low = at - 2048
    pad = np.zeros(width + 2, np.int32)
    return np.append(base, pad), np.append(check, pad - 1), place


def vocabulary(entries: list[tuple[str, float, str]]) -> Vocabulary:
    """``entries``: (piece, score, kind) by id; kind is normal, byte (as <0x41>), or other (never matched, decodes to nothing)."""
    normal = [(i, p) for i, (p, _, kind) in enumerate(entries) if kind == "normal" and p]
    alphabet = sorted({ord(c) for _, p in normal for c in p})
    code = {chr(c): i + 1 for i, c in enumerate(alphabet)}
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    depth = [0]
    for i, p in normal:
        n = 0
        for c in p:
            k = code[c]
            if k not in children[n]:
                children[n][k] = len(children)
                children.append({})
                depth.append(depth[n] + 1)
            n = children[n][k]
        ends.setdefault(n, i)
    base, check, place = double_array(children, len(alphabet) + 1)
    fail, out = np.zeros(len(children), np.int64), np.full(len(children), -1, np.int64)
    order = [0]
    for n in order:
        for k, m in children[n].items():
            f = int(fail[n])
            while n and k not in children[f] and f:
                f = int(fail[f])
            fail[m] = children[f][k] if n and k in children[f] else 0
            out[m] = m if m in ends else out[fail[m]]
            order.append(m)
    states = len(base)
    value, fails, outs, deep = np.full(states, -1, np.int32), np.zeros(states, np.int32), np.zeros(states, np.int32), np.zeros(states, np.int32)
    fails[place], deep[place] = place[fail], depth
    outs[place] = np.where(out >= 0, place[out], 0)
    if ends:
        value[place[list(ends)]] = list(ends.values())
    byte_ids = np.full(256, -1, np.int32)
    spelled = []
    for i, (p, _, kind) in enumerate(entries):
        if kind == "byte":
            byte_ids[int(p[3:5], 16)] = i
            spelled.append(bytes([int(p[3:5], 16)]))
        else:
            spelled.append(p.replace(MARKER, " ").encode() if kind == "normal" else b"")
    lowest = min((s for _, s, kind in entries if kind == "normal"), default=0.0)
    at = np.zeros(len(entries) + 1, np.int64)
    np.cumsum([len(x) for x in spelled], out=at[1:])
    return Vocabulary(np.array(alphabet, np.uint32), base, check, value, fails, outs, deep, np.array([s for _, s, _ in entries]),
                      byte_ids, np.frombuffer(b"".join(spelled), np.uint8), at, lowest - UNKNOWN_COST, not any("\n" in p for _, p in normal))


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file (read on the driver only)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
    return vocabulary([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])


class Segments(NamedTuple):
    row: np.ndarray        # row of each segment of the batch
    which: np.ndarray      # its distinct segment
    point: np.ndarray      # code points of the distinct segments, one after the other
    at: np.ndarray         # distinct segment u has point[at[u]:at[u + 1]]


def segments(text: pa.Array, v: Vocabulary) -> Segments:
    text = text.fill_null("").cast(pa.large_string())
    text = pc.replace_substring(text, MARKER, " ")
    text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
    data, at = buffers(text)
    n = len(data)
    if not n:
        return Segments(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64))
    fresh = np.zeros(n + 1, bool)
    fresh[at] = True
    blank = data == 32
    fresh[1:n] |= blank[1:] & ~blank[:-1]
    if v.cut:
        line = data == 10
        fresh[:n] |= line
        fresh[1:] |= line
    fresh[n] = True
    cut = np.flatnonzero(fresh)
    start, end = cut[:-1], cut[1:]
    row = np.searchsorted(at, start, "right") - 1
    _, where, which = np.unique(span_hashes(data, start, end, RAW_BYTE), return_index=True, return_inverse=True)
    s, e = start[where], end[where]
    size = e - s
    offset = np.cumsum(size) - size
    own = data[np.repeat(s - offset, size) + np.arange(size.sum())]
    lead = (own & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))
    point = np.frombuffer(own.tobytes().decode("utf-8", "surrogatepass").replace(" ", MARKER).encode("utf-32-le"), np.uint32)
    return Segments(row, which, point, chars[np.append(offset, size.sum())])


def codes_of(point: np.ndarray, v: Vocabulary) -> np.ndarray:
    if not len(v.alphabet):
        return np.zeros(len(point), np.int32)
    i = np.searchsorted(v.alphabet, point).astype(np.int32)
    i[i == len(v.alphabet)] = 0
    return np.where(v.alphabet[i] == point, i + np.int32(1), np.int32(0))


def viterbi(seg: Segments, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the best paths of all distinct segments, and how many each has.  A negative id -c - 1 is the character c."""
    point, at = seg.point, seg.at
    n, words = len(point), len(seg.at) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(words, np.int64)
    code = codes_of(point, v)
    size = np.diff(at)
    word = np.repeat(np.arange(words, dtype=np.int32), size)
    stop = np.repeat(at[1:].astype(np.int32), size)
    # walks from every character
    alive, state = np.arange(n, dtype=np.int32), np.ones(n, np.int32)
    starts, lengths, ids = [], [], []
    single = np.zeros(n, bool)
    d = 0
    while len(alive):
        keep = alive + d < stop[alive]
        alive, state = alive[keep], state[keep]
        c = code[alive + d]
        t = v.base[state] + c
        ok = (c > 0) & (v.check[t] == state)
        alive, state = alive[ok], t[ok]
        value = v.value[state]
        hit = np.flatnonzero(value >= 0)
        starts.append(alive[hit]), lengths.append(np.full(len(hit), d + 1, np.int32)), ids.append(value[hit])
        if d == 0:
            single[alive[hit]] = True
        d += 1
    lone = np.flatnonzero(~single).astype(np.int32)
    starts.append(lone), lengths.append(np.ones(len(lone), np.int32)), ids.append(-point[lone].astype(np.int32) - 1)
    s, ln, p = np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)
    del starts, lengths, ids, alive, state, stop, single, lone
    gain = np.where(p >= 0, v.score[np.maximum(p, 0)], v.unknown)
    # settle offsets from left to right; node i of word w is i + w, a word has one node more than characters
    offset = s - at[word[s]].astype(np.int32)
    order = np.argsort(offset, kind="stable").astype(np.int32)
    p, gain, offset, from_ = p[order], gain[order], offset[order], (s + word[s])[order]
    to = from_ + ln[order]
    del s, ln, order, word, code
    best, prev, via = np.full(n + words, -np.inf), np.zeros(n + words, np.int32), np.zeros(n + words, np.int32)
    best[at[:-1] + np.arange(words)] = 0.0
    edge = np.append(np.flatnonzero(np.concatenate(([True], offset[1:] != offset[:-1]))), len(offset))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        f, t = from_[lo:hi], to[lo:hi]
        cand = best[f] + gain[lo:hi]
        won = np.flatnonzero(cand > best[t])
        t = t[won]
        best[t], prev[t], via[t] = cand[won], f[won], p[lo:hi][won]
    # walk back in step
    node, first = at[1:] + np.arange(words), at[:-1] + np.arange(words)
    live, steps, found = np.flatnonzero(node > first), [], []
    while len(live):
        steps.append(live), found.append(via[node[live]])
        node[live] = prev[node[live]]
        live = live[node[live] > first[live]]
    owner = np.concatenate(steps)
    back = np.repeat(np.arange(len(steps)), [len(x) for x in steps])
    order = np.lexsort((-back, owner))
    return np.concatenate(found)[order], np.bincount(owner, minlength=words)


def spell_unknown(ids: np.ndarray, count: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Unknown characters become byte pieces."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, count
    raw = [chr(-x - 1).encode("utf-8", "surrogatepass") for x in ids[odd].tolist()]
    times = np.ones(len(ids), np.int64)
    times[odd] = [len(x) for x in raw]
    out = np.repeat(ids, times)
    out[np.repeat(ids < 0, times)] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.bincount(np.repeat(np.repeat(np.arange(len(count)), count), times), minlength=len(count))


def encode_batch(text: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all rows and the number of each row."""
    seg = segments(text, v)
    ids, count = spell_unknown(*viterbi(seg, v), v)
    n = count[seg.which]
    begin = (np.cumsum(count) - count)[seg.which]
    take = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return ids[take].astype(np.int32), np.bincount(seg.row, n, len(text)).astype(np.int64)


def decode_batch(flat: np.ndarray, count: np.ndarray, v: Vocabulary) -> pa.Array:
    """Texts of rows of ids."""
    flat = np.asarray(flat, np.int64)
    row = np.repeat(np.arange(len(count)), count)
    good = (flat >= 0) & (flat < len(v.spelled_at) - 1)
    flat, row = flat[good], row[good]
    size = v.spelled_at[flat + 1] - v.spelled_at[flat]
    data = v.spelled[np.repeat(v.spelled_at[flat] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    end = np.cumsum(np.bincount(row, size, len(count)).astype(np.int64))
    start = np.concatenate(([0], end[:-1]))
    first = np.minimum(start, max(len(data) - 1, 0))
    skip = (end > start) & (data[first] == 32) if len(data) else np.zeros(len(count), bool)
    keep = np.ones(len(data), bool)
    keep[first[skip]] = False
    off = np.concatenate(([0], end - np.cumsum(skip))).astype(np.int64)
    raw = data[keep].tobytes()
    try:
        raw.decode()
        return pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(off.tobytes()), pa.py_buffer(raw))
    except UnicodeDecodeError:
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])], pa.large_string())


def encode(docs: DataFrame, v: Vocabulary, keys: tuple[str, ...] = ("doc_id",), block: int = 1 << 19) -> DataFrame:
    """``keys``, n_tokens, ids (array) and round_trip (decoding gives the text back) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(v)
    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keys).schema)

    def run(batches):
        for b in pieces(batches, block=block):
            text = b.column("text").fill_null("").cast(pa.large_string())
            flat, count = encode_batch(text, held.value)
            same = pc.equal(decode_batch(flat, count, held.value), pc.replace_substring(text, MARKER, " "))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(count), lists(flat, count, pa.int32()), same], [*keys, "n_tokens", "ids", "round_trip"])

    return rows.mapInArrow(run, f"{fields}n_tokens long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, v: Vocabulary, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and text of rows with an ``ids`` column; null ids give a null text."""
    held = rows.sparkSession.sparkContext.broadcast(v)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            count = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
            flat = pc.fill_null(ids.flatten(), -1)
            text = decode_batch(np.asarray(flat), count, held.value)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pc.if_else(pc.is_valid(ids), text, pa.scalar(None, pa.large_string())).cast(pa.string())], [*keys, "text"])

    return rows.select(*keys, F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"{fields}text string")
