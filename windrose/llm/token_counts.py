"""Token counts without tokens: an Aho-Corasick automaton enumerates the unigram pieces that end at each character, and a dynamic
program carries only the best score and its number of pieces.

All distinct segments of a batch advance together, one character a step.  Pieces ending at a character are visited from the
longest to the shortest and win only by a larger sum, which is the tokenizer's rule for equal sums (see ``unigram``).  A character
that is no piece counts as many pieces as it has bytes.

Defined cases: null and empty texts count 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import pieces
from windrose.llm.unigram import Segments, Vocabulary, codes_of, segments


def count_segments(seg: Segments, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and score of the best path of each distinct segment."""
    n, words = len(seg.point), len(seg.at) - 1
    code, size = codes_of(seg.point, v), np.diff(seg.at)
    order = np.argsort(-size, kind="stable")              # longest first: those still running are always in front
    at, left = seg.at[:-1][order], size[order]
    wide = 1 + np.searchsorted([0x80, 0x800, 0x10000], seg.point, "right")       # bytes of a character
    best, count = np.full(n + words, -np.inf), np.zeros(n + words, np.int64)
    home = seg.at[:-1][order] + order                     # node 0 of each segment
    best[home] = 0.0
    state = np.ones(words, np.int64)
    for i in range(int(left[0]) if words else 0):
        m = int(np.searchsorted(-left, -i, "left"))       # segments longer than i
        c = code[at[:m] + i]
        s = state[:m].copy()
        todo = np.flatnonzero(c > 0)
        s[c == 0] = 1
        while len(todo):                                  # follow failure links until a transition or the root
            t = v.base[s[todo]] + c[todo]
            ok = v.check[t] == s[todo]
            s[todo[ok]] = t[ok]
            todo = todo[~ok]
            root = s[todo] == 1
            todo = todo[~root]
            s[todo] = v.parent_fail[s[todo]]
        state[:m] = s
        end = home[:m] + i + 1
        out = v.out[s]
        live = np.flatnonzero(out > 0)
        lone = np.ones(m, bool)
        while len(live):
            o = out[live]
            back = end[live] - v.depth[o]
            cand = best[back] + v.score[v.value[o]]
            won = np.flatnonzero(cand > best[end[live]])
            t = end[live][won]
            best[t], count[t] = cand[won], count[back[won]] + 1
            lone[live[v.depth[o] == 1]] = False
            out[live] = v.out[v.parent_fail[o]]
            live = live[out[live] > 0]
        u = np.flatnonzero(lone)                          # no piece for this character alone
        cand = best[end[u] - 1] + v.unknown
        won = np.flatnonzero(cand > best[end[u]])
        t = end[u][won]
        best[t], count[t] = cand[won], count[t - 1] + wide[at[u[won]] + i]
    last = seg.at[1:] + np.arange(words)
    return count[last], best[last]


def token_counts(docs: DataFrame, v: Vocabulary, keys: tuple[str, ...] = ("doc_id",), block: int = 1 << 21) -> DataFrame:
    """``keys``, n_tokens and score (sum of the best path's scores) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(v)
    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keys).schema)

    def run(batches):
        for b in pieces(batches, block=block):
            seg = segments(b.column("text"), held.value)
            n, s = count_segments(seg, held.value)
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in keys] + [pa.array(np.bincount(seg.row, n[seg.which], b.num_rows).astype(np.int64)),
                                               pa.array(np.bincount(seg.row, s[seg.which], b.num_rows).astype(np.float64))], [*keys, "n_tokens", "score"])

    return rows.mapInArrow(run, f"{fields}n_tokens long, score double")
