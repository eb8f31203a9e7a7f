"""Small tables and brute-force versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: An extra column for each name that operators use inside.
CLASHES = ("id", "row", "cuts", "node", "n", "tok", "score", "words", "h", "batch", "component_id", "label", "weight", "spans", "ids", "frag")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text, low=True) -> list[str]:
    return WORD.findall(lower(text or "") if low else text or "")


def prose(rng: random.Random, n: int, size: int = 4000) -> list[str]:
    return ["".join(chr(97 + (x := rng.randrange(size) * 7919 + i) % 26) for i in range(1 + rng.randrange(8))) + str(rng.randrange(size)) for _ in range(n)]


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    long = " ".join(f"w{i % 9001}" for i in range(60_000))
    text = "One two three four five six seven. Eight nine ten eleven twelve, thirteen fourteen!"
    return [(None, None, None, None, None), (None, text, "en", None, 3), (1, "", "en", "a", 0), (2, None, None, "b", None), (3, " \t\n ", "en", "c", 4),
            (4, text, "en", "d", len(text)), (4, text, "en", "d", len(text)), (5, text, None, "e", None), (6, "É漢🙂 ß ", "fr", "f", 7), (7, long, "en", "g", len(long)),
            (8, "a", "en", "h", 1), (9, "a", "en", "h", 1), (10, "a b", None, None, 3), (11, "\n\n", "", "", 2), (4, "another text under a used id", "en", "d", 5)]


def edge_table(spark):
    df = spark.createDataFrame(edge_rows(), DOCS)
    return df.selectExpr("*", *(f"'x' as `{c}`" for c in CLASHES))


def shingles(text, k=5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, percent=75, k=5) -> dict:
    """doc_id -> (set size, smallest reachable doc_id), by an inverted index over all pairs that share anything."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    having = defaultdict(list)
    for at, (i, s) in enumerate(sets):
        same = Counter(j for g in s for j in having[g])
        for g in s:
            having[g].append(at)
        for j, c in same.items():
            if 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}
