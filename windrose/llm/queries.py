"""Registered queries of the subpackage, each over its whole table, and their cross-check SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from windrose.llm import (decontaminate, jaccard_join, lm_score, odd_sketch, phrases, pii, quality, ranked_search, substring_dedup, token_counts, toxicity, unigram,
                          warc)
from windrose.llm.common import documents, table
from windrose.session import pin_utc, ship_code

PIECES = "/opt/tokenizers/piece_bpe_32k.model"       # a SentencePiece model file, read on the driver

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def run(name: str, sql: str | None = None):
    def register(fn):
        if sql:
            SQL[name] = sql
        @wraps(fn)
        def shipped(spark: SparkSession, sf: str) -> DataFrame:
            return fn(ship_code(pin_utc(spark)), sf)
        RUNS[name] = shipped
        return fn
    return register


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * k >= 75 * (nx + ny - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT b.y, r.root FROM reach r JOIN both_ways b ON b.x = r.doc_id)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, r.component_id FROM s
JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id"""
JOIN_SQL = JACCARD_SQL.replace("r.component_id FROM s", "r.component_id, coalesce(l.n, 0) AS n_links FROM s") + """
LEFT JOIN (SELECT x, count(*) AS n FROM both_ways GROUP BY x) l ON l.x = s.doc_id"""


@run("op1_ngram_jaccard_join", JOIN_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf))


@run("op9_benchmark_decontamination")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf), table(spark, sf, "benchmark"))


@run("op10_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf), table(spark, sf, "labels"))


@run("op8_personal_data")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(documents(spark, sf))


@run("op3_sentencepiece")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return unigram.encode(documents(spark, sf), unigram.load(PIECES))


@run("op7_token_counts")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf), unigram.load(PIECES))


@run("op4_substring_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.repeats(documents(spark, sf))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS sha,
             CAST(unhex(sha1(html)) AS BIT)::VARCHAR AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d"""


@run("op5_warc", WARC_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf, "pages"))).drop("payload")


@run("op6_lm_scoring")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.scores(documents(spark, sf))


@run("op2_quality_rules")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(documents(spark, sf), table(spark, sf, "labels"))


SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
al AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM len),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, al GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT q.item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // l))))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), al GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""


@run("op13_ranked_search", SEARCH_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf), table(spark, sf, "benchmark"))


ODD_SKETCH_SQL = (JACCARD_SQL.replace("len(ws) >= 5", "len(ws) >= 3").replace("len(ws) - 3)", "len(ws) - 1)").replace("ws[i:i + 4]", "ws[i:i + 2]")
                  .replace("75 *", "85 *").replace("r.component_id FROM s", "r.component_id, s.doc_id = r.component_id AS kept FROM s"))


@run("op12_odd_sketch_dedup", ODD_SKETCH_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return odd_sketch.near_duplicates(documents(spark, sf))


PHRASE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k)),
c AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT lang, phrase, a, k, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:], ' ') AS rest FROM c, range(1, 4) t(j) WHERE k > 1 AND j < k),
scored AS (SELECT cut.*, x.a AS l, y.a AS r, CAST((2000000 * cut.a::HUGEINT) // (x.a + y.a) AS BIGINT) AS score
           FROM cut JOIN c x ON x.lang = cut.lang AND x.phrase = cut.first JOIN c y ON y.lang = cut.lang AND y.phrase = cut.rest),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, a AS longer, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM c, range(2, 4) t(m), range(1, 4) u(i) WHERE m < k AND i + m - 1 <= k),
held AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY ALL),
r AS (SELECT worst.lang, worst.phrase, worst.a, worst.l, worst.r, worst.score FROM worst LEFT JOIN held h ON h.lang = worst.lang AND h.phrase = worst.phrase
      WHERE h.longer IS NULL OR 100 * h.longer::HUGEINT < 80 * worst.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@run("op11_phrase_collocations", PHRASE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf))
