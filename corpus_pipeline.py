"""The corpus pipeline: documents without toxic, repeated, contaminated or personal content, as token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windrose.llm import decontaminate, jaccard_join, pii, toxicity, unigram
from windrose.llm.common import documents, stored, table
from windrose.llm.queries import PIECES
from windrose.session import pin_utc, ship_code


def drop_toxic(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(ship_code(spark), sf, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    ship_code(spark)
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    return decontaminate.clean(docs, table(ship_code(spark), sf, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    ship_code(spark)
    return pii.redact(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    ship_code(spark)
    return unigram.encode(docs, unigram.load(PIECES), ("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("sentencepiece", to_pieces),
]

#: A learned classifier and a tokenizer are not expressible in SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
