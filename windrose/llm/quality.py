"""Quality rules in DataFrame functions only: surface counts of every text and a log-likelihood ratio of hashed n-grams.

Two multinomials over ``BUCKETS`` hashed words and word pairs are counted: of trusted target texts and of the whole raw corpus.  A
text's score is the mean, over its words and pairs, of ``log p_target - log p_raw``, in whole millionths of a nat so that sums do not
depend on their order.  A bucket's ratio is that of its target count to the count expected from the raw corpus, both with PRIOR more, so
n-grams too rare to tell the two apart count nothing, in small corpora too.  A text is kept if no base rule fails and its score reaches
``threshold``; the same tables give the same verdicts.

Scale: all trusted texts and the whole raw corpus are counted without a shuffle of texts.  A Bloom filter of all trusted ids (CELLS words
of 64 bits at most, broadcast) marks rows; a second one holds the ids of ``docs`` that the first takes for trusted and that are not, so
a row in the first and not in the second is trusted for certain.  The few rows in both are settled by an exact join.  Counting is an
aggregation over BUCKETS keys that combines before the shuffle; scoring and the surface counts are columns of
the scan.  The counts (BUCKETS rows) are the only thing collected.

Repeated 8-word windows are looked for by hashes doubled from pairs to fours to eights, and only where the shorter ones repeat.

Defined cases: null and empty texts have no words, fail the base rule and have a null score.  Without trusted texts all ratios
are 0.  Trusted ids that are null or stand for no text are ignored; repeated rows count once each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import stored

BUCKETS = 1 << 14
THRESHOLD = -0.085
PRIOR = 20
CELLS = 1 << 20            # words of a Bloom filter of ids; fewer only leave more rows to the exact join
UNIT = 1_000_000
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def neighbours(h: str, step: int) -> Column:
    """Hashes of each entry with the one ``step`` later; empty if there is none."""
    m = F.size(h) - step
    return F.when(m > 0, F.zip_with(F.slice(h, F.lit(1), m), F.slice(h, F.lit(1 + step), m), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def repeats(h: str) -> Column:
    return F.size(F.array_distinct(h)) < F.size(h)


def hashed(docs: DataFrame) -> DataFrame:
    """Adds words, h (word hashes) and h2 (pair hashes)."""
    return (docs.withColumn("words", words_of(F.coalesce("text", F.lit(""))))
            .withColumn("h", F.transform("words", lambda x: F.xxhash64(x))).withColumn("h2", neighbours("h", 1)))


def mask(n: int) -> Column:
    """Four bits of a word for a doc_id, others for each n."""
    h = F.xxhash64("doc_id", F.lit(n))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def held(bits: str, n: int) -> Column:
    return F.coalesce(F.col(bits).bitwiseAND(mask(n)) == mask(n), F.lit(False))


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, cells: int = CELLS) -> list[int]:
    """The log ratio of each bucket, in 1/UNIT."""
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(cells))
    ids = stored(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "trusted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("cell", F.when(F.col("doc_id").isNotNull(), cell))
    first = stored(ids.groupBy(cell.alias("cell")).agg(F.bit_or(mask(1)).alias("in1")), "first")
    # at most ``cells`` pairs of numbers are broadcast: no text is shuffled
    wrong = rows.select("doc_id", "cell").join(F.broadcast(first), "cell").where(held("in1", 1)).select("doc_id", "cell").distinct().join(ids, "doc_id", "left_anti")
    second = wrong.groupBy("cell").agg(F.bit_or(mask(2)).alias("in2"))
    both = stored(first.join(second, "cell", "left"), "both")
    rows = rows.join(F.broadcast(both), "cell", "left")
    sure = rows.withColumn("good", F.when(held("in1", 1) & ~held("in2", 2), 1))
    doubtful = rows.where(held("in1", 1) & held("in2", 2)).select("doc_id", "text").join(ids, "doc_id", "left_semi")
    bucket = F.pmod("x", F.lit(buckets)).alias("bucket")
    counts = hashed(sure).select("good", F.explode(F.concat("h", "h2")).alias("x")).groupBy(bucket).agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    more = hashed(doubtful).select(F.explode(F.concat("h", "h2")).alias("x")).groupBy(bucket).agg(F.count("*").alias("target"))
    raw, target = [0] * buckets, [0] * buckets
    for b, r, t in counts.collect():              # at most ``buckets`` rows
        raw[b], target[b] = r, t
    for b, t in more.collect():
        target[b] += t
    share = sum(target) / max(1, sum(raw))
    return [round(UNIT * math.log((t + PRIOR) / (r * share + PRIOR))) for r, t in zip(raw, target)]


def repeated_words() -> Column:
    """Words inside a window of eight (hashes h8) that the text has more than once."""
    s = F.col("sorted")
    twin = lambda x, i: F.when(((i > 0) & (F.get(s, i - 1)["h8"] == x["h8"])) | (F.coalesce(F.get(s, i + 1)["h8"] == x["h8"], F.lit(False))), x["at"])
    places = F.array_sort(F.filter(F.transform(s, twin), lambda x: x.isNotNull()))
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("int").alias("end"))
    add = lambda a, p: F.struct((a["covered"] + (p + 8) - F.greatest(p, a["end"])).cast("long").alias("covered"), (p + 8).cast("int").alias("end"))
    return F.coalesce(F.aggregate(places, start, add)["covered"], F.lit(0).cast("long"))


def rated(docs: DataFrame, ratio: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every row."""
    buckets = len(ratio)
    table = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<bigint>")
    rows = hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    none = F.lit(None).cast("array<bigint>")
    rows = rows.withColumn("h4", F.when(repeats("h2"), neighbours("h2", 2)).otherwise(none))
    rows = rows.withColumn("h8", F.when(F.col("h4").isNotNull() & repeats("h4"), neighbours("h4", 4)).otherwise(none))
    rows = rows.withColumn("sorted", F.when(F.col("h8").isNotNull() & repeats("h8"), F.array_sort(F.arrays_zip("h8", F.sequence(F.lit(0), F.size("h8") - 1).alias("at")))))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    add = lambda a, x: a + F.get(table, F.pmod(x, F.lit(buckets)).cast("int"))      # noqa: E731
    total = F.aggregate("h2", F.aggregate("h", F.lit(0).cast("long"), add), add)
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), repeated_words().alias("n_repeat_words"), total.alias("total"), (F.size("h") + F.size("h2")).alias("n"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    score = F.when(F.col("n") > 0, F.col("total") / F.col("n") / UNIT)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       "n_repeat_words", failed.alias("base_failed"), (~failed & (score >= threshold)).alias("kept"), score.alias("score"))


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Verdicts on ``docs``; the texts labelled quality 1 are the trusted target."""
    return rated(docs, ratios(docs, labels.where("quality = 1"), buckets), threshold)
