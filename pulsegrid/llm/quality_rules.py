"""Quality rules with DataFrame functions only (operator 2).

Base rules on words, symbols, repeated lines and repeated word windows, then a
hashed n-gram log-likelihood ratio: words and word pairs fall into ``buckets``
hash buckets; a bucket's weight is the log of its share in trusted documents over
its share in the raw corpus (both smoothed); a text's score is the mean weight of
its n-grams.  Counts of the raw corpus cover all documents.  The trusted side is a
bounded sample of the rows labelled good: ``trusted`` of them, those with the least
hashes.  The threshold is the score that all but ``miss`` of the other sound rows
labelled good reach, however many they are; where the sample would take more than
half of the rows labelled good, it takes half.  Weights are whole numbers, so that sums
do not depend on their order and every document is judged alike in every run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
#: Most labelled rows that the trusted side is fitted on.
TRUSTED = 10_000
#: Share of trusted documents that the threshold may reject.
MISS = 0.005
#: Whole-number steps of a weight to one nat.
SCALE = 1 << 16

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]"
#: Places of words fit in so many bits of a packed (hash, place).
_PLACE = 24


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(common.WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, the row itself, words and the base measures but the one on word windows."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.struct(*common.columns_of(docs)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.select("doc_id", "row", "text", words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(common.WHITE)) != "")
    return rows.select(
        "doc_id",
        "row",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )


def _with_repeats(df: DataFrame, window: int = 3) -> DataFrame:
    """Adds n_repeat_words: words in windows of three words found twice or more.

    Windows are sorted as (hash, place) packed into longs; equal neighbours repeat.
    Should two different windows of a text share a hash, or a text have more words
    than places fit, its windows are sorted by their words instead.
    """
    w, mask = F.col("words"), (1 << _PLACE) - 1
    places = F.when(F.size(w) < window, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(w) - window))
    packed = F.transform(
        places,
        lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _PLACE).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn("packed", F.sort_array(packed))
    s = F.col("packed")
    # Places in the sorted array whose hash is the next one's too.
    pairs = F.filter(
        F.when(F.size(s) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(s) - 2)),
        lambda j: F.shiftrightunsigned(F.get(s, j).bitwiseXOR(F.get(s, j + 1)), _PLACE) == 0,
    )
    at = lambda j: F.get(s, j).bitwiseAND(F.lit(mask)).cast("int")
    df = df.withColumn("twice", F.transform(pairs, lambda j: F.struct(at(j).alias("a"), at(j + 1).alias("b")))).drop("packed")
    t = F.col("twice")
    text_of = lambda i: F.array(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    mixed = F.exists(t, lambda x: text_of(x["a"]) != text_of(x["b"]))
    covered = lambda starts: F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    by_words = F.sort_array(F.transform(places, lambda i: F.struct(text_of(i).alias("of"), i.alias("at"))))
    next_too = lambda v: F.filter(F.sequence(F.lit(0), F.size(v) - 2), lambda j: F.get(v, j)["of"] == F.get(v, j + 1)["of"])
    # One element each, so that what the lambda is given is computed once.
    compared = F.flatten(F.transform(F.array(by_words), lambda v: F.flatten(F.transform(next_too(v), lambda j: F.array(F.get(v, j)["at"], F.get(v, j + 1)["at"])))))
    too_long = F.size(w) > mask
    repeats = F.when((F.size(t) == 0) & ~too_long, F.lit(0)).when(too_long | mixed, covered(compared)).otherwise(covered(F.concat(t["a"], t["b"])))
    return df.withColumn("n_repeat_words", repeats.cast("long")).drop("twice")


def _fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _counts(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, raw, good: n-grams of all rows (words, good) and of those marked good."""
    grams = rows.select("good", F.explode(_gram_buckets(F.col("words"), buckets)).alias("bucket"))
    return grams.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("good"))


def _gram_buckets(w: Column, buckets: int) -> Column:
    """Buckets of every word and every pair of neighbours (the first word's: null)."""
    single = F.transform(w, lambda x: _bucket(F.xxhash64(x), buckets))
    return F.concat(single, F.transform(w, lambda x, i: F.when(i > 0, _bucket(F.xxhash64(F.get(w, i - 1), x), buckets))))


def trusted_ids(labels: DataFrame, trusted: int = TRUSTED) -> tuple[DataFrame, DataFrame]:
    """(good_id of the sample to count, good_id of the others): rows labelled good
    (quality 1).  The sample are the ids with the least hashes, ``trusted`` of them
    or half of all."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    good = common.stored(good.withColumn("h", F.xxhash64(F.col("good_id").cast("string"))), "good")
    sample = common.stored(good.orderBy("h", "good_id").limit(min(trusted, -(-good.count() // 2))), "trusted")
    last = sample.agg(F.max(F.struct("h", "good_id")).alias("last")).first().last
    rest = good if last is None else good.where(F.struct("h", "good_id") > F.struct(F.lit(last.h).alias("h"), F.lit(last.good_id).alias("good_id")))
    return sample.select("good_id"), rest.select("good_id")


def fit_weights(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A weight per bucket, as whole numbers of 1 / SCALE nats.  One pass over all
    documents; what reaches the driver is one row per bucket."""
    # The sample is bounded by ``trusted``.
    rows = common.texts(docs).join(F.broadcast(sample.withColumn("good", F.lit(True))), F.col("doc_id") == F.col("good_id"), "left")
    rows = rows.select(words_of(F.col("text")).alias("words"), F.coalesce("good", F.lit(False)).alias("good"))
    found = _counts(rows, buckets).collect()
    raw_all, good_all = sum(r.raw for r in found), sum(r.good for r in found)
    raw, good = {r.bucket: r.raw for r in found}, {r.bucket: r.good for r in found}
    share = lambda n, all_: (n + 1) / (all_ + buckets)
    return [round(math.log(share(good.get(b, 0), good_all) / share(raw.get(b, 0), raw_all)) * SCALE) for b in range(buckets)]


def _scored(df: DataFrame, weights: list[int]) -> DataFrame:
    """Adds llr (long): the mean weight of a text's n-grams; null without words."""
    buckets = len(weights)
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    w = F.col("words")
    of = lambda *x: F.get(table, _bucket(F.xxhash64(*x), buckets))
    each = F.transform(w, lambda x, i: of(x) + F.when(i > 0, of(F.get(w, i - 1), x)).otherwise(F.lit(0)))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("llr", F.when(F.size(w) > 0, F.floor(total / (2 * F.size(w) - 1))))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, miss: float = MISS, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, llr (nats per n-gram) and threshold; with
    ``carry`` also ``row``, a struct of the document's own columns.

    A null or empty text has no words and fails the base rules.  ``labels`` has
    doc_id and quality; rows without an id or label count for nothing, and without
    any trusted row only the base rules judge.  Rows that repeat are judged alike;
    an empty table gives no rows; other columns are not read.
    """
    sample, rest = trusted_ids(labels, trusted)
    weights = fit_weights(docs, sample, buckets)
    columns = [
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", _fails(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), "llr",
        *(["row"] if carry else []),
    ]
    # One struct a row, so that no filter is pushed into the measures; written once, as
    # the threshold is read from all of them.
    measured = _scored(_with_repeats(_measured(docs)), weights).select(F.explode(F.array(F.struct(*columns))).alias("_")).select("_.*")
    measured = common.stored(measured, "measured")
    sound = measured.where("NOT base_failed").select("doc_id", "llr").join(rest, F.col("doc_id") == F.col("good_id"), "left_semi")
    # Exact, over whole numbers of 1 / SCALE: what is held are the distinct ones.
    threshold = sound.agg(F.percentile("llr", F.lit(miss))).first()[0]
    passes = F.col("llr") >= F.lit(threshold) if threshold is not None else F.lit(True)
    return measured.select(
        *measured.columns[:7], (~F.col("base_failed") & passes).alias("kept"), (F.col("llr") / SCALE).alias("llr"),
        F.lit(None if threshold is None else threshold / SCALE).cast("double").alias("threshold"), *(["row"] if carry else []),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, trusted rows from labels."""
    return quality_rules(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
