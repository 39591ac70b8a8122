"""Language identification by error-correcting output codes (operator 8).

Every language has a codeword.  For each bit a binary classifier, the log-odds of
hashed byte n-grams between the languages whose bit is set and the others, says
how strongly a text leans.  Decoding sums a logistic loss over the bits for every
codeword, weighted by how sure the bit's classifier is, and takes the least.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Labelled rows per language that the classifiers are fitted on, at most: those
#: whose ids have the least hashes.
PER_LANGUAGE = 3_000
#: Orders of the n-grams, and hash buckets of each.
ORDERS, BUCKETS = (1, 2, 3), 1 << 13
#: Best and second language closer than this are ambiguous.
AMBIGUOUS = 0.9

_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def codewords(languages: int) -> np.ndarray:
    """(languages, bits) of 0 and 1: every split of the languages in two for up to
    seven of them, else the best of 200 random codes by least distance."""
    if languages < 3:
        return np.eye(languages, dtype=np.int8)[:, :1] if languages == 2 else np.ones((languages, 1), np.int8)
    if languages <= 7:
        columns = [(1, *c) for c in itertools.product((0, 1), repeat=languages - 1) if not all(c)]
        return np.array(columns, np.int8).T
    bits, rng = 15 * math.ceil(math.log2(languages)), random.Random(1)
    best, far = None, -1
    for _ in range(200):
        code = np.array([[rng.getrandbits(1) for _ in range(bits)] for _ in range(languages)], np.int8)
        code = code[:, (code.min(0) == 0) & (code.max(0) == 1)]
        least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if least > far:
            best, far = code, least
    return best


def features(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the lower-cased text's bytes."""
    b = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint32)
    found = []
    for i, order in enumerate(ORDERS):
        if len(b) < order:
            continue
        h = b[: len(b) - order + 1].copy()
        for j in range(1, order):
            h = h * np.uint32(0x01000193) ^ b[j : len(b) - order + 1 + j]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
        found.append(h.astype(np.int64) + i * BUCKETS)
    return np.bincount(np.concatenate(found), minlength=len(ORDERS) * BUCKETS)


def held_out(doc_id: str = "doc_id"):
    """Rows that no classifier may learn from; null ids are not among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            totals[lang] = totals.get(lang, 0) + features(text.as_py())
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "feature": at.astype(np.int32), "n": counts[at].astype(np.int64)})


class Model:
    """Languages, their codewords, and a weight per n-gram and bit."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        size = len(ORDERS) * BUCKETS
        if self.languages:
            share = np.stack([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * size) for x in self.languages])
            on = self.code.astype(float)
            p1 = on.T @ share / np.maximum(on.sum(0), 1)[:, None]
            p0 = (1 - on).T @ share / np.maximum((1 - on).sum(0), 1)[:, None]
            # One language alone has nothing on the other side.
            self.weights = (np.log(p1) - np.log(np.where(p0 > 0, p0, 1 / size))).T.astype(np.float32)
        self.signs = 2.0 * self.code - 1

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        f = features(text)
        at = np.flatnonzero(f)
        margin = f[at] @ self.weights[at]  # log-odds of each bit
        # Wider spread with length: evidence of n-grams that overlap counts by its root.
        margin = margin / math.sqrt(f[at].sum())
        sure = 1 - np.exp(-np.abs(margin))  # weight of a bit's loss
        loss = (sure * np.logaddexp(0, -self.signs * margin)).sum(1)
        chance = np.exp(-(loss - loss.min()))
        chance /= chance.sum()
        best = int(np.argmin(loss))
        score = float(chance[best])
        return self.languages[best], score, len(self.languages) > 1 and score < AMBIGUOUS


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """own_id, own_lang: of each language's rows that are not held out those whose ids
    have the least hashes, ``per_language`` of them at most.

    Hashes are spread evenly, so the least ones lie below a share of their range that
    follows from a language's number of rows: only those are sorted, whatever the
    size of a language.  Where too few lie below (ids that repeat), the share grows.
    """
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = ids.select(F.col("doc_id").alias("own_id"), F.col("lang").alias("own_lang"))
    ids = ids.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col("own_id").cast("string")), 2))
    sizes = common.stored(ids.groupBy("own_lang").agg(F.count("*").alias("size")), "languages")
    factor = 4.0
    while True:  # hashes are 62 bits wide
        share = F.least(F.lit(1.0), F.lit(factor * per_language) / F.col("size"))
        limits = sizes.select("own_lang", "size", F.floor(share * float(1 << 62)).alias("limit"))
        # A row per language.
        below = ids.join(F.broadcast(limits), "own_lang").where(F.col("h") <= F.col("limit"))
        rank = F.row_number().over(Window.partitionBy("own_lang").orderBy("h", "own_id"))
        chosen = common.stored(below.withColumn("rank", rank).where(F.col("rank") <= per_language).select("own_id", "own_lang", "size"), "sample")
        got = chosen.groupBy("own_lang").agg(F.count("*").alias("got"), F.min("size").alias("size"))
        if got.agg(F.count("*")).first()[0] == sizes.count() and got.where(F.col("got") < F.least(F.lit(per_language), "size")).isEmpty():
            return chosen.select("own_id", "own_lang").distinct()
        factor *= 16


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on at most ``per_language`` rows of each language that are not held out."""
    rows = docs.select("doc_id", "lang", "text")
    chosen = _sample(rows, per_language)
    # At most per_language rows of each language: bounded.
    rows = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("own_id")) & (F.col("lang") == F.col("own_lang")), "left_semi")
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    summed = rows.mapInArrow(_language_counts, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages x features rows, whatever the corpus
        counts.setdefault(r.lang, np.zeros(len(ORDERS) * BUCKETS, np.int64))[r.feature] = r.n
    return Model(counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), ambiguous, for every whole text.

    ``und`` with score 0 where a text is null or has no letter, or nothing could be
    learned.  Only the text is looked at; rows that repeat are judged alike; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.predict(t.as_py()) for t in batch.column(1)]
            yield common.to_batch(_PREDICTED, [batch.column(0), *(list(zip(*said)) or [[], [], []])])

    said = common.texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, by a model of those not held out."""
    docs = common.documents(spark, sf_dir)
    return identify(docs, fit(docs))
