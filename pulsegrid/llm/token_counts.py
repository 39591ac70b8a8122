"""Token-count rollups that are maintained by deltas (operator 4).

A batch is a set of signed changes: an insert counts a document and its tokens, a
delete takes both away, a revision does both at once for the old and the new count
(or tokenizer).  Each batch is summed to one row per source, language and tokenizer
version, and committed as a folder named by its batch id.  A folder counts once its
``_SUCCESS`` is there, so that a batch that is sent again, or was cut short, changes
nothing or is written anew.  Totals are kept beside the batches and read with those
committed since.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

KEYS = ("source", "lang", "version")
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"
_COUNTS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("digest", pa.binary()), ("old_tokens", pa.int64()), ("new_tokens", pa.int64())])


def _counted(old: str, new: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokens.encoder(old), tokens.encoder(new)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            counts = [len(first(t)) // 4 for t in texts], [len(second(t)) // 4 for t in texts]
            yield common.to_batch(_COUNTS, [*(batch.column(c) for c in ("doc_id", "source", "lang", "digest")), *counts])

    return run


def count_tokens(docs: DataFrame, old: str, new: str) -> DataFrame:
    """doc_id, source, lang, SHA-256 of the text, and its tokens by two vocabularies."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    return rows.mapInArrow(_counted(old, new), "doc_id long, source string, lang string, digest binary, old_tokens long, new_tokens long")


def changes(rows: DataFrame, version: str, tokens_of: str, sign: int) -> DataFrame:
    """Signed changes that count (1) or take away (-1) ``rows`` under a version."""
    return rows.select(
        "source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("n_docs"), (sign * F.col(tokens_of)).alias("n_tokens")
    )


class Rollup:
    """Committed batches of deltas, and totals kept up with them, in a folder of any
    store that Spark reads.

    ``compact`` adds the batches since the last totals to them and writes the sums as
    the next ``totals=N``, with the ids of all batches in it under ``covers=N``.  Either
    folder counts once it has its ``_SUCCESS``; ``covers`` is written last and makes the
    totals valid, so that a lost attempt changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, kind: str) -> list[str]:
        """Committed folders of a kind, listed from the store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = store.globStatus(path(f"{self.path}/{kind}=*/_SUCCESS")) or []
        return sorted(f.getPath().getParent().getName().split("=", 1)[1] for f in found)

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Commits a batch of changes; False, and nothing changes, if its id has
        been committed before.  What an unfinished attempt left is overwritten."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError("a batch id is of letters, digits, '_', '.' and '-'")
        if batch_id in self._names("batch"):
            return False
        _summed(batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Number of the last totals (0: none), batches in them, and batches since."""
        last = max(map(int, self._names("covers")), default=0)
        held = [r.id for r in self.spark.read.schema("id string").parquet(f"{self.path}/covers={last}").collect()] if last else []
        return last, sorted(held), sorted({*self._names("batch")} - {*held})

    def _sums(self, last: int, since: list[str]) -> DataFrame:
        folders = [*([f"{self.path}/totals={last}"] if last else []), *(f"{self.path}/batch={b}" for b in since)]
        return _summed(self.spark.read.schema(DELTAS).parquet(*folders) if folders else self.spark.createDataFrame([], DELTAS))

    def compact(self) -> bool:
        """Brings the totals up to date; False if no batch has come since."""
        last, held, since = self._state()
        if not since:
            return False
        self._sums(last, since).where("n_docs != 0 or n_tokens != 0").write.mode("overwrite").parquet(f"{self.path}/totals={last + 1}")
        ids = self.spark.createDataFrame([(b,) for b in held + since], "id string")
        ids.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/covers={last + 1}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens: the last totals and the batches
        since; groups that have come down to nothing are left out.  Null keys are a
        group of their own."""
        last, _, since = self._state()
        return self._sums(last, since).where("n_docs != 0 or n_tokens != 0")


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def maintained_counts(docs: DataFrame, old: str = "byte_bpe_50k.json", new: str = "word_bpe_49k.json") -> DataFrame:
    """Totals by source, language and tokenizer version after three batches: every
    document is inserted under ``old``; copies of a text but the one with the
    largest doc_id are deleted; the rest are revised to ``new``, except that texts
    ``new`` does not shorten keep their count under ``old``.  Each batch is sent
    twice, as after a lost answer, and counts once; the totals are brought up to date
    after the second, and the third is added to them.

    Null or empty texts have no tokens but count as documents.  Rows that repeat an
    id and text count as often as they are there and stay together; an empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    counted = common.stored(count_tokens(docs, old, new), "counted")
    # Copies are told by their SHA-256.
    largest = common.stored(counted.groupBy("digest").agg(F.max("doc_id").alias("largest"), F.count("*").alias("rows")), "largest")
    marked = common.joined(counted, largest, ["digest"], "rows", F.struct("doc_id", "source", "lang"))
    stays = F.col("doc_id").eqNullSafe(F.col("largest"))
    shorter = stays & (F.col("new_tokens") < F.col("old_tokens"))
    batches = {
        "1-insert": changes(counted, old, "old_tokens", 1),
        "2-delete": changes(marked.where(~stays), old, "old_tokens", -1),
        "3-revise": changes(marked.where(shorter), old, "old_tokens", -1).unionByName(changes(marked.where(shorter), new, "new_tokens", 1)),
    }
    rollup = Rollup(spark, common.scratch(spark, "rollup"))
    for batch_id, batch in batches.items():
        for _ in range(2):
            rollup.commit(batch_id, batch)
        if batch_id == "2-delete":
            rollup.compact()
    return rollup.totals()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return maintained_counts(common.documents(spark, sf_dir))
