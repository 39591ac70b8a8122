"""A training corpus from documents: quality, exact and near dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
``run`` writes every stage as Parquet in the shared folder and reads it again, so a
lost executor never costs more than one stage.  All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import common, exact_dedup, packing, quality_rules, secret_scan, shingle_dedup, simhash_dedup


def _keep(docs: DataFrame, judged: DataFrame, digest: Column) -> DataFrame:
    """One row of ``docs`` for each id (null: as a value) and text digest that ``judged``
    (doc_id, digest, rows, kept) keeps: of rows that share both, the least by its columns (maps, which have no order, as JSON).

    What goes or is there more than once is less than what stays as it is, so only that
    meets the rows; it is broadcast if it is small by its count."""
    i, d, row, mark = (common.own_name(x) for x in ("id", "digest", "row", "shared"))
    marks = judged.toDF(i, d, "rows", "kept").withColumn(i, F.coalesce(i, F.lit(common.NO_ID))).where("NOT kept OR rows > 1")
    marks = common.stored(marks.select(i, d, F.col("kept").alias(mark)), "marks")
    own = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NO_ID)), d: digest})
    met = own.join(common.small(marks), [i, d], "left")
    columns = common.columns_of(docs)
    single = met.where(F.col(mark).isNull()).select(*columns)
    if marks.where(mark).isEmpty():
        return single
    order = F.struct(*[F.to_json(c) if "map<" in t else c for c, (_, t) in zip(columns, docs.dtypes)])
    least = met.where(mark).groupBy(i, d).agg(F.min_by(F.struct(*columns), order).alias(row))
    return single.unionByName(least.select(f"{row}.*"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.quality_rules(docs, labels, carry=True).where("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    groups = exact_dedup.exact_groups(docs).where("group_size > 1")
    judged = groups.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"), F.first("kept").alias("kept"))
    return _keep(docs, judged, F.sha2(F.coalesce("text", F.lit("")), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 80 % of their five-word shingles, the
    document with the smallest doc_id."""
    return _keep(docs, shingle_dedup.near_rows(docs), simhash_dedup.text_hash("text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets cut from their texts."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 ids."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("pack", pack)]

#: Hashed weights, min-hashes and the randomness battery are not SQL: tests compare
#: the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is the last one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
