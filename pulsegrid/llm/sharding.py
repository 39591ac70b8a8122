"""Sharding by proportional stratified interleaving (operator 11).

1. Rows are put in a seeded random order within their stratum (source); a row's rank
   there, divided by the stratum's rows, is its fractional rank.
2. All rows are sorted by fractional rank.  Any stretch of that order holds each
   stratum in its share of the table, to within a row or so at either end.
3. The order is cut into shards whose row counts differ by one at most.

Both orders are dealt out by ranges (``numbering``), so a stratum of any size is
spread over tasks; only narrow rows are moved, texts stay where they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .numbering import numbered

SHARDS, SEED = 40, 1
#: What each row takes besides its text's bytes.
ROW_BYTES = 16


def _measured(docs: DataFrame, stratum: str | None, seed: int, keep: list[str]) -> DataFrame:
    text, label = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col(f"`{stratum}`").cast("string") if stratum else F.lit("")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(label, F.lit("")).alias("stratum"),
        label.isNull().alias("unnamed"),
        *keep,
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_crc32", "size"))
    return rows.withColumn("key", key)


def interleaved(docs: DataFrame, shards: int = SHARDS, stratum: str | None = "source", seed: int = SEED, keep: list[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot and ``keep``.

    Shards are numbered from 0 and differ by one row at most; slots count from 0 in
    each.  A null text counts as empty, a null stratum is one of its own (not the
    empty one), without ``stratum`` all rows are one.  Null ids and rows that repeat
    are documents of their own; rows alike in stratum, id, size and checksum may
    trade places.  An empty table gives no rows, fewer rows than shards leave some
    shards empty.  Other columns are not read.
    """
    keep = list(keep)
    ties = ["key", "doc_id", "size", "text_crc32", *keep]
    shuffled = numbered(_measured(docs, stratum, seed, keep), ["stratum", "unnamed", *ties], "place", "shuffled")
    strata = shuffled.groupBy("stratum", "unnamed").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    strata = common.stored(strata.withColumn("of", F.col("n").cast("double")), "strata")
    ranked = common.joined(shuffled, strata, ["stratum", "unnamed"], "n", F.col("place"))
    share = ((F.col("place") - F.col("first")) + F.lit(0.5)) / F.col("of")
    order = numbered(ranked.select(share.alias("share"), *ties), ["share", *ties], "place", "interleaved")
    total = order.count()
    cut = order.withColumn("shard", F.expr(f"place * {int(shards)} div {max(total, 1)}"))
    slot = F.expr(f"place - (shard * {total} + {int(shards) - 1}) div {int(shards)}")  # from the shard's first place
    return cut.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), slot.alias("slot"), *keep)


def _located(docs: DataFrame, file: str, at: str) -> DataFrame:
    """``docs`` with each row's place: its file (a hash) and row there.  What does
    not come straight from Parquet files is written to some first."""
    place = [F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)]
    if "_metadata" not in docs.columns:
        try:
            found = docs.select("*", *place)
            found.schema
            return found
        except AnalysisException:  # no such columns: not a plain scan
            pass
    return common.stored(docs, "rows").select("*", *place)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, stratum: str | None = "source", seed: int = SEED) -> DataFrame:
    """The shards themselves: all columns of ``docs`` and slot as Parquet in
    ``path``/shard=0, ..., each folder in the order of its slots (file by file);
    read again.  Columns of ``docs`` named shard or slot give way."""
    file, at = common.own_name("file"), common.own_name("at")
    rows = _located(docs.drop("shard", "slot"), file, at)
    places = interleaved(rows, shards, stratum, seed, [file, at]).select(file, at, "shard", "slot")
    met = rows.join(places, [file, at]).drop(file, at)
    met.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards with the mixture of sources of the whole table;
    the law that holds is ``rows``."""
    return interleaved(common.documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The checksum is worked out byte by byte from the table of CRC-32.
OP11_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step
), texts AS (
  SELECT doc_id, source, strlen(t) + 16 AS size,
         list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)
), sums AS (
  SELECT doc_id, coalesce(source, '') AS stratum, source IS NULL AS unnamed, size,
         xor(list_reduce(bytes, lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM texts, crc
), keyed AS (
  SELECT *, md5(concat_ws(':', '1', coalesce(doc_id::VARCHAR, '-'), text_crc32, size)) AS key FROM sums
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum, unnamed ORDER BY key, doc_id, size, text_crc32) - 0.5::DOUBLE) / (count(*) OVER (PARTITION BY stratum, unnamed))::DOUBLE AS share
  FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY share, key, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 40 // total)::INT AS shard,
       place - (place * 40 // total * total + 39) // 40 AS slot, NULL::INT AS grown_shard
FROM placed
"""
