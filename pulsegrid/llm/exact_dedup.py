"""Exact dedup by an exchange of Golomb-coded fingerprints (operator 7).

1. Each part of the input sorts the fingerprints of its rows and sends every
   owner (a range of the fingerprint space) its share as Rice-coded gaps.  The rows'
   places (file and row in it) stay with the part.
2. An owner merges the lists it gets and answers each part with a bitmap of the
   fingerprints that another row has too.  The part turns it into bitmaps of its
   rows: a bit for every row of a file, MAP_ROWS to a bitmap.
3. Only rows whose bit is set, the suspects, are grouped by their whole texts;
   equal texts meet in the map-side combine, so that a group of copies of any size
   reaches a reducer as one row per task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of a fingerprint; a false match costs one more suspect, never a wrong result.
BITS = 56
#: Rows of a bitmap (fixed: Spark's own bitmaps have 4 KB), and bitmaps that are
#: broadcast at once (64 MB); where there are more, files are taken in groups.
MAP_ROWS, MAPS = 1 << 15, 1 << 14

LISTS = "owner int, part int, n int, twice binary, coded binary, counts binary, places binary"
_LISTS = pa.schema(
    [("owner", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("twice", pa.binary()), ("coded", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())]
)
_ANSWERS = pa.schema([("owner", pa.int32()), ("part", pa.int32()), ("marks", pa.binary())])
_SUSPECTS = pa.schema([("file", pa.int64()), ("at", pa.int64())])


def rice_parameter(n: int, span: int) -> int:
    """Bits of the remainder for ``n`` sorted values below ``span``."""
    return max(0, (span // max(n, 1)).bit_length() - 1)


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct values below ``span`` as Rice-coded gaps."""
    if not len(values):
        return b""
    k = rice_parameter(len(values), span)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1 + k)  # a gap: quotient ones, a zero, k bits
    bits = np.ones(int(ends[-1]), np.uint8)
    heads = ends - k - 1
    bits[heads] = 0
    for j in range(k):
        bits[heads + 1 + j] = (gaps >> np.uint64(j)).astype(np.uint8) & 1
    return np.packbits(bits).tobytes()


def golomb_decode(coded: bytes, n: int, span: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    k = rice_parameter(n, span)
    bits = np.unpackbits(np.frombuffer(coded, np.uint8))
    zeros = np.flatnonzero(bits == 0)
    heads = np.empty(n, np.int64)
    at, i, places = 0, 0, zeros.tolist()
    for j in range(n):  # the next zero at or after the gap's start ends its quotient
        while places[i] < at:
            i += 1
        heads[j] = places[i]
        at = places[i] + 1 + k
    starts = np.concatenate(([0], heads[:-1] + 1 + k))
    gaps = (heads - starts).astype(np.uint64) << np.uint64(k)
    for j in range(k):
        gaps |= bits[heads + 1 + j].astype(np.uint64) << np.uint64(j)
    return np.cumsum(gaps, dtype=np.uint64)


def _send(owners: int, bits: int):
    span = -(-(1 << bits) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [np.stack([b.column(i).to_numpy() for i in range(3)]) for b in batches if b.num_rows]
        if not held:
            return
        rows_of = np.concatenate(held, axis=1)
        rows_of = rows_of[:, np.argsort(rows_of[0], kind="stable")]
        values, counts = np.unique(rows_of[0].astype(np.uint64), return_counts=True)
        ends = np.concatenate(([0], np.cumsum(counts)))
        places = np.ascontiguousarray(rows_of[1:].T, "<i8")
        owner = (values // np.uint64(span)).astype(np.int64)
        edges = np.flatnonzero(np.diff(owner)) + 1
        rows = []
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(values)]):
            own = int(owner[low])
            coded = golomb_encode(values[low:high] - np.uint64(own * span), span)
            kept = counts[low:high].astype("<i4").tobytes(), places[ends[low] : ends[high]].tobytes()
            rows.append((own, part, high - low, np.packbits(counts[low:high] > 1).tobytes(), coded, *kept))
        yield common.to_batch(_LISTS, list(zip(*rows)))

    return run


def _answer(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.in_runs(batches, "owner"):
            rows = table.to_pylist()
            lists = [golomb_decode(r["coded"], r["n"], span) for r in rows]
            twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["n"]) for r in rows]
            values, where = np.unique(np.concatenate(lists), return_inverse=True)
            marked = np.bincount(where, weights=np.concatenate(twice) + 1) > 1
            ends = np.cumsum([len(x) for x in lists]).tolist()
            marks = [np.packbits(marked[where[e - len(x) : e]]).tobytes() for e, x in zip(ends, lists)]
            yield common.to_batch(_ANSWERS, [[r["owner"] for r in rows], [r["part"] for r in rows], marks])

    return run


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the rows that the answers mark."""
    for batch in batches:
        for r in batch.to_pylist():
            marks = np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=r["n"]).astype(bool)
            if marks.any():
                own = np.frombuffer(r["places"], "<i8").reshape(-1, 2)[np.repeat(marks, np.frombuffer(r["counts"], "<i4"))]
                yield common.to_batch(_SUSPECTS, [own[:, 0].copy(), own[:, 1].copy()])


def suspects(rows: DataFrame, bits: int = BITS, owners: int | None = None) -> DataFrame:
    """file, chunk, marked: bitmaps of the rows whose fingerprint another row has too.

    ``rows`` has fp (below 2 ** ``bits``), file and at, all long.  What a part holds is
    its own split of the input; an owner holds its share of all fingerprints.
    """
    spark = rows.sparkSession
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = -(-(1 << bits) // owners)
    lists = common.stored(rows.select("fp", "file", "at").mapInArrow(_send(owners, bits), LISTS), "lists")
    sent = lists.select("owner", "part", "n", "twice", "coded")
    answers = sent.repartition(owners, "owner").sortWithinPartitions("owner").mapInArrow(_answer(span), "owner int, part int, marks binary")
    places = lists.join(answers, ["owner", "part"]).select("n", "marks", "counts", "places").mapInArrow(_received, "file long, at long")
    chunk, bit = F.floor(F.col("at") / MAP_ROWS).alias("chunk"), F.pmod("at", F.lit(MAP_ROWS))
    return places.groupBy("file", chunk).agg(F.bitmap_construct_agg(bit).alias("marked"))


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, file (a hash) and at (row of the file).  What does not come
    straight from Parquet files is written to some first."""
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    rows = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    if "_metadata" not in docs.columns:
        try:
            found = docs.select(*rows, *place)
            found.schema
            return found
        except AnalysisException:  # no such columns: not a plain scan
            pass
    return common.stored(common.texts(docs), "texts").select("doc_id", "text", *place)


def _marked_texts(placed: DataFrame, maps: DataFrame, most: int) -> DataFrame:
    """doc_id and text of the rows whose bit is set.  Files are taken in groups whose
    bitmaps may be broadcast; each group reads its own files alone."""
    groups = max(1, -(-maps.count() // most))
    byte = "cast(conv(hex(substring(marked, cast(pmod(at, {0}) div 8 as int) + 1, 1)), 16, 10) as int)".format(MAP_ROWS)
    is_set = F.expr(f"shiftright({byte}, cast(at % 8 as int)) & 1 = 1")
    found = []
    for g in range(groups):
        mine = F.pmod("file", F.lit(groups)) == g
        rows = placed.where(mine).withColumn("chunk", F.floor(F.col("at") / MAP_ROWS))
        found.append(rows.join(F.broadcast(maps.where(mine)), ["file", "chunk"]).where(is_set).select("doc_id", "text"))
    return functools.reduce(DataFrame.unionByName, found)


def exact_groups(docs: DataFrame, bits: int = BITS, most: int = MAPS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty.  Of equal
    texts the row with the largest doc_id stays (null ids are smaller than any).
    Rows that repeat an id and text cannot be told apart: they share the result.
    An empty table gives no rows; other columns are not read.
    """
    placed = _placed(docs)
    fp = F.shiftrightunsigned(F.xxhash64("text"), 64 - bits).alias("fp")
    keyed = common.stored(placed.select("doc_id", F.sha2("text", 256).alias("text_sha256"), fp, "file", "at"), "fingerprints")
    maps = common.stored(suspects(keyed, bits), "suspects")
    # Bytes are compared here: the grouping key is the whole text.
    verified = (
        _marked_texts(placed, maps, most)
        .groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size", F.col("group_size").alias("rows"))
    )
    digests = keyed.select("doc_id", "text_sha256")
    joined = common.joined(digests, common.stored(verified, "groups"), ["text_sha256"], "rows", F.col("doc_id"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_groups(common.documents(spark, sf_dir))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
