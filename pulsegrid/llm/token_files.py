"""Token ids in files of fixed-width packed bits (operator 3).

File format.  A dataset is a folder of shards; a shard holds the ids of a range
of doc_ids, shards and documents ascending.  The container of a shard is Parquet,
so that Spark's committers write it to any store and a lost executor's half file
never counts.  Each row of it is a block of whole documents:

    shard, block   place of the block
    first          ids before the block within its shard
    n_ids, width   ids in the block, bits of each
    doc_ids, n_tokens   the documents of the block in order, and ids of each
    payload        the ids, ``width`` bits each, least significant bit first

``width`` is the least number of bits that holds every id of the vocabulary.  The
i-th id starts at bit ``i * width`` of the payload, so any range can be unpacked
alone (``unpack_ids``), and ``n_tokens`` gives the documents' offsets.  The folder
``_offsets`` holds a row per block: start and end of its ids in the whole dataset.
"""

from __future__ import annotations

import functools
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

#: A block is closed once it has this many ids; a longer document has its own.
BLOCK_IDS = 1 << 16

BLOCKS = "shard int, block int, first long, n_ids long, width int, doc_ids array<long>, n_tokens array<long>, payload binary"
_BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary())]
)
_READ = pa.schema(
    [("shard", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def id_width(vocabulary: int) -> int:
    """Bits that hold the ids 0 to ``vocabulary`` - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_ids(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """The ids ``start`` to ``start + count`` - 1 of a block; reads only their bytes."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, start * width // 8).astype("<u4")
    bit = start * width
    held = np.frombuffer(payload, np.uint8)[bit // 8 : -(-(bit + count * width) // 8)]
    bits = np.zeros((count, 32), np.uint8)
    bits[:, :width] = np.unpackbits(held, bitorder="little")[bit % 8 :][: count * width].reshape(count, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def _blocks(name: str, end_id: int, width: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(name), np.array([end_id], "<u4").tobytes()
        shard, block, first, size = TaskContext.get().partitionId(), 0, 0, 0
        docs: list = []
        counts: list[int] = []
        held: list[bytes] = []

        def closed():
            ids = np.frombuffer(b"".join(held), "<u4")
            return common.to_batch(_BLOCKS, [[shard], [block], [first], [size], [width], [docs], [counts], [pack_ids(ids, width)]])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                docs.append(doc_id)
                counts.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= block_ids:
                    yield closed()
                    block, first, size, docs, counts, held = block + 1, first + size, 0, [], [], []
        if docs:
            yield closed()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of every document, ``end_id`` after each, to ``path``.

    Documents are in ascending doc_id order, null ids first, ties by a hash of the
    text and the text; rows with one doc_id are documents of their own.  A null
    text is empty: its document is the end id alone.  Other columns are not read.
    """
    width = id_width(max(tokens.library(tokenizer).get_vocab_size(), end_id + 1))
    rows = common.texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ordered.select("doc_id", "text").mapInArrow(_blocks(tokenizer, end_id, width, block_ids), BLOCKS).write.parquet(path)
    _write_offsets(docs.sparkSession, path)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_ids(row["payload"], row["width"], 0, row["n_ids"])
            ends = np.cumsum(row["n_tokens"])
            crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), row["n_tokens"])]
            yield common.to_batch(_READ, [[row["shard"]] * len(ends), row["doc_ids"], row["first"] + ends - row["n_tokens"], row["n_tokens"], crcs])


def _shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard: one row per file, so the ordered sum is small."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    return totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shard_start"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    read = blocks.select("shard", "first", "n_ids", "width", "doc_ids", "n_tokens", "payload").mapInArrow(
        _unpacked, "shard int, doc_id long, first long, n_tokens long, ids_crc32 long"
    )
    return read.join(_shard_starts(blocks), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def _write_offsets(spark: SparkSession, path: str) -> None:
    """The place of every block in the whole dataset, in a small table beside the
    shards (readers of the shards pass over names that begin with '_')."""
    blocks = spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "first", "n_ids")
    start = F.col("shard_start") + F.col("first")
    placed = blocks.join(_shard_starts(blocks), "shard").select(start.alias("start"), (start + F.col("n_ids")).alias("end"), "shard", "block")
    placed.sortWithinPartitions("start").write.parquet(f"{path}/_offsets")


def read_id_range(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` - 1 of the whole dataset: random access by
    the offsets, which reads only the blocks that hold them.  ``count`` bounds the
    result, and so what is collected."""
    offsets = spark.read.schema("start long, end long, shard int, block int").parquet(f"{path}/_offsets")
    places = offsets.where((F.col("start") < start + count) & (F.col("end") > start)).collect()
    if not places:
        return np.zeros(0, "<u4")
    begins = {(r.shard, r.block): r.start for r in places}
    blocks = spark.read.schema(BLOCKS).parquet(path)
    of = {s: [r.block for r in places if r.shard == s] for s in {r.shard for r in places}}  # runs of blocks
    wanted = functools.reduce(operator.or_, [(F.col("shard") == s) & F.col("block").between(min(own), max(own)) for s, own in of.items()])
    parts = {}
    for r in blocks.where(wanted).select("shard", "block", "n_ids", "width", "payload").toLocalIterator():
        at = begins[r.shard, r.block]
        low = max(0, start - at)
        parts[at] = unpack_ids(r.payload, r.width, low, min(r.n_ids, start + count - at) - low)
    return np.concatenate([parts[at] for at in sorted(parts)])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, written in the file format and read back."""
    path = common.scratch(spark, "token-files")
    write_token_files(common.documents(spark, sf_dir), path)
    return read_token_files(spark, path)
