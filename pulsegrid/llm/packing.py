"""Packing of documents into sequences by their length histogram (operator 6).

Shortest-pack-first: the histogram of piece lengths, at most ``size`` numbers
whatever the corpus, is packed on the driver, longest lengths first, each onto
the pack that is shortest so far.  The result is a list of packing patterns with
counts; the slots of the patterns are then joined back to the pieces by length
and rank, which is a broadcast of a table whose size depends on ``size`` alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())]
)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long, ids binary"


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths of one pack) for a histogram of lengths from 1 to ``size``.

    Lengths are placed longest first.  A length goes onto the shortest packs that
    are open, as many at once as there are packs of that pattern, and opens packs
    of its own only when none has room.
    """
    open_packs: dict[int, list[list]] = {}  # room left -> [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_packs, default=0)
            if room < length:
                open_packs.setdefault(size - length, []).append([left, (length,)])
                break
            packs = open_packs[room]
            count, lengths = packs[-1]
            used = min(left, count)
            packs[-1][0] -= used
            if not packs[-1][0]:
                packs.pop()
                if not packs:
                    del open_packs[room]
            open_packs.setdefault(room - length, []).append([used, (*lengths, length)])
            left -= used
    merged: dict[tuple[int, ...], int] = {}
    for packs in open_packs.values():
        for count, lengths in packs:
            merged[lengths] = merged.get(lengths, 0) + count
    return [(count, lengths) for lengths, count in sorted(merged.items(), reverse=True)]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): pieces of
    that length with such ranks go to that sequence and the ones after it in turn."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, rank + count, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return rows


#: Ids that a worker holds as pieces before it hands them on.
HELD_IDS = 1 << 20


def _pieces(name: str, end_id: int, size: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(name), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    n = len(piece) // 4
                    rows.append((doc_id, start, n, zlib.crc32(piece), total, part, seen[n], piece if keep_ids else None))
                    seen[n] += 1
                held += total
                if held >= HELD_IDS:
                    yield common.to_batch(_PIECES, list(zip(*rows)))
                    rows, held = [], 0
            yield common.to_batch(_PIECES, list(zip(*rows)) or [[]] * len(_PIECES))

    return run


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, size: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and its ids (packed little-endian 32-bit) where ``keep_ids``.

    A document is its ids and ``end_id``; longer ones are cut every ``size`` ids.
    Sequences are numbered from 0 without gaps.  Null or empty texts are the end id
    alone; null doc_ids and rows that repeat are documents of their own; an empty
    table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    cut = common.texts(docs).mapInArrow(_pieces(tokenizer, end_id, size, keep_ids), PIECES)
    pieces = common.stored(cut if keep_ids else cut.drop("ids"), "pieces")

    # Ranks of equal lengths: how many the parts before have, and the place in the part.
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.select(
        "part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    table = spark.createDataFrame(
        slots(shortest_pack_first(histogram, size)) or [(0, 0, 0, 0, 0)], "slot_length long, low long, high long, sequence long, offset long"
    )
    rank = F.col("before") + F.col("nth")
    placed = (
        pieces.join(before, ["part", "length"])
        .withColumn("rank", rank)
        .join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    )
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset",
        *(["ids"] if keep_ids else []),
    )


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (packed), lengths: the sequences themselves, from pieces
    with ``keep_ids``; at most one sequence's ids meet in a row."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id",
        F.expr("aggregate(held, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"),
        F.col("held.length").alias("lengths"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, packed into sequences of at most 2,048 ids."""
    return pack_documents(common.documents(spark, sf_dir))
