"""SimHash near-duplicates by multi-index hashing (operator 9).

Fingerprints are cut into two segments of 32 bits.  Two that differ in at most
``radius`` = 2 bits agree in the low segment, or differ in at most one bit of the
high one: so each fingerprint looks up its low segment, and the Hamming ball of
radius 1 about its high segment, and complete distances are verified in the join.
All work is on distinct fingerprints: copies, however many, are one row of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SEED = 42
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FP = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 14


def majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the 64-bit hashes have."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[low : low + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of ``shingle`` words, repeats included."""
    words = _WORD.findall(text.encode().translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends, n = ends.tolist(), max(1, len(words) - shingle + 1)
    tops, digest = ends[min(shingle, len(words)) - 1 :], xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, tops)), np.uint64, n)
    return majority(hashes)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], schema=_FP)

    return run


def text_hash(column: str):
    """Tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("text_hash")


def simhash(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint of every whole text as a signed long.

    A-Z are lower-cased; words are runs without white space; fewer words than a
    shingle are one shingle; none, or a null text, is fingerprint 0.
    """
    rows = common.texts(docs).select("doc_id", text_hash("text"), "text")
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, text_hash long, fp long")


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """u, v: pairs of distinct fingerprints (column fp) that differ in at most
    ``radius`` (0 to 2) bits.  Every such pair is there at least once, so that a
    fingerprint has no more links than there are fingerprints within its ball."""
    if not 0 <= radius <= 2:
        raise ValueError("radius: 0, 1 or 2")
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    table = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("segment"), high.alias("value")), F.struct(F.lit(1).alias("segment"), low.alias("value")))).alias("s")).select("fp", "s.*")
    # Of two segments one bit apart, the one without that bit looks the other up.
    ball = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(high.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0, high.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))),
        lambda x: x.isNotNull(),
    )
    ball = F.transform(ball, lambda x: F.struct(F.lit(0).alias("segment"), x.alias("value"), F.lit(True).alias("near")))
    own = F.array(
        F.struct(F.lit(0).alias("segment"), high.alias("value"), F.lit(False).alias("near")),
        F.struct(F.lit(1).alias("segment"), low.alias("value"), F.lit(False).alias("near")),
    )
    probes = fps.select(F.col("fp").alias("other"), F.explode(F.concat(own, ball)).alias("s")).select("other", "s.*")
    met = (table["segment"] == probes["segment"]) & (table["value"] == probes["value"])
    close = (_distance("fp", "other") <= radius) & (F.col("near") | (F.col("fp") < F.col("other")))
    return table.join(probes, met & close).select(F.col("fp").alias("u"), F.col("other").alias("v"))


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id,
    and text_hash.

    component_id is the smallest doc_id among the documents reachable over links
    of at most ``radius`` differing bits, itself included (null ids are passed
    over unless there is no other).  Texts without words have fingerprint 0 and
    link like any other.  An empty table gives no rows; other columns are not read.
    """
    held = common.stored(simhash(docs, shingle), "fingerprints")
    least = common.stored(held.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "fingerprints")
    roots = components(links(least.select("fp"), radius))
    named = least.join(roots, least["fp"] == roots["node"])
    # Few rows: only fingerprints that have a link.
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(smallest, "root").select("node", "component")
    ids = least.join(linked, least["fp"] == linked["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id"), "rows")
    named = common.joined(held, common.stored(ids, "components"), ["fp"], "rows", F.struct("doc_id", "text_hash"))
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over all documents."""
    return near_groups(common.documents(spark, sf_dir))
