"""Near-duplicates at a Jaccard similarity of 0.8 (the pipeline's near stage).

Two texts are near when the Jaccard similarity of their sets of five-word shingles
is at least 0.8.  Candidates are verified on the whole texts; nothing is linked by
its hashes alone.  They come from operator 9's fingerprints, taken over five-word
shingles, and, as texts at 0.8 differ in 4 to 20 of their 64 bits, which no small
Hamming ball covers, from 40 bands of 5 min-hashes each: a pair at 0.8 misses all
bands with a chance of 0.672^40, about 1 in 8 million.

Components are the same whether all candidates are verified or only enough to
connect them, so each band's members first meet its best connected member alone: a
large group of near copies costs pairs in proportion to its size.  Members of bands
that are then still in different components are compared by an exact prefix filter,
whatever the size of the band: shingles are ordered by how many of these texts have
them, rarest first, those within one component before all others.  Of a pair at 0.8
the smaller text (n shingles) has one of its first n / 9 + 1 among the first n / 5 + 1
of the larger one, at places that leave room for the overlap asked for.  Texts that
share a passage but are not near have rarer shingles of their own to fill these
places, so they make no pairs.  No pair is passed over: what shares a band is
compared by its shingles, not by samples of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash_dedup
from .components import components
from .simhash_dedup import text_hash

#: Words of a shingle, least similarity as a fraction, bands and min-hashes of a band.
SHINGLE, LEAST, BANDS, ROWS = 5, (4, 5), 40, 5
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_RNG = np.random.default_rng(42)
_A = (_RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint64) | 1).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)[:, None]
_ODD = _RNG.integers(0, 1 << 63, max(SHINGLE, ROWS), np.uint64) * 2 + 1
_BAND = _RNG.integers(0, 1 << 63, BANDS, np.uint64)
#: Shingles that are min-hashed at once, and texts whose shingles a batch holds.
_CHUNK, _TEXTS = 512, 500
_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().translate(_LOWER))


def shingles(text: str) -> set[bytes]:
    """A-Z are lower-cased; fewer words than a shingle are one shingle, none too."""
    words = _words(text)
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of every shingle, repeats included."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    sums = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        sums += hashes[i : i + n] * _ODD[i]
    return _mixed(sums)


def _least(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-hashes of a set of hashes."""
    high = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), _CHUNK):
        np.minimum(least, (high[at : at + _CHUNK] * a + b).min(1), out=least)
    return least


def signature(text: str) -> tuple[int, int, np.ndarray]:
    """Number of distinct shingles, SimHash fingerprint, and the bands' keys."""
    words = _words(text)
    hashes = _shingle_hashes(words)
    own, fp = np.unique(hashes), simhash_dedup.majority(hashes) if words else 0
    least = _least(own, _A, _B)
    keys = (least.reshape(BANDS, ROWS) * _ODD[:ROWS]).sum(1, dtype=np.uint64)
    return len(own), fp - (fp >> 63 << 64), _mixed(_mixed(keys) + _BAND).view(np.int64)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text_hash and the hashes of the distinct shingles."""
    for batch in (b.slice(i, _TEXTS) for b in batches for i in range(0, b.num_rows, _TEXTS)):
        own = [np.unique(_shingle_hashes(_words(t.as_py()))).view(np.int64) for t in batch.column(1)]
        ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["text_hash", "shingles"])


def _lists(rows: list[np.ndarray], width: int) -> pa.Array:
    flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), flat)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, fps, keys = [], [], []
        for text in batch.column(2):
            n, fp, bands = signature(text.as_py())
            counts.append(n)
            fps.append(fp)
            keys.append(bands)
        yield common.to_batch(_SIGNED, [batch.column(0), batch.column(1), counts, fps, _lists(keys, BANDS)])


def near(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, set()
    for batch in batches:
        u, v = [], []
        for a, b, s, t in zip(*(batch.column(i) for i in range(4))):
            if last != a:
                last, own = a, shingles(s.as_py())
            if near(own, shingles(t.as_py())):
                u.append(a.as_py())
                v.append(b.as_py())
        yield common.to_batch(_LINKS, [u, v])


def _verify(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """u, v: those of ``pairs`` (a, b) whose whole texts are near."""
    asked = pairs.select(F.col("a").alias("text_hash")).unionByName(pairs.select(F.col("b").alias("text_hash"))).distinct()
    asked = common.small(common.stored(asked, "near-asked"))
    held = common.stored(rows.join(asked, "text_hash", "left_semi").groupBy("text_hash").agg(F.min("text").alias("text")), "near-texts")
    one, two = held.toDF("a", "text_a"), held.toDF("b", "text_b")
    return common.stored(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "u long, v long"), "near-links")


def _similar_sizes(n: str, m: str):
    """Sets whose sizes differ by more can't be near."""
    return (F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0])


def _by_fingerprint(signed: DataFrame) -> DataFrame:
    """a, b: texts whose SimHash fingerprints differ in at most 2 bits, by operator 9's
    look-ups; of the texts with one fingerprint, each with the one of least hash."""
    known = common.stored(signed.groupBy("fp").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")), "near-fingerprints")
    several = known.where("low < high").select("fp", "low")
    same = signed.join(several, "fp").where("text_hash != low").select(F.col("low").alias("a"), F.col("text_hash").alias("b"))
    close = simhash_dedup.links(known.select("fp"))
    u, v = (known.select(F.col("fp").alias(x), F.col("low").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    return same.unionByName(close.join(u, "u").join(v, "v").select("a", "b"))


def _prefix_pairs(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b: all pairs of ``texts`` (text_hash, n, root) that may be near and have
    different roots.  ``rows``: text_hash, text."""
    least, of = LEAST
    asked = common.small(texts.select("text_hash"))
    own = rows.join(asked, "text_hash", "left_semi").groupBy("text_hash").agg(F.min("text").alias("text")).mapInArrow(_shingled, "text_hash long, shingles array<long>")
    held = common.stored(own.join(common.small(texts), "text_hash").select("text_hash", "n", "root", F.explode("shingles").alias("shingle")), "near-shingles")
    # A pair of two components shares only shingles that both have.
    shared = held.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low < high")
    ranked = held.join(shared.select("shingle", "size"), "shingle").groupBy("text_hash", "n", "root")
    ranked = ranked.agg(F.array_sort(F.collect_list(F.struct("size", "shingle"))).alias("held"))
    before = F.col("n") - F.size("held")  # shingles that come first: of one component alone
    n = F.col("n")
    probed, indexed = (n - F.ceil(n * a / b) + 1 for a, b in ((least, of), (2 * least, least + of)))
    first = F.slice("held", F.lit(1), F.greatest(F.lit(0), probed - before).cast("int"))
    entries = ranked.select("text_hash", "n", "root", before.alias("before"), indexed.alias("indexed"), F.posexplode(first).alias("at", "entry"))
    place = F.col("before") + F.col("at")
    entries = entries.select("text_hash", "n", "root", "entry.shingle", place.alias("place"), (place < F.col("indexed")).alias("index"))
    entries = common.stored(entries, "near-prefixes")
    # Components that may have a pair at a shingle come first, so that members of one
    # component, however many, are never paired with each other.
    ends = entries.groupBy("shingle", "root").agg(
        F.max("index").alias("index"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("rest"),
        F.min(F.when(F.col("index"), F.col("n"))).alias("least_i"), F.max(F.when(F.col("index"), F.col("n"))).alias("most_i"), F.max(F.when(F.col("index"), F.col("n") - F.col("place"))).alias("rest_i"),
    )
    one = ends.where("index").select("shingle", F.col("root").alias("left"), "least_i", "most_i", "rest_i")
    two = ends.select("shingle", F.col("root").alias("right"), "least", "most", "rest")
    sizes = (F.col("least_i") <= F.col("most")) & (F.col("most_i") * of >= F.col("least") * least)
    overlap = F.least("rest_i", "rest") * (least + of) >= (F.col("least_i") + F.greatest("least_i", "least")) * least
    meet = one.join(two, "shingle").where((F.col("left") != F.col("right")) & sizes & overlap).select("shingle", "left", "right")
    small = entries.where("index").select("shingle", F.col("text_hash").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("left"), F.col("place").alias("at_a"))
    large = entries.select("shingle", F.col("text_hash").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("right"), F.col("place").alias("at_b"))
    in_order = F.struct("n_a", "a") < F.struct("n_b", "b")
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (least + of) >= (F.col("n_a") + F.col("n_b")) * least
    met = small.join(meet, ["shingle", "left"]).join(large, ["shingle", "right"]).where(in_order & room & _similar_sizes("n_a", "n_b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mixed_members(named: DataFrame) -> DataFrame:
    """text_hash, n, root: members of keys whose members are in different components."""
    keys = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return named.join(keys, "key", "left_semi").select("text_hash", "n", "root").distinct()


def links(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """u, v: near pairs that connect all texts that near pairs connect.

    ``rows``: text_hash, text.  ``signed``: text_hash, n, fp, bands; one row a text."""
    each = signed.select(F.explode("bands").alias("key"), "text_hash", "n")
    shared = each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = common.stored(each.join(shared, "key"), "near-members")
    degrees = members.groupBy("text_hash").agg(F.sum("size").alias("degree"))
    hubs = members.join(degrees, "text_hash").groupBy("key").agg(F.max(F.struct("degree", "text_hash", "n")).alias("hub"))
    first = members.join(hubs, "key").where(F.col("text_hash") != F.col("hub.text_hash")).where(_similar_sizes("n", "hub.n"))
    first = first.select(F.col("hub.text_hash").alias("a"), F.col("text_hash").alias("b")).unionByName(_by_fingerprint(signed))
    first = common.stored(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    found = _verify(first, rows)
    roots = components(found).select(F.col("node").alias("text_hash"), "root")
    named = members.drop("size").join(roots, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    mixed = common.stored(_mixed_members(named), "near-mixed")
    rest = common.stored(_prefix_pairs(mixed, rows).join(first, ["a", "b"], "left_anti"), "near-pairs")
    return found.unionByName(_verify(rest, rows))


def near_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, rows, kept: every id and text hash, how many rows have both,
    and whether it stands for its component over near pairs: the one of the smallest
    doc_id (null only where there is no other), of several texts under it that of the
    least hash.

    A null text counts as empty.  Empty texts and those of white space alone have one
    shingle, the empty one, so that they are one group of which one row stays; texts of
    fewer than five words are one shingle.  Texts of any length are compared whole.
    Rows that share id and text are one row here, with their number as ``rows``.  An
    empty table gives no rows; other columns are not read."""
    rows = common.texts(docs).select("doc_id", text_hash("text"), "text")
    signed = common.stored(rows.mapInArrow(_signatures, "doc_id long, text_hash long, n long, fp long, bands array<long>"), "shingles")
    counted = common.stored(signed.groupBy("text_hash", "doc_id").agg(F.count("*").alias("rows")), "near-rows")
    texts = signed.groupBy("text_hash").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    roots = components(links(rows.select("text_hash", "text"), common.stored(texts, "near-texts")))
    named = counted.join(roots.withColumnRenamed("node", "text_hash"), "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    named = common.stored(named, "near-named")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = common.stored(named.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("size")), "near-best")
    met = common.joined(named, best, ["root"], "size", F.struct("doc_id", "text_hash"))
    return met.select("doc_id", "text_hash", "rows", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))).alias("kept"))
