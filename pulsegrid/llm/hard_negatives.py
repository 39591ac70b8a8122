"""Hard-negative mining by ball trees and branch-and-bound (operator 13).

Each task builds ball trees over stretches of its rows and answers blocks of anchors
from them.  With centre c and radius r of a node and an anchor q, every inner product
below the node lies in q.c - r|q| .. q.c + r|q|.  A node is left when that lies wholly
outside the window of scores, when it holds no row of a fitting label, or when its
upper end is strictly beneath the worst of the best k found so far (equal scores are
told by the id, so equality must be followed).  Anchors go down a tree together.

Anchors are taken in blocks of a fixed size, numbered by their order: a block is all
that is ever broadcast, and every block meets every row.  Of each block first the
positives are found over all rows, then, in the windows that they set, the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .numbering import numbered

SCALE, LABELS = 256, 10
#: Components from here on (after scaling) have no exact scores and count as non-finite.
LIMIT = 2.0**26
#: Rows of a tree, rows of a leaf, anchors of a block, queries that go down a tree together.
TREE, LEAF, BLOCK, TOGETHER = 8_192, 64, 16_384, 4_096
#: A child has one in so many of its parent's rows at least (and one row).
SIDE = 16
#: Share by which bounds are widened, far above rounding and far below a score's step.
SLACK = 1e-9

_ROWS = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("dims", pa.int32()), ("x", pa.list_(pa.int32()))])
_FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


class BallTree:
    """Rows in the order of the tree; node i covers rows first[i] to last[i]; its
    children are left[i] and right[i] (-1: a leaf)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(x))
        points = x.astype(np.float64)
        self.first, self.last, self.left, self.right, centres, radii, kinds = [], [], [], [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node, own = len(self.first), points[order[a:b]]
            if parent >= 0:
                (self.left, self.right)[side][parent] = node
            centre = own.mean(axis=0)
            away = ((own - centre) ** 2).sum(axis=1)
            for held, value in ((self.first, a), (self.last, b), (self.left, -1), (self.right, -1), (centres, centre), (radii, away.max() ** 0.5)):
                held.append(value)
            present = np.unique(labels[order[a:b]])
            kinds.append(int(present[0]) if len(present) == 1 else None)
            if b - a > leaf and away.max() > 0:
                one = own[away.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                # Rows go with the nearer of two far ones, so that clusters stay whole; a
                # side with too few rows is filled up, so that depth stays bounded.
                along = own @ (other - one)
                cut = int((along < (other @ other - one @ one) / 2).sum())
                few = max(1, (b - a) // SIDE)
                cut = min(max(cut, few), b - a - few)
                order[a:b] = order[a:b][np.argpartition(along, cut)]
                todo += [(a, a + cut, node, 0), (a + cut, b, node, 1)]
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.alone = kinds  # the label, where a node has but one
        self.largest = int(np.abs(x).max(initial=0))

    def scores(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        """Exact whole inner products of queries and the rows a to b."""
        rows = self.x[a:b]
        exact = int(np.abs(q).max(initial=0)) * self.largest * rows.shape[1] < 2**53
        kind = np.float64 if exact else np.int64
        return (q.astype(kind) @ rows.astype(kind).T).astype(np.int64)

    def search(self, q, own, labels, k: int, same: bool, low, high) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k rows of each query by falling score and rising id: (query,
        id, score).  ``own``: the query's id, no row of which counts; ``same``: rows
        of its label or of all others; ``low``, ``high``: scores that count."""
        m = len(q)
        reach = np.linalg.norm(q.astype(np.float64), axis=1)[:, None] * self.radii
        middle = q.astype(np.float64) @ self.centres.T
        slack = SLACK * (1 + np.abs(middle) + reach)
        upper, lower = middle + reach + slack, middle - reach - slack
        worst = np.full(m, -np.inf)  # of the best k so far; -inf while there are fewer
        best_id, best_score, filled = np.zeros((m, k), np.int64), np.zeros((m, k), np.int64), np.zeros(m, np.int64)

        def fits(node: int, who: np.ndarray) -> np.ndarray:
            up = upper[who, node]
            open_ = (up >= worst[who]) & (up >= low[who]) & (lower[who, node] <= high[who])
            if self.alone[node] is not None:
                open_ &= (labels[who] == self.alone[node]) == same
            return who[open_]

        def take(node: int, who: np.ndarray) -> None:
            a, b = self.first[node], self.last[node]
            step = max(1, 2**22 // (b - a))  # a leaf of equal rows may be the whole tree
            for part in (who[i : i + step] for i in range(0, len(who), step)):
                s = self.scores(q[part], a, b)
                good = ((labels[part][:, None] == self.labels[a:b]) == same) & (self.ids[a:b] != own[part][:, None])
                good &= (s >= worst[part][:, None]) & (s >= low[part][:, None]) & (s <= high[part][:, None])
                r, c = np.nonzero(good)
                if not len(r):
                    continue
                met = np.unique(r)
                old = np.arange(k) < filled[part[met]][:, None]
                query = np.concatenate([part[r], np.repeat(part[met], filled[part[met]])])
                ids = np.concatenate([self.ids[a:b][c], best_id[part[met]][old]])
                score = np.concatenate([s[r, c], best_score[part[met]][old]])
                by = np.lexsort((ids, -score, query))
                query, ids, score = query[by], ids[by], score[by]
                start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
                nth = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
                top = nth < k
                best_id[query[top], nth[top]], best_score[query[top], nth[top]] = ids[top], score[top]
                filled[query[start]] = np.minimum(np.diff(np.r_[start, len(query)]), k)
                full = query[start][filled[query[start]] == k]
                worst[full] = best_score[full, k - 1]

        # Each query begins at the leaf that its bounds lead to, so that a worst is known.
        left, right = np.array(self.left), np.array(self.right)
        seed = np.zeros(m, np.int64)
        while len(down := np.flatnonzero(left[seed] >= 0)):
            one, two = left[seed[down]], right[seed[down]]
            seed[down] = np.where(np.minimum(upper[down, one], high[down]) >= np.minimum(upper[down, two], high[down]), one, two)
        for node in np.unique(seed):
            if len(who := fits(int(node), np.flatnonzero(seed == node))):
                take(int(node), who)

        todo = [(0, np.arange(m))]
        while todo:
            node, who = todo.pop()
            who = fits(node, who)
            if not len(who):
                continue
            if self.left[node] < 0:
                if len(who := who[seed[who] != node]):
                    take(node, who)
                continue
            one, two = self.left[node], self.right[node]
            # What may hold higher scores (within the window) is gone through first.
            nearer = np.minimum(upper[who, one], high[who]).sum() >= np.minimum(upper[who, two], high[who]).sum()
            todo += [(two, who), (one, who)] if nearer else [(one, who), (two, who)]
        held = np.arange(k) < filled[:, None]
        return np.nonzero(held)[0], best_id[held], best_score[held]


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label and whole components of the rows that take part."""
    for batch in batches:
        vectors = batch.column(2)
        lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)).astype(np.int64)
        values = np.floor(np.asarray(pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan"))) * SCALE)
        row = np.repeat(np.arange(len(lengths)), lengths)
        sound = (np.bincount(row[~(np.abs(values) < LIMIT)], minlength=len(lengths)) == 0) & (lengths > 0)
        x, kept, keep = values[sound[row]].astype(np.int32), lengths[sound], pa.array(sound)
        at = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32))
        yield common.to_batch(_ROWS, [batch.column(0).filter(keep), batch.column(1).filter(keep), kept.astype(np.int32), pa.ListArray.from_arrays(at, pa.array(x))])


def whole_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """id (null: NO_ID), label, x: the rows that take part, stored."""
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(common.NO_ID)).alias("id"), label.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    found = common.stored(rows.where("label IS NOT NULL AND e IS NOT NULL").mapInArrow(_sound, "id long, label int, dims int, x array<int>"), "rows")
    usual = found.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    return found.where(F.col("dims") == (usual.dims if usual else 0)).drop("dims")


def _trees(batches: Iterator[pa.RecordBatch], tree: int, leaf: int) -> Iterator[BallTree]:
    """Trees over ``tree`` rows each, in the order of the batches."""
    held, rows = [], 0

    def built(parts: list[pa.RecordBatch]) -> BallTree:
        table = pa.Table.from_batches(parts).combine_chunks()
        x = np.asarray(table["x"].combine_chunks().flatten()).reshape(table.num_rows, -1)
        return BallTree(x, np.asarray(table["id"]), np.asarray(table["label"]), leaf)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, tree - rows)
            held.append(part)
            rows, at = rows + part.num_rows, at + part.num_rows
            if rows == tree:
                yield built(held)
                held, rows = [], 0
    if rows:
        yield built(held)


def _searched(rows: DataFrame, block, k: int, same: bool, tree: int, leaf: int) -> DataFrame:
    """query, id, score: the best k of every query of the block in each tree."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own, labels, low, high = shared.value
        for t in _trees(batches, tree, leaf):
            for i in range(0, len(q), TOGETHER):
                part = slice(i, i + TOGETHER)
                query, *best = t.search(q[part], own[part], labels[part], k, same, low[part], high[part])
                yield common.to_batch(_FOUND, [query + i, *best])

    return rows.mapInArrow(run, "query long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query over all trees, with their rank."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    tree: int = TREE, leaf: int = LEAF, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, stored.

    Components are floor(256 * x); scores are whole inner products; higher ones come
    first, equal ones by smaller vec_id.  ``anchor`` tells the anchors, ``label`` gives
    the label, both from the table's columns.  An anchor's positives are its first
    rows of the same label; its negatives for one of them are the first rows of other
    labels with low * positive <= 100 * score <= high * positive, which for a negative
    positive score are none.

    Rows with a null label, a null or empty vector, or a null or non-finite component
    (or one of 2**26 and more after scaling) take no part, nor do vectors of another
    length than most have.  Rows that share a vec_id are rows of their own, but none
    is a positive or negative of an anchor of that id; anchor rows that repeat count
    once.  A null vec_id comes before all others.  An anchor without positives, a
    positive without negatives and an empty table give no rows.
    """
    spark = vectors.sparkSession
    rows = whole_rows(vectors, label)
    own = F.nullif(F.col("id"), F.lit(common.NO_ID)).alias("vec_id")
    chosen = rows.select("*", own).where(anchor).select("id", "label", "x").distinct()
    anchors = numbered(chosen, ["id", "label", "x"], "query", "anchors")
    path = common.scratch(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for start in range(0, anchors.count(), block):
        held = anchors.where((F.col("query") >= start) & (F.col("query") < start + block)).orderBy("query").collect()  # ``block`` rows at most
        q = np.array([r.x for r in held], np.int32)
        ids, labels = np.array([r.id for r in held]), np.array([r.label for r in held], np.int32)
        any_ = np.full(len(held), -(2**62)), np.full(len(held), 2**62)
        near = _best(_searched(rows, (q, ids, labels, *any_), positives, True, tree, leaf), positives).orderBy("query", "rank").collect()
        who = np.array([r.query for r in near], np.int64)  # ``block`` times ``positives`` at most
        score = np.array([r.score for r in near], object)
        least = np.array([-(-low * s // 100) for s in score], np.int64)
        most = np.array([high * s // 100 for s in score], np.int64)
        if not len(near):
            continue
        best = _best(_searched(rows, (q[who], ids[who], labels[who], least, most), negatives, False, tree, leaf), negatives)
        pairs = spark.createDataFrame([(i, held[r.query].id, r.id, r.score) for i, r in enumerate(near)], "query long, anchor_id long, positive_id long, positive_score long")
        best = best.join(F.broadcast(pairs), "query")
        ends = [F.nullif(F.col(c), F.lit(common.NO_ID)).alias(n) for c, n in (("anchor_id", "anchor_id"), ("positive_id", "positive_id"), ("id", "negative_id"))]
        best.select(ends[0], ends[1], "rank", ends[2], "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vec_id over all rows of embeddings."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
WITH sound AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
         list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), anchors AS (
  SELECT * FROM sound WHERE vec_id % 100 = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM anchors a JOIN sound b ON a.vec_id != b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label != s.own
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
