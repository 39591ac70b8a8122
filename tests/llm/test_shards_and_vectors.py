"""Sharding, whitening and hard negatives against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import hard_negatives, sharding, whitening

from . import data

VECTORS = "vec_id long, embedding array<float>, label int"


# ---- operator 11 -------------------------------------------------------------------


def plain_shards(rows, shards, seed=1):
    """(doc_id, size, crc, shard, slot) by sorting everything."""
    groups = {}
    for doc_id, text, _, source, *_ in rows:
        raw = (text or "").encode()
        size, crc = len(raw) + 16, zlib.crc32(raw)
        key = hashlib.md5(f"{seed}:{'-' if doc_id is None else doc_id}:{crc}:{size}".encode()).hexdigest()
        groups.setdefault(source, []).append((key, -math.inf if doc_id is None else doc_id, size, crc))
    order = []
    for own in groups.values():
        own.sort()
        order += [((i + 0.5) / len(own), *row) for i, row in enumerate(own)]
    order.sort()
    total, out = len(order), []
    for place, (_, _, doc_id, size, crc) in enumerate(order):
        shard = place * shards // total
        out.append((None if doc_id == -math.inf else doc_id, size, crc, shard, place - -(-shard * total // shards)))
    return Counter(out)


def shard_rows(seed=3):
    rng = random.Random(seed)
    rows = data.rows() + [(5000 + i, f"text {i % 50}", "en", "hot", 1) for i in range(400)]
    rows += [(6000 + i, rng.choice(["", None, "x"]), None, rng.choice(["", None, "é"]), None) for i in range(60)]
    rows += [(None, "same", "en", "hot", 4)] * 30 + [(7, "word " * 200_000, "en", "src1", 1)]
    return rows


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_equal_plain(spark, shards):
    rows = shard_rows()
    got = sharding.interleaved(data.table(spark, rows).withColumn("a.b", F.lit(1)), shards).select("doc_id", "size", "text_crc32", "shard", "slot")
    assert Counter(map(tuple, got.collect())) == plain_shards(rows, shards)


def test_shards_hold_the_mixture(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3 if i % 2 else 0}", 1) for i in range(3000)]
    got = sharding.interleaved(spark.createDataFrame(rows, data.SCHEMA), 40).join(spark.createDataFrame(rows, data.SCHEMA), "doc_id")
    total, found = Counter(r[3] for r in rows), Counter(map(tuple, got.select("shard", "source").collect()))
    assert all(abs(found[k, s] - n / 40) <= 2 for s, n in total.items() for k in range(40))


def test_shards_few_or_no_rows(spark):
    few = sharding.interleaved(spark.createDataFrame(shard_rows()[:3], data.SCHEMA), 40).collect()
    assert sorted(r.shard for r in few) == [0, 13, 26] and all(r.slot == 0 for r in few)
    assert sharding.interleaved(spark.createDataFrame([], data.SCHEMA)).count() == 0


def test_shards_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert Counter(map(tuple, sharding.op11_sharding(spark, sf).collect())) == Counter(duckdb.sql(sharding.OP11_SQL).fetchall())


def test_written_shards(spark, tmp_path):
    rows = shard_rows()
    docs = data.table(spark, rows).withColumn("slot", F.lit(9))
    back = sharding.write_shards(docs, str(tmp_path / "shards"), 7)
    expect = plain_shards(rows, 7)
    assert Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in back.collect()) == expect
    first = spark.read.parquet(str(tmp_path / "shards" / "shard=0")).coalesce(1).select("slot").collect()
    assert sorted(r.slot for r in first) == list(range(len(first)))


# ---- operator 12 -------------------------------------------------------------------


def vector_rows(seed=5, n=400, dims=6):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims))
    rows = [(i, [float(v) for v in (rng.normal(size=dims) @ mix).astype(np.float32)], int(rng.integers(0, 10))) for i in range(n)]
    rows[3], rows[4] = (3, None, 1), (4, rows[4][1], None)
    rows[5], rows[6] = (5, [None] * dims, 2), (6, [float("nan")] + [0.0] * (dims - 1), 2)
    rows[7], rows[8] = (7, [float("inf")] + [0.0] * (dims - 1), 2), (8, [], 3)
    rows[9], rows[10] = (9, [1.0] * (dims + 1), 3), (None, rows[11][1], rows[11][2])
    rows += [(1000 + i, rows[20][1], 1) for i in range(60)]  # one vector many times
    rows += [rows[100], rows[100]]  # rows that repeat
    return rows


def sound(rows, dims=6):
    return [r for r in rows if r[1] and len(r[1]) == dims and all(v is not None and math.isfinite(v) for v in r[1])]


def test_whitening_equals_numpy(spark):
    rows = vector_rows()
    table = spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit(1)).withColumn("whitened", F.lit("y"))
    white, model = whitening.whiten(table, 4)
    kept = sound(rows)
    x = np.floor(np.array([np.float32(r[1]) for r in kept], float) * 1024).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    assert model["n"] == n and model["sums"] == s.tolist() and np.allclose(model["eigenvalues"], e, rtol=1e-10)
    u = u * np.sign((u * model["vectors"]).sum(axis=0))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expect = sorted(((r[0], int(d), w) for r, d, w in zip(kept, ((n * x - s).astype(object) ** 2).sum(axis=1), (c @ u / np.sqrt(e)).tolist())), key=key)
    got = sorted(((r.vec_id, int(r.deviation), r.whitened) for r in white.collect()), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in expect]
    assert np.allclose([r[2] for r in got], [r[2] for r in expect], atol=1e-9)
    assert model["identity_error"] < 1e-9 and np.allclose(model["explained"], e / np.trace(v))


def test_whitening_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**30 + 7 * i), float(-i)], 0) for i in range(50)] + [(99, [2.0**36, 0.0], 0)]
    white, model = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    x = [[1024 * int(v) + 100_000 for v in r[1]] for r in rows[:-1]]
    s = [sum(c) for c in zip(*x)]
    expect = {i: sum((50 * v - t) ** 2 for v, t in zip(row, s)) for i, row in enumerate(x)}
    assert model["sums"] == s and {r.vec_id: int(r.deviation) for r in white.collect()} == expect


def test_whitening_without_variance(spark):
    white, model = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS))
    assert [r.whitened for r in white.collect()] == [[], []] and model["n"] == 2
    assert whitening.whiten(spark.createDataFrame([(1, None, 0)], VECTORS))[0].count() == 0
    line, model = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(9)], VECTORS))
    assert len(model["eigenvalues"]) == 1 and model["identity_error"] < 1e-9 and len(line.first().whitened) == 1


def test_op12_on_table(spark, sf):
    got = whitening.op12_whitening(spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got.count() == 8 * table.where("embedding IS NOT NULL").count()
    assert got.agg(F.max("identity_error")).first()[0] < 1e-4


# ---- operator 13 -------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=10, scale=256):
    held = []
    for vec_id, vector, label in sound(rows):
        if label is not None:
            if vec_id is not None and vec_id % 7 == 0:
                label = (label + 1) % 10
            held.append((vec_id, label, [math.floor(scale * float(np.float32(v))) for v in vector]))
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is not None, f[1] or 0))
    out, anchors = Counter(), {(i, lab, tuple(x)) for i, lab, x in held if i is not None and i % 100 == 0}
    for i, lab, x in anchors:
        scored = [(sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in held if j != i]
        for ps, pid, _ in first(s for s in scored if s[2] == lab)[:positives]:
            found = first(s for s in scored if s[2] != lab and 30 * ps <= 100 * s[0] <= 90 * ps)[:negatives]
            out.update((i, pid, rank, nid, ps, ns) for rank, (ns, nid, _) in enumerate(found, 1))
    return out


@pytest.mark.parametrize("tree, leaf, block", [(8192, 64, 16384), (50, 4, 3), (1, 1, 1)])
def test_negatives_equal_plain(spark, tree, leaf, block):
    rows = vector_rows(n=400 if tree > 1 else 120)
    table = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit(1)).withColumn("query", F.lit(2)).withColumn("score", F.lit(3))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, label, tree=tree, leaf=leaf, block=block)
    expect = plain_negatives(rows)
    assert len(expect) > 20 and Counter(map(tuple, got.collect())) == expect


def test_negatives_ties_and_copies(spark):
    rows = [(i, [0.5, 0.25], 0) for i in range(300)] + [(i, [0.25, 0.25], 1) for i in range(300, 700)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 100, F.col("label"), tree=128, leaf=8)
    assert Counter((r.positive_id, r.rank, r.negative_id) for r in got.collect()) == Counter((p, k + 1, 300 + k) for p in range(5) for k in range(10))


def test_negatives_none(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(empty, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 2)], VECTORS)  # a positive of negative score
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_negatives_of_large_components(spark):
    rows = [(i, [float(200_000 - i), float(i)], i % 2) for i in range(60)] + [(200, [1e9, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.hard_negatives(table, F.col("vec_id") == 0, F.col("label"), low=30, high=100)
    x = {i: [math.floor(256 * v) for v in vector] for i, vector, _ in rows[:-1]}
    score = {i: sum(a * b for a, b in zip(x[0], y)) for i, y in x.items()}
    assert got.count() and all(r.negative_score == score[r.negative_id] and r.positive_score == score[r.positive_id] for r in got.collect())


def test_bounds_hold_on_random_trees():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (500, 5)).astype(np.int32)
    tree = hard_negatives.BallTree(x, np.arange(500), rng.integers(0, 3, 500).astype(np.int32), 8)
    q = rng.integers(-200, 200, (20, 5))
    s = q @ tree.x.T.astype(int)
    for node, (a, b) in enumerate(zip(tree.first, tree.last)):
        reach = np.linalg.norm(q, axis=1) * tree.radii[node] * (1 + 1e-9) + 1e-6
        middle = q @ tree.centres[node]
        assert (s[:, a:b] <= (middle + reach)[:, None]).all() and (s[:, a:b] >= (middle - reach)[:, None]).all()


def test_negatives_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = hard_negatives.op13_hard_negatives(spark, sf)
    assert Counter(map(tuple, got.collect())) == Counter(duckdb.sql(hard_negatives.OP13_SQL).fetchall())


def test_nodes_are_left_out(monkeypatch):
    """Of vectors in clusters most nodes lie outside the window or beneath the k-th."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32)) * 256 / 32**0.5
    x = np.floor(centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 32)) * 8).astype(np.int32)
    labels = rng.integers(0, 10, 6000).astype(np.int32)
    tree, scored = hard_negatives.BallTree(x, np.arange(6000), labels), []
    plain = hard_negatives.BallTree.scores
    monkeypatch.setattr(hard_negatives.BallTree, "scores", lambda self, q, a, b: scored.append(len(q) * (b - a)) or plain(self, q, a, b))
    q, own = x[:60], labels[:60]
    none = np.full(60, -(2**62))
    query, ids, score = tree.search(q, np.arange(60), own, 5, True, none, -none)
    first = sum(scored) / (60 * 6000)
    s = q.astype(int) @ x.T.astype(int)
    for i in range(60):
        fit = sorted((-s[i, j], j) for j in np.flatnonzero((labels == own[i]) & (np.arange(6000) != i)))[:5]
        assert list(zip(-score[query == i], ids[query == i])) == fit
    scored.clear()
    best = score[np.searchsorted(query, np.arange(60))]
    tree.search(q, np.arange(60), own, 10, False, -(-95 * best // 100), 99 * best // 100)
    assert first < 0.4 and sum(scored) / (60 * 6000) < 0.2
