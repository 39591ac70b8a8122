"""Embedding whitening from the covariance of all rows (operator 12).

1. A vector's entries become whole numbers; their sums per dimension are exact.
2. Rows are centred exactly (n * x - S is a whole number, divided by n once) and go
   to Spark MLlib's RowMatrix, whose Gramian over n is the covariance.  It is the one
   thing that meets on the driver: as many numbers as dimensions squared.
3. Its eigenvectors, scaled, are broadcast and applied to batches of rows.
4. The covariance of the result is worked out in the same way and held against the
   identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries from here on have no exact place in the sums and count as non-finite.
LIMIT = 2.0**36
#: Eigenvalues below this share of the largest are rounding, not variance.
NOTHING = 1e-12
#: Rows turned at once; bounds the memory of a task and the sums of a batch.
BATCH = 10_000

_WHOLE = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("x", pa.list_(pa.int64()))])
_SUMS = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])
WHITE = "vec_id long, deviation decimal(38,0), whitened array<double>"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector is sound, with their whole numbers."""
    for batch in batches:
        vectors = batch.column(1)
        lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)).astype(np.int64)
        values = np.asarray(pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")))
        bad = ~(np.abs(values) < LIMIT)
        row = np.repeat(np.arange(len(lengths)), lengths)
        sound = (np.bincount(row[bad], minlength=len(lengths)) == 0) & (lengths > 0)
        x = np.floor(values[sound[row]] * SCALE).astype(np.int64) + SHIFT
        kept = lengths[sound]
        at = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32))
        yield common.to_batch(_WHOLE, [batch.column(0).filter(pa.array(sound)), kept.astype(np.int32), pa.ListArray.from_arrays(at, pa.array(x))])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            for part in (x[i : i + BATCH] for i in range(0, len(x), BATCH)):
                dims = x.shape[1]
                yield common.to_batch(_SUMS, [np.arange(dims, dtype=np.int32), np.full(dims, len(part)), part.sum(axis=0)])


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of whole numbers), stored.

    Rows whose vector is null or empty or holds a null or non-finite entry (or one of
    2**36 and more) are left out, and so are vectors of another length than most have
    (of lengths that are as frequent, the longest counts)."""
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = common.stored(ids.mapInArrow(_whole, "vec_id long, dims int, x array<long>"), "whole")
    usual = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    return rows.where(F.col("dims") == (usual.dims if usual else 0)).drop("dims")


def sums(whole: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension: as many numbers as dimensions."""
    parts = whole.select("x").mapInArrow(_sums, "dim int, n long, total long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return (found[0].n, [int(r.s) for r in found]) if found else (0, [])


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S as whole numbers, and x - S / n with one rounding."""
    far = max(int(np.abs(x).max(initial=0)) * n, int(max(map(abs, s.tolist()), default=0)))
    d = n * x - s.astype(np.int64) if far < 2**62 else n * x.astype(object) - s
    return d, (d / n).astype(np.float64)


def _squares(d: np.ndarray) -> list[Decimal]:
    """Exact sums of squares of the rows."""
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] >= 2**63:
        d = d.astype(object)
    return [Decimal(int(v)) if int(v) < 10**38 else None for v in (d * d).sum(axis=1)]


def covariance(rows: DataFrame, n: int) -> np.ndarray:
    """Gramian of rows (a column of arrays of doubles, centred) divided by n."""
    column = rows.columns[0]
    dense = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias(column)), column)
    return RowMatrix(dense).computeGramianMatrix().toArray() / n


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of the first ``k`` components by
    falling eigenvalue; the largest entry of each is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    real = e > NOTHING * max(e[0], 0) if len(e) else e > 0
    e, u = e[real], u[:, real]
    return e, u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(e))] < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """Rows vec_id, deviation (exact sum over dimensions of (n * x - S) ** 2; null
    beyond 38 digits) and whitened (an array by component), stored, and the model: n,
    sums, eigenvalues, vectors, explained, identity_error.

    Components without variance are left out, so a single row or rows that are all
    alike give empty arrays; no sound row gives no rows.  Null ids and rows that
    repeat are rows of their own; ties between eigenvalues stand as numpy's eigh
    gives them.  Other columns are not read; ``whole_vectors`` says what takes part.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors)
    n, s = sums(whole)
    if not n:
        return spark.createDataFrame([], WHITE), {"n": 0, "sums": [], "eigenvalues": np.zeros(0), "vectors": np.zeros((0, 0)), "explained": np.zeros(0), "identity_error": 0.0}
    shared = spark.sparkContext.broadcast((n, np.array(s, object)))

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"c": list(_centred(np.stack(batch["x"].to_numpy()), *shared.value)[1])})

    v = covariance(whole.select("x").mapInPandas(centre, "c array<double>"), n)
    e, u = components(v, k)
    turned = spark.sparkContext.broadcast(u / np.sqrt(e))  # dimensions x k numbers

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d, c = _centred(np.stack(batch["x"].to_numpy()), *shared.value)
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "deviation": _squares(d), "whitened": list(c @ turned.value)})

    white = common.stored(whole.mapInPandas(turn, WHITE), "whitened")
    error = 0.0
    if len(e):
        means = white.agg(*(F.avg(F.col("whitened")[i]) for i in range(len(e)))).first()
        off = F.array(*(F.col("whitened")[i] - F.lit(m) for i, m in enumerate(means)))
        error = float(np.abs(covariance(white.select(off.alias("c")), n) - np.eye(len(e))).max())
    return white, {"n": n, "sums": s, "eigenvalues": e, "vectors": u, "explained": e / np.trace(v), "identity_error": error}


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound rows of embeddings on their first eight components."""
    white, model = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    explained = F.array(*(F.lit(float(x)) for x in model["explained"])).cast("array<double>")
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model["n"]).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model["identity_error"]).alias("identity_error"),
    )
