"""Linear models from sufficient statistics: one scan for all folds and parameters.

X'X, X'y and y'y are sums, so each task adds up its rows per chunk and the parts are
added up by Spark.  Expanding folds are prefix sums over the chunks, and every
parameter set is a small system solved on the driver, whose size is the number of
features squared.  A second scan applies all models of a fold to its test rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAM = pa.schema([("chunk", pa.int32()), ("at", pa.int32()), ("value", pa.float64())])


class LinearModel:
    """Coefficients and intercept; ``transform`` adds the prediction."""

    def __init__(self, coefficients: np.ndarray, intercept: float) -> None:
        self.coefficients, self.intercept = coefficients, intercept

    def predict(self, values: Column) -> Column:
        weights = F.array(*[F.lit(float(c)) for c in self.coefficients])
        products = F.zip_with(values, weights, lambda x, w: x * w)
        return F.aggregate(products, F.lit(float(self.intercept)), lambda a, x: a + x)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        return df.withColumn("prediction", self.predict(vector_to_array(features)))


def _arrays(df: DataFrame, y: str, features: str, chunk: str | None) -> DataFrame:
    part = F.col(chunk).cast("int") if chunk else F.lit(0)
    rows = df.select(part.alias("chunk"), vector_to_array(features).alias("x"), F.col(y).cast("double").alias("y"))
    return rows.where("x IS NOT NULL AND y IS NOT NULL")


def grams(df: DataFrame, y: str, features: str = "features", chunk: str | None = None) -> dict[int, np.ndarray]:
    """Per chunk the matrix Z'Z of Z = (1, X, y), from one scan."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            chunks, labels = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            x = np.asarray(batch.column(1).flatten()).reshape(len(labels), -1)
            z = np.column_stack([np.ones(len(labels)), x, labels])
            for c in np.unique(chunks):
                rows = z[chunks == c]
                own[c] = own.get(c, 0) + rows.T @ rows
        for c, g in own.items():
            flat = g.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), c, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], schema=_GRAM)

    parts = _arrays(df, y, features, chunk).mapInArrow(add_up, "chunk int, at int, value double")
    found: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("chunk", "at").agg(F.sum("value").alias("value")).collect():  # chunks times features squared
        found.setdefault(r.chunk, {})[r.at] = r.value
    side = lambda g: math.isqrt(len(g))
    return {c: np.array([g[i] for i in range(len(g))]).reshape(side(g), side(g)) for c, g in found.items()}


def solve(gram: np.ndarray, fitIntercept: bool = True, regParam: float = 0.0) -> LinearModel:
    """Least squares of Z'Z with a ridge of ``regParam`` (on coefficients as they are,
    the loss being half the mean square); of several solutions the shortest."""
    first = 0 if fitIntercept else 1
    a, b = gram[first:-1, first:-1], gram[first:-1, -1]
    if regParam:
        ridge = np.full(len(a), gram[0, 0] * regParam)
        ridge[: 1 - first] = 0
        a = a + np.diag(ridge)
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))  # columns of unit length, for the condition
    w = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale
    return LinearModel(w[1:], w[0]) if fitIntercept else LinearModel(w, 0.0)


def fold_models(df: DataFrame, y: str, n_folds: int, grid: list[dict], features: str = "features", chunk: str = "chunk") -> tuple[dict[tuple[int, int], LinearModel], list[LinearModel]]:
    """({(fold, parameters): model fitted on the chunks before}, models of all rows)."""
    by_chunk = grams(df, y, features, chunk)
    if not by_chunk:
        raise ValueError("no rows to fit")
    upto, models = 0, {}
    for i in range(n_folds):
        if i and np.ndim(upto):
            models |= {(i, p): solve(upto, **params) for p, params in enumerate(grid)}
        upto = upto + by_chunk[i] if i in by_chunk else upto
    return models, [solve(sum(by_chunk.values()), **params) for params in grid]


def fold_errors(df: DataFrame, y: str, models: dict[tuple[int, int], LinearModel], features: str = "features", chunk: str = "chunk") -> DataFrame:
    """fold, parameters, n, mae, rmse: all models on their test chunk, in one scan."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, labels = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            x, out = np.asarray(batch.column(1).flatten()).reshape(len(labels), -1) if len(labels) else None, [[], [], [], [], []]
            for (fold, p), m in models.items():
                own = chunks == fold
                if own.any():
                    e = labels[own] - x[own] @ m.coefficients - m.intercept
                    for held, value in zip(out, (fold, p, int(own.sum()), float(np.abs(e).sum()), float((e * e).sum()))):
                        held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))], ["fold", "parameters", "n", "a", "s"])

    parts = _arrays(df, y, features, chunk).mapInArrow(apply, "fold int, parameters int, n long, a double, s double")
    n = F.sum("n")
    return parts.groupBy("fold", "parameters").agg(n.alias("n"), (F.sum("a") / n).alias("mae"), F.sqrt(F.sum("s") / n).alias("rmse"))


def linear_grid_search(df: DataFrame, n_folds: int, grid: list[dict], y: str, features: str = "features", chunk: str = "chunk") -> tuple[LinearModel, dict, list[tuple[dict, float]]]:
    """(model of all rows, best parameters, mean error per parameters): the parameters
    with the least mean absolute error over the folds, as ``modelling.grid_search`` has
    it, in two scans instead of a fit for each fold and parameter set."""
    models, whole = fold_models(df, y, n_folds, grid, features, chunk)
    errors: dict[int, list[float]] = {}
    for r in fold_errors(df, y, models, features, chunk).orderBy("fold").collect():  # folds times parameters
        errors.setdefault(r.parameters, []).append(r.mae)
    scores = [sum(errors[p]) / len(errors[p]) if p in errors else math.inf for p in range(len(grid))]
    best = scores.index(min(scores))
    return whole[best], grid[best], list(zip(grid, scores))
