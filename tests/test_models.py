"""Linear models from sums, ranks of scores and shrunk intercepts, against other ways."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from pulsegrid.operators import linear, modelling, scores

GRID = [{"fitIntercept": True}, {"fitIntercept": False}, {"fitIntercept": True, "regParam": 0.3}]


def rows(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [0, 1000, 0]
    y = x @ [2.0, -0.1, 30.0] + 5 + rng.normal(size=n)
    return spark.createDataFrame([(int(i % 4), Vectors.dense(a.tolist()), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["chunk", "features", "y"])


@pytest.mark.parametrize("params", GRID)
def test_solution_equals_the_library(spark, params):
    df = rows(spark).repartition(3)
    own = linear.solve(sum(linear.grams(df, "y").values()), **params)
    fit = LinearRegression(labelCol="y", solver="normal", standardization=False, **params).fit(df)
    if params.get("regParam"):  # the library scales the label for its penalty; compare with the definition
        data = [(np.array(r.features), r.y) for r in df.collect()]
        x, y = np.array([a for a, _ in data]), np.array([b for _, b in data])
        c = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) / len(y) + 0.3 * np.eye(3), (x - x.mean(0)).T @ (y - y.mean()) / len(y))
        assert own.coefficients == pytest.approx(c, rel=1e-6) and own.intercept == pytest.approx(y.mean() - x.mean(0) @ c)
    else:
        assert own.coefficients == pytest.approx(fit.coefficients.toArray(), rel=1e-6) and own.intercept == pytest.approx(fit.intercept, rel=1e-6, abs=1e-6)
    said = own.transform(df).select(F.max(F.abs(F.col("prediction") - F.lit(0)))).first()[0]
    assert np.isfinite(said)


def test_grid_equals_one_fit_a_fold(spark):
    df = rows(spark, seed=2)
    model, best, told = linear.linear_grid_search(df, 4, GRID[:2], "y")
    fitted, other, want = modelling.grid_search(df, 4, modelling.fit_linear, GRID[:2], "y")
    assert best == other and [s for _, s in told] == pytest.approx([s for _, s in want], rel=1e-6)
    assert model.coefficients == pytest.approx(fitted.coefficients.toArray(), rel=1e-6)


def test_columns_that_repeat_each_other(spark):
    df = spark.createDataFrame([(0, Vectors.dense([float(i), 2.0 * i, 0.0]), 3.0 * i + 1) for i in range(20)], ["chunk", "features", "y"])
    model = linear.solve(linear.grams(df, "y")[0])
    assert modelling.regression_metrics(model.transform(df), "y").first().mae == pytest.approx(0, abs=1e-6)
    models, _ = linear.fold_models(df, "y", 3, GRID[:1])
    assert set(models) == {(1, 0), (2, 0)} and linear.fold_errors(df, "y", models).count() == 0
    with pytest.raises(ValueError):
        linear.fold_models(df.where("chunk > 5"), "y", 3, GRID)


@pytest.mark.parametrize("values", [2, 7, 10_000])
def test_area_equals_all_pairs(spark, values):
    rng = random.Random(values)
    data = [(int(rng.random() < 0.4), float(rng.randrange(values))) for _ in range(400)]
    data = [(y, s + 3 * y) for y, s in data]
    pos, neg = ([s for y, s in data if y == k] for k in (1, 0))
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    df = spark.createDataFrame([*data, (None, 1.0), (1, None)], "y int, s double").repartition(5)
    assert scores.area_under_curve(df, "y", "s").first().auc == pytest.approx(want)


def test_metrics_of_one_class_and_of_nothing(spark):
    one = spark.createDataFrame([(1, 1.0, 0.5), (1, 0.0, 0.2)], "y int, prediction double, s double")
    assert scores.classification_metrics(one, "y", score="s").first().asDict() == {"n": 2, "accuracy": 0.5, "f1": pytest.approx(2 / 3), "auc": None}
    said = scores.classification_metrics(one.where("false"), "y", score="s").first()
    assert (said.n or 0, said.accuracy, said.auc) == (0, None, None)


def test_f1_of_three_classes(spark):
    rng = random.Random(3)
    data = [(rng.randrange(3), rng.randrange(4)) for _ in range(200)]
    want = sum((2 * sum(y == q == c for y, q in data)) / (sum(y == c for y, _ in data) + sum(q == c for _, q in data)) * sum(y == c for y, _ in data) for c in range(3)) / 200
    assert scores.classification_metrics(spark.createDataFrame(data, "y int, q int"), "y", "q").first().f1 == pytest.approx(want)


def test_hash_split_does_not_depend_on_partitions(spark):
    df = spark.range(2000)
    first, rest = scores.hash_split(df, 0.8, 1, ["id"])
    again, _ = scores.hash_split(df.repartition(7), 0.8, 1, ["id"])
    assert 1500 < first.count() < 1700 and first.count() + rest.count() == 2000 and first.exceptAll(again).count() == 0


@pytest.mark.parametrize("strategy", ["minmax", "standard"])
def test_feature_scale_equals_the_window(spark, strategy):
    from pyspark.sql import Window

    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, 1e9 + rng.random()]), 3, i) for i in range(80)] + [("one", 5.0, 3, 99)]
    df = spark.createDataFrame(data, "customer string, x double, same int, id int")
    w = Window.partitionBy("customer")
    low, span = (F.min("x").over(w), F.max("x").over(w) - F.min("x").over(w)) if strategy == "minmax" else (F.avg("x").over(w), F.stddev_pop("x").over(w))
    want = df.withColumn("want", F.coalesce(F.try_divide(F.col("x") - low, F.nullif(span, F.lit(0.0))), F.when(F.col("x").isNotNull(), 0.0)))
    got = modelling.per_user_feature_scale(df, ["x", "same"], strategy)
    assert got.columns == df.columns and {r.same for r in got.collect()} == {0.0}
    want = {r.id: r.want for r in want.collect()}
    for r in got.collect():
        assert (r.x is None) == (want[r.id] is None) and (r.x is None or r.x == pytest.approx(want[r.id], abs=1e-5))


def test_forests_read_their_input_once(spark):
    from pyspark.ml.feature import VectorAssembler

    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(200).selectExpr("concat('c', id % 8) customer", "double(id % 2) label", "double(id % 17) x", "double(id % 31) y")
    rows = rows.withColumn("x", F.udf(counted, "double").asNondeterministic()("x"))
    table = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    modelling.fit_mixed_forest(table, "y", 2, numTrees=2, maxDepth=2)
    assert seen.value == 200
    modelling.fit_affect_classifier(table, "label", numTrees=2, maxDepth=2)
    assert seen.value == 400
