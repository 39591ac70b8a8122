"""Splits, folds, preprocessing, baselines, forests and metrics of affect models."""

from __future__ import annotations

import itertools
import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, MinMaxScaler, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_log1p
from .quality import ACTIVITY
from .scores import classification_metrics, hash_split
from .sensors import MISSING
from .spread import written
from .tracks import tile, with_place, with_totals

#: The feature groups of the models.
SKEWED = [
    "age", "hr_mean", "hr_min", "hr_max", "hr_std", "hr_zone_resting", "hr_zone_moderate", "hr_zone_vigorous", "n_steps", "n_GPS",
    "total_distance_km", "at_home_minute", "time_in_transition_minutes", "time_stationary_minutes", *ACTIVITY, "sunshine_duration",
    "precipitation_hours",
]
NUMERIC = [*SKEWED, "apparent_temperature_mean"]
BINARY = ["somatic_problems", "psychotropic", "ema_smartphone", "weekend"]
CATEGORIES = {
    "weekday": ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"],
    "prior_treatment_description_simple": ["no prior treatment", "prior inpatient", "prior psychotherapy"],
    "quest_create_hour": list(range(5, 24)),
    "season": ["Fall", "Spring", "Summer", "Winter"],
    "time_of_day": ["Afternoon", "Early Morning", "Evening", "Morning", "Night"],
    "employability_description_simple": ["no", "yes"],
}
PERSON_STATIC = ["age", "somatic_problems", "psychotropic", "employability_description_simple", "prior_treatment_description_simple", "ema_smartphone"]


# -- splits ------------------------------------------------------------------


def outer_user_split(df: DataFrame, ratio: float = 0.1, strata: str | None = None, seed: int = 42, user: str = "customer") -> tuple[DataFrame, DataFrame]:
    """(rest, holdout): exactly floor(n * ratio) users, spread over the strata by
    largest remainder; which of a stratum's users is settled by a seeded hash."""
    group = F.col(strata) if strata else F.lit("all")
    users = df.groupBy(user).agg(F.min(group).alias("_stratum"))
    sizes = users.groupBy("_stratum").agg(F.count("*").alias("n")).orderBy("_stratum").collect()  # one row a stratum
    total = math.floor(sum(r.n for r in sizes) * ratio)
    if total < 2:
        raise ValueError("the holdout needs two users at least")
    exact = {r["_stratum"]: r.n * ratio for r in sizes}
    quota = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (quota[s] - exact[s], str(s)))[: total - sum(quota.values())]:
        quota[s] += 1
    rank = F.row_number().over(Window.partitionBy("_stratum").orderBy(F.xxhash64(F.lit(seed), user), user))
    limit = F.lit(0)
    for s, n in quota.items():
        limit = F.when(F.col("_stratum").eqNullSafe(F.lit(s)), n).otherwise(limit)
    chosen = users.withColumn("_rank", rank).where(F.col("_rank") <= limit).select(user)
    return df.join(chosen, user, "left_anti"), df.join(chosen, user, "left_semi")


def inner_time_split(df: DataFrame, ratio: float = 0.8, user: str = "customer", ts: str = "sensor_block_end") -> DataFrame:
    """Adds ``is_train``: the first floor(n * ratio) rows of each user by time."""
    return with_place(df, [user], [ts]).withColumn("is_train", F.col("place") <= F.floor(F.col("of") * ratio)).drop("place", "of")


def forward_chaining_folds(df: DataFrame, n: int = 5, user: str = "customer", ts: str = "sensor_block_end") -> DataFrame:
    """Adds ``chunk``: n contiguous chunks of each user's rows by time, the first ones
    longer by one; users with fewer rows than chunks are all in chunk 0.  Fold i
    trains on chunks below i and tests on chunk i; fold 0 has nothing to train on."""
    chunk = F.when(F.col("of") < n, 0).otherwise(tile(n) - 1)
    return with_place(df, [user], [ts]).withColumn("chunk", chunk).drop("place", "of")


def fold(df: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("chunk") < i), df.where(F.col("chunk") == i)


def time_series_folds(df: DataFrame, n: int = 5, ts: str = "sensor_block_end") -> DataFrame:
    """Adds ``chunk`` 0 to n over all rows in time order, by exact quantiles of time:
    equal times stay together, and no global sort meets in one task."""
    micros, hour = F.unix_micros(F.col(ts).cast("timestamp")), F.date_trunc("hour", F.col(ts).cast("timestamp"))
    known = df.where(F.col(ts).isNotNull()).select(F.unix_micros(hour).alias("hour"), micros.alias("at"))
    before, total = {}, 0  # one row an hour of the calendar
    for row in known.groupBy("hour").count().orderBy("hour").collect():
        before[row["hour"]], total = total, total + row["count"]
    places = [i * (total - 1) / (n + 1) for i in range(1, n + 1)] if total else []
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    holding = {r: max(h for h, at in before.items() if at <= r) for r in ranks}
    times = known.where(F.col("hour").isin(*set(holding.values()))).groupBy("hour", "at").count()
    upto = F.sum("count").over(Window.partitionBy("hour").orderBy("at"))
    asked = F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(r - before[h]).alias("place"), F.lit(r).alias("rank")) for r, h in holding.items()])
    own = F.filter(asked, lambda x: (x["hour"] == F.col("hour")) & (x["place"] < F.col("upto")) & (x["place"] >= F.col("upto") - F.col("count")))
    found = times.withColumn("upto", upto).select(F.explode(own["rank"]).alias("rank"), "at").collect() if ranks else []
    value = {r.rank: r.at for r in found}
    chunk = F.lit(0)
    for p in places:
        low, high = value[math.floor(p)], value[math.ceil(p)]
        chunk = chunk + (micros > F.lit(low + (high - low) * (p - math.floor(p)))).cast("int")
    return df.withColumn("chunk", chunk)


def select_features(static: bool = True, user: str | None = "customer") -> list[str]:
    """Feature names with or without what is constant per person, and the user."""
    own = [*NUMERIC, *BINARY, *CATEGORIES]
    return [*([user] if user else []), *[c for c in own if static or c not in PERSON_STATIC]]


# -- preprocessing -----------------------------------------------------------


def sentinel_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c).cast("double"), F.lit(float(MISSING))) for c in columns})


def impute(train: DataFrame, columns: list[str], strategy: str = "mean"):
    """Fitted imputer of the train rows (mean, median or mode)."""
    return Imputer(strategy=strategy, inputCols=columns, outputCols=columns).fit(train)


def one_hot(df: DataFrame, categories: dict[str, list]) -> tuple[DataFrame, list[str]]:
    """0/1 columns of fixed categories; unknown values are all zeros."""
    flags = {f"{c}={x}": F.coalesce((F.col(c).cast("string") == F.lit(str(x))).cast("double"), F.lit(0.0)) for c, xs in categories.items() for x in xs}
    renamed = {k.replace(" ", "_").replace(".", "_"): v for k, v in flags.items()}
    return df.withColumns(renamed), list(renamed)


def preprocess(train: DataFrame, others: list[DataFrame], skewed: list[str], plain: list[str], binary: list[str], categories: dict[str, list], scaler: str = "minmax", strategy: str = "mean") -> list[DataFrame]:
    """The frames with a ``features`` vector: imputed, log-scaled where skewed, without
    constant features, scaled; flags and fixed one-hot columns pass through."""
    numbers = [*skewed, *plain]

    def shaped(df: DataFrame) -> tuple[DataFrame, list[str]]:
        return one_hot(sentinel_to_null(df, numbers).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in binary}), categories)

    first, hot = shaped(train)
    first = written(first, "train")  # read by each of the fits below
    imputer = impute(first, numbers, strategy)
    logged = lambda df: imputer.transform(df).withColumns({c: safe_log1p(c) for c in skewed})
    scale = MinMaxScaler(inputCol="varied", outputCol="scaled") if scaler == "minmax" else StandardScaler(inputCol="varied", outputCol="scaled", withMean=True)
    stages = Pipeline(
        stages=[
            VectorAssembler(inputCols=numbers, outputCol="numbers"),
            VarianceThresholdSelector(featuresCol="numbers", outputCol="varied", varianceThreshold=0.0),
            scale,
            VectorAssembler(inputCols=["scaled", *binary, *[f"`{h}`" if "." in h else h for h in hot]], outputCol="features"),
        ]
    ).fit(logged(first))
    drop = ["numbers", "varied", "scaled", *hot]
    return [stages.transform(logged(df)).drop(*drop) for df in (first, *(shaped(o)[0] for o in others))]


def per_user_label_scale(train: DataFrame, df: DataFrame, y: str, user: str = "customer") -> DataFrame:
    """``y_scaled`` with the user's train mean and deviation (0 or null: 1); users
    unseen in training keep their values."""
    stats = train.groupBy(user).agg(F.avg(y).alias("_mean"), F.stddev_samp(y).alias("_sd"))
    sd = F.coalesce(F.when(F.col("_sd") > 0, F.col("_sd")), F.lit(1.0))
    scaled = (F.col(y) - F.coalesce("_mean", F.lit(0.0))) / sd
    return df.join(stats, user, "left").withColumns({"y_scaled": scaled, "y_mean": F.coalesce("_mean", F.lit(0.0)), "y_sd": sd}).drop("_mean", "_sd")


def per_user_label_inverse(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return df.withColumn(prediction, F.col(prediction) * F.col("y_sd") + F.col("y_mean"))


def per_user_feature_scale(df: DataFrame, columns: list[str], strategy: str = "minmax", user: str = "customer") -> DataFrame:
    """Features scaled within each user; constant ones become 0.  A user's rows are
    spread over tasks; what they have in common comes from totals."""
    spread = F.pmod(F.xxhash64(*columns), F.lit(64))
    value = {c: F.col(c).cast("double") for c in columns}
    if strategy == "minmax":
        rows = with_totals(df, [user], {f"{n}_{c}": (f, v) for c, v in value.items() for n, f in (("low", F.min), ("high", F.max))}, spread)
        span = {c: F.col(f"high_{c}") - F.col(f"low_{c}") for c in columns}
    else:  # deviations from the mean, which is known by then, so that large values keep their digits
        rows = with_totals(df, [user], {f"{n}_{c}": (F.sum, v) for c, v in value.items() for n, v in (("sum", v), ("n", F.when(v.isNotNull(), 1)))}, spread)
        rows = rows.withColumns({f"low_{c}": F.try_divide(f"sum_{c}", f"n_{c}") for c in columns})
        rows = with_totals(rows, [user], {f"high_{c}": (F.sum, F.pow(v - F.col(f"low_{c}"), 2)) for c, v in value.items()}, spread)
        span = {c: F.sqrt(F.try_divide(f"high_{c}", f"n_{c}")) for c in columns}
    scaled = {c: F.coalesce(F.try_divide(v - F.col(f"low_{c}"), F.nullif(span[c], F.lit(0.0))), F.when(v.isNotNull(), F.lit(0.0))) for c, v in value.items()}
    return rows.withColumns(scaled).select(*df.columns)


def encode_users(train: DataFrame, test: DataFrame, user: str = "customer", ts: str = "sensor_block_end") -> DataFrame:
    """user, user_index: train users by first appearance, then those seen in the test only."""
    first = lambda df, part: df.groupBy(user).agg(F.min(ts).alias("_at")).withColumn("_part", F.lit(part))
    both = first(train, 0).unionByName(first(test, 1).join(train.select(user).distinct(), user, "left_anti"))
    both = both.withColumn("_hour", F.coalesce(F.unix_micros(F.date_trunc("hour", F.col("_at").cast("timestamp"))), F.lit(-(1 << 62))))
    # One task adds up one row for an hour of the calendar; users are ranked within theirs.
    hours = both.groupBy("_part", "_hour").agg(F.count("*").alias("_n"))
    hours = hours.select("_part", "_hour", (F.sum("_n").over(Window.orderBy("_part", "_hour")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part", "_hour").orderBy("_at", user))
    return both.join(hours, ["_part", "_hour"]).select(user, (F.col("_before") + place - 1).cast("int").alias("user_index"))


# -- baselines and metrics ---------------------------------------------------


def global_intercept(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    return test.withColumn("prediction", F.lit(train.agg(F.avg(y)).first()[0]).cast("double"))


def per_user_intercept(train: DataFrame, test: DataFrame, y: str, user: str = "customer") -> DataFrame:
    """The user's train mean; the mean of all for users unseen."""
    means = train.groupBy(user).agg(F.avg(y).alias("_mean"))
    overall = train.agg(F.avg(y)).first()[0]
    return test.join(means, user, "left").withColumn("prediction", F.coalesce("_mean", F.lit(overall).cast("double"))).drop("_mean")


def regression_metrics(df: DataFrame, y: str, yhat: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    """n, mae, rmse and r2, over all rows or per group; r2 null for constant labels."""
    e = F.col(y) - F.col(yhat)
    sse, n = F.sum(e * e), F.count(e)
    sst = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    grouped = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*(keys or []))
    return grouped.agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(sse / n).alias("rmse"), F.when(sst > 1e-12, 1 - sse / sst).alias("r2")
    )


def holdout_baseline(df: DataFrame, y: str, prediction: str = "prediction", share: float = 0.2, least: int = 5, user: str = "customer", ts: str = "sensor_block_end") -> DataFrame:
    """Metrics of the last floor(share * n) rows of each user with ``least`` rows."""
    late = (F.col("of") >= least) & (F.col("place") > F.col("of") - F.floor(F.col("of") * share))
    return regression_metrics(with_place(df, [user], [ts]).where(late), y, prediction)


def holdout_adaptation(df: DataFrame, y: str, share: float = 0.8, user: str = "customer", ts: str = "sensor_block_end") -> DataFrame:
    """Metrics per user of predicting the rest by the mean of the first floor(share * n) rows."""
    rows = with_place(df, [user], [ts]).withColumn("_early", F.col("place") <= F.floor(F.col("of") * share))
    early = F.when(F.col("_early"), F.col(y).cast("double"))
    rows = with_totals(rows, [user], {"_sum": (F.sum, early), "_n": (F.sum, F.when(early.isNotNull(), 1))}, F.to_date(ts))
    return regression_metrics(rows.withColumn("prediction", F.try_divide("_sum", "_n")).where("not _early"), y, keys=[user])


# -- models ------------------------------------------------------------------

LINEAR_GRID = [{"fitIntercept": True}, {"fitIntercept": False}]
FOREST_GRID = [{"numTrees": t, "maxDepth": d} for t, d in itertools.product((50, 100), (4, 5))]


def fit_linear(train: DataFrame, y: str, fitIntercept: bool = True):
    return LinearRegression(featuresCol="features", labelCol=y, fitIntercept=fitIntercept).fit(train)


def fit_forest(train: DataFrame, y: str, numTrees: int = 50, maxDepth: int = 5, seed: int = 42):
    return RandomForestRegressor(featuresCol="features", labelCol=y, numTrees=numTrees, maxDepth=maxDepth, seed=seed).fit(train)


def grid_search(df: DataFrame, n_folds: int, fit, grid: list[dict], y: str):
    """(fitted on all rows, best parameters, mean error per parameters): the grid point
    with the least mean absolute error over the folds.  ``df`` has features and chunk;
    the loop is over folds and parameters, each step a distributed fit."""
    scores = []
    for params in grid:
        errors = []
        for i in range(1, n_folds):
            train, test = fold(df, i)
            if train.isEmpty() or test.isEmpty():
                continue
            errors.append(regression_metrics(fit(train, y, **params).transform(test), y).first().mae)
        scores.append(sum(errors) / len(errors) if errors else math.inf)
    best = grid[scores.index(min(scores))]
    return fit(df, y, **best), best, list(zip(grid, scores))


def shrunk_intercepts(residuals: DataFrame, r: str, sigma2: float = 1.0, tau2: float = 1.0, user: str = "customer") -> DataFrame:
    """user, n, m, ss, b, v: the users' mean residuals shrunk towards 0 by their number
    of rows (b, with its variance v), as one aggregation."""
    per_user = residuals.groupBy(user).agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.sum(F.col(r) * F.col(r)).alias("ss"))
    shrink = F.lit(tau2) / (F.lit(tau2) + F.lit(sigma2) / F.col("n"))
    return per_user.withColumns({"b": shrink * F.col("m"), "v": F.lit(tau2) * (1 - shrink)})


def intercept_variances(per_user: DataFrame) -> DataFrame:
    """sigma2, tau2: the variances of rows and of users that follow from them."""
    sse = F.sum(F.col("ss") - 2 * F.col("b") * F.col("n") * F.col("m") + F.col("n") * (F.col("b") * F.col("b") + F.col("v")))
    return per_user.agg((sse / F.sum("n")).alias("sigma2"), F.avg(F.col("b") * F.col("b") + F.col("v")).alias("tau2"))


def fit_mixed_forest(train: DataFrame, y: str, iterations: int = 5, tolerance: float = 1e-3, user: str = "customer", **forest):
    """(forest, user intercepts, variances) of a random-intercept forest by EM.

    Each round fits a forest to y - b, shrinks the users' mean residuals to new
    intercepts b, and updates both variances; it ends early when they settle.
    Residuals per user are one aggregation, written to the shared folder each round,
    as is the train side at first, which every round reads several times.
    """
    train = written(train.select(user, y, "features"), "train")
    sigma2, tau2 = 1.0, 1.0
    b = train.select(user).distinct().withColumn("b", F.lit(0.0))
    model = None
    for _ in range(iterations):
        model = fit_forest(train.join(b, user).withColumn("_target", F.col(y) - F.col("b")), "_target", **forest)
        residual = model.transform(train).withColumn("_r", F.col(y) - F.col("prediction"))
        per_user = written(shrunk_intercepts(residual, "_r", sigma2, tau2, user), "intercepts")
        row = intercept_variances(per_user).first()
        moved = abs(row.sigma2 - sigma2) + abs(row.tau2 - tau2)
        sigma2, tau2, b = max(row.sigma2, 1e-9), max(row.tau2, 1e-9), per_user.select(user, "b")
        if moved < tolerance:
            break
    return model, b, (sigma2, tau2)


def predict_mixed_forest(fitted, df: DataFrame, user: str = "customer") -> DataFrame:
    """Forest plus the user's intercept; the forest alone for users unseen."""
    model, b, _ = fitted
    found = model.transform(df).join(b, user, "left")
    return found.withColumn("prediction", F.col("prediction") + F.coalesce("b", F.lit(0.0))).drop("b")


def fit_affect_classifier(df: DataFrame, label: str, seed: int = 42, share: float = 0.8, **forest):
    """(model, metrics): forest with balanced class weights; n, accuracy, f1 and auc on
    the rows that a seeded hash of their columns keeps from training."""
    df = written(df, "labelled")  # read for the weights, several times by the fit, and for the scores
    counts = {r[0]: r["count"] for r in df.groupBy(label).count().collect()}
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    own = [c for c, t in df.dtypes if t != "vector" and not t.startswith("map")]
    train, test = hash_split(df.withColumn("_weight", weight), share, seed, own)
    model = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="_weight", seed=seed, **forest).fit(train)
    said = model.transform(test).withColumn("_score", vector_to_array("probability")[1])
    return model, classification_metrics(said, label, score="_score").first().asDict()
