"""Questionnaire answers: star join, derived columns, gates, pivots, affect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import calendar_features, plain_title, questionnaire_number, row_mean, study_phase, unique_day_id

PROMPT = ["customer", "unique_day_id"]


#: Answers that a task of the star join holds.
ANSWERS = 1_000_000


def build_ema_long(answers: DataFrame, choice: DataFrame, questions: DataFrame, questionnaires: DataFrame) -> DataFrame:
    """Inner star join of the answers with their three dimensions.

    Many answers are dealt to as many tasks as hold ``ANSWERS`` of them each: left alone,
    small shuffled rows end up in as few tasks as there are cores, whose sorts grow with
    the input."""
    tasks = -(-answers.count() // ANSWERS)
    if tasks > 1:
        answers, choice = (df.repartition(tasks, "question", "element") for df in (answers, choice))
    return answers.join(choice, ["question", "element"]).join(questions, "question").join(questionnaires, "questionnaire")


def derive_ema(df: DataFrame, ts: str = "quest_create") -> DataFrame:
    """Phase, questionnaire number, day and calendar columns, prompt id."""
    df = df.withColumns({"assess": study_phase("study"), "n_questionnaire": questionnaire_number("questionnaire_name"), "quest_title": plain_title("quest_title")})
    df = calendar_features(df, ts).withColumns({"quest_create_day": F.to_date(ts), "quest_create_hour": F.hour(ts)})
    return df.withColumn("unique_day_id", unique_day_id(ts, "n_questionnaire"))


def n_quest(df: DataFrame, keys: list[str], item: str = "n_questionnaire", out: str = "n_quest") -> DataFrame:
    """Distinct questionnaires per group as a column."""
    return df.join(df.groupBy(*keys).agg(F.countDistinct(item).alias(out)), keys, "left")


def compliance_gate(df: DataFrame, min_daily: int = 4, min_days: int = 7, day: str = "quest_create_day") -> DataFrame:
    """Rows of customers with at least ``min_days`` days of ``min_daily`` prompts, and
    n_quest_sum, the prompts of each customer."""
    days = df.groupBy("customer", day).agg(F.countDistinct("unique_day_id").alias("n_daily"))
    kept = days.groupBy("customer").agg(F.count_if(F.col("n_daily") >= min_daily).alias("n_good"), F.sum("n_daily").alias("n_quest_sum"))
    return df.join(kept.where(F.col("n_good") >= min_days).drop("n_good"), "customer")


def pivot_items(df: DataFrame, index: list[str], titles: list[str], value: str = "choice_text") -> DataFrame:
    """Long to wide; of several answers the earliest, then the smallest."""
    first = F.min(F.when(F.col(value).isNotNull(), F.struct("quest_create", value)))
    wide = df.groupBy(*index).pivot("quest_title", titles).agg(first)
    return wide.select(*index, *[F.col(f"`{t}`.{value}").alias(t) for t in titles])


def first_info(df: DataFrame, columns: list[str]) -> DataFrame:
    """First non-null context columns per prompt, by creation time."""
    return df.groupBy(*PROMPT).agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct("quest_create", c))).getField(c).alias(c) for c in columns])


def negative_affect(df: DataFrame, items: list[str], out: str = "mean_na") -> DataFrame:
    """Mean of the prompt's item means."""
    means = df.groupBy(*PROMPT).agg(*[F.avg(F.col(c).try_cast("double")).alias(c) for c in items])
    return means.withColumn(out, row_mean(items))


def phase_bounds(df: DataFrame, day: str = "quest_create_day") -> DataFrame:
    """First and last prompt day of each phase per customer, in columns."""
    own = lambda p: F.when(F.col("assess") == p, F.col(day))
    return df.groupBy("customer").agg(
        *[f(own(p)).alias(f"ema_relative_{n}_phase{p}") for p in (0, 1, 2) for n, f in (("start", F.min), ("end", F.max))]
    )


def session_counts(sessions: DataFrame) -> DataFrame:
    """Sessions begun per customer and phase, in one pass."""
    begun = lambda p: F.count_if((study_phase("study") == p) & F.col("quest_create").isNotNull()).alias(f"n_sessions_phase{p}")
    return sessions.groupBy("customer").agg(*[begun(p) for p in (0, 1, 2)])


def daily_entry_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per customer and day, with the day's number since the first."""
    days = sessions.groupBy("customer", F.to_date("quest_create").alias("day")).agg(F.count("*").alias("n"))
    first = F.min("day").over(Window.partitionBy("customer"))
    return days.withColumn("relative_day", F.date_diff("day", first))


def collapse_clinical(df: DataFrame, largest: str = "ema_watch", order: str = "redcap_event_name") -> DataFrame:
    """One row per for_id: the greatest watch flag, the first non-null of the rest."""
    rest = [c for c in df.columns if c not in ("for_id", largest, order)]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))).getField(c).alias(c)
    return df.groupBy("for_id").agg(F.max(largest).alias(largest), *[first(c) for c in rest])


def mode_per_user(df: DataFrame, columns: list[str], user: str = "customer") -> DataFrame:
    """Most frequent value per user, the smallest of ties."""
    return df.groupBy(user).agg(*[F.mode(c, True).alias(f"{c}_mode") for c in columns])


def binary_na_outcome(df: DataFrame, columns: list[str], user: str = "customer") -> DataFrame:
    """Difference from the user's mode, and what it means; null counts as no change."""
    df = df.join(mode_per_user(df, columns, user), user)
    for c in columns:
        d = F.col(c) - F.col(f"{c}_mode")
        df = df.withColumns({f"{c}_diff": d, f"{c}_outcome": F.when(d > 0, "Improvement").when(d < 0, "Deterioration").otherwise("No Change")})
    return df


def affect_labels(df: DataFrame, pa: str, na: str, user: str = "customer") -> DataFrame:
    """1 where positive affect is below, negative affect above the user's mode."""
    df = df.join(mode_per_user(df, [pa, na], user), user)
    return df.withColumns({"pa_label": F.coalesce((F.col(pa) < F.col(f"{pa}_mode")).cast("int"), F.lit(0)), "na_label": F.coalesce((F.col(na) > F.col(f"{na}_mode")).cast("int"), F.lit(0))})


# -- day numbers and counters ------------------------------------------------


def relative_day_index(df: DataFrame, day: str = "quest_create_day") -> DataFrame:
    return df.withColumn("relative_day", F.dense_rank().over(Window.partitionBy("customer", "assess").orderBy(day)))


def absolute_day_index(df: DataFrame, max_days: int = 16, day: str = "quest_create_day") -> DataFrame:
    """Days since the phase's first, from 1; later days than ``max_days`` go, nulls too."""
    first = F.min(day).over(Window.partitionBy("customer", "assess"))
    return df.withColumn("absolute_day_index", F.date_diff(day, first) + 1).where(F.col("absolute_day_index") <= max_days)


def questionnaire_counter(df: DataFrame) -> DataFrame:
    """Running number of distinct prompts per customer and phase in order of arrival."""
    keys = ["customer", "assess", "unique_day_id"]
    prompts = df.groupBy(*keys).agg(F.min("quest_create").alias("_at"))
    w = Window.partitionBy("customer", "assess").orderBy("_at", "unique_day_id")
    return df.join(prompts.withColumn("questionnaire_counter", F.row_number().over(w)).drop("_at"), keys)


def group_sizes(df: DataFrame, sizes: dict[str, list[str]]) -> DataFrame:
    """Rows per group as extra columns: name -> keys."""
    return df.withColumns({name: F.count("*").over(Window.partitionBy(*keys)) for name, keys in sizes.items()})


def relative_to_first_day(df: DataFrame, day: str) -> DataFrame:
    first = F.min(day).over(Window.partitionBy("customer"))
    return df.withColumns({"first_day": first, "day_offset": F.date_diff(day, first)})


def split_weeks(df: DataFrame, start: str, ts: str) -> DataFrame:
    """Week 1 from the start, week 2 from its ninth day to the fifteenth; rows outside go."""
    n = F.date_diff(F.to_date(ts), F.to_date(start))
    week = F.when(n.between(0, 7), 1).when(n.between(8, 14), 2)
    return df.withColumn("week", week).where("week is not null").withColumn("n_week", F.count("*").over(Window.partitionBy("customer", "week")))


def week_means(df: DataFrame, items: list[str]) -> DataFrame:
    """Mean of item means per customer and week, both weeks in one row."""
    means = df.groupBy("customer", "week").agg(*[F.avg(c).alias(c) for c in items]).select("customer", "week", row_mean(items).alias("m"))
    of = lambda w: F.max(F.when(F.col("week") == w, F.col("m")))
    return means.groupBy("customer").agg(of(1).alias("mean_first"), of(2).alias("mean_second")).dropna()


def scale_means_by_phase(df: DataFrame, prefixes: tuple[str, ...] = ("er_", "panas_")) -> DataFrame:
    """Means of the scales per customer and phase, in long form with plain names."""
    own = [c for c in df.columns if c.startswith(prefixes)]
    means = df.groupBy("customer", "assess").agg(*[F.avg(F.col(c).try_cast("double")).alias(c) for c in own])
    long = means.unpivot(["customer", "assess"], own, "scale", "value")
    plain = reduce(lambda c, p: F.regexp_replace(c, f"^{p}", ""), prefixes, F.col("scale"))
    return long.withColumn("scale", F.initcap(plain))


def ema_blocks(df: DataFrame, hours: float = 2) -> DataFrame:
    """One block per prompt: the hours before its first answer."""
    ends = df.groupBy(*PROMPT).agg(F.min("quest_create").alias("sensor_block_end"))
    start = F.timestamp_micros(F.unix_micros(F.col("sensor_block_end").cast("timestamp")) - F.lit(int(hours * 3_600_000_000)))
    return ends.select("customer", F.concat("customer", "unique_day_id").alias("unique_blocks"), "unique_day_id", start.alias("sensor_block_start"), "sensor_block_end")
