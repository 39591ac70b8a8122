"""Missingness of the feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import ACTIVITY_CODES
from .sensors import MISSING

ACTIVITY = [f"activity_{c}_minutes" for c in ACTIVITY_CODES]
PLENTY_OF_STEPS = 625


def _gone(c: str) -> Column:
    return F.col(c) == MISSING


def _all_gone(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, map(_gone, columns))


def drop_all_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(~F.coalesce(_all_gone(columns), F.lit(False)))


def classify_missing_gps(df: DataFrame) -> DataFrame:
    kind = F.when(_gone("n_GPS") & (F.col("n_steps") > PLENTY_OF_STEPS), "Steps>625").when(_gone("n_GPS") & (F.col("n_steps") <= PLENTY_OF_STEPS), "Steps<=625")
    return df.withColumn("missing_GPS", kind.when(F.col("n_GPS") != MISSING, "GPS_present").otherwise("Unknown"))


def classify_missing_steps(df: DataFrame) -> DataFrame:
    rest = _all_gone(["hr_mean", *ACTIVITY])
    kind = F.when(_gone("n_steps") & rest, "step_missing").when(_gone("n_steps") & ~rest, "step_zero")
    return df.withColumn("missing_steps", kind.when(F.col("n_steps") != MISSING, "not_missing").otherwise("Unknown"))


def classify_missing_pa(df: DataFrame) -> DataFrame:
    first, rest = ACTIVITY[0], _all_gone(["n_steps", "hr_mean"])
    kind = F.when(F.col(first) != MISSING, "not_missing").when(_gone(first) & rest, "pa_missing").when(_gone(first) & ~rest, "pa_zero")
    return df.withColumn("missing_pa", kind.otherwise("Unknown"))


def classify_missing_hr(df: DataFrame) -> DataFrame:
    """Both cases of a missing heart rate share one name."""
    kind = F.when(_gone("hr_mean"), "hr_missing").when(F.col("hr_mean") != MISSING, "not_missing")
    return df.withColumn("missing_hr", kind.otherwise("Unknown"))


def implausible_beeps(df: DataFrame, steps: float = PLENTY_OF_STEPS, ratio: float = 0.5) -> DataFrame:
    """customer, share of blocks with many steps but no place, and whether to drop."""
    odd = _gone("at_home_minute") & (F.col("n_steps") > steps)
    found = df.groupBy("customer").agg(F.count("*").alias("n_blocks"), F.count_if(odd).alias("n_implausible"))
    share = F.col("n_implausible") / F.col("n_blocks")
    return found.withColumns({"share": share, "implausible": share > ratio})


def missing_flags(df: DataFrame, groups: dict[str, list[str]], static: list[str]) -> DataFrame:
    """1 per group with any column missing in the row; person_static: 1 for every row
    of a customer with a null in any of their rows."""
    flags = {g: F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(_gone(c), F.lit(True)) for c in own]), F.lit(False)).cast("int") for g, own in groups.items()}
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in static]) if static else F.lit(False)
    flags["person_static"] = F.max(any_null.cast("int")).over(Window.partitionBy("customer"))
    return df.withColumns({f"missing_{g}": f for g, f in flags.items()})


def summarize_missing_data(df: DataFrame, columns: list[str], static: list[str]) -> DataFrame:
    """Long table: column, missing rows (or customers, for static columns), percent."""
    rows = df.agg(F.count("*").alias("n"), *[F.count_if(_gone(c) | F.col(c).isNull()).alias(c) for c in columns])
    people = df.groupBy("customer").agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in static])
    people = people.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in static])
    long = lambda one, own: one.unpivot(["n"], own, "feature", "missing")
    both = long(rows, columns).unionByName(long(people, static)) if static else long(rows, columns)
    return both.select("feature", "missing", (F.try_divide("missing", "n") * 100).alias("percent"))
