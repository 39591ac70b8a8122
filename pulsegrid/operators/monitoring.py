"""Study monitoring: compliance, interruptions, alerts, weekly tasks."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import LONG_VERSIONS, SHORT_VERSIONS

#: Statuses of participants who are being observed.
ACTIVE = ("Erhebung_1_aktiv", "Post_Erhebung_1", "Erhebung_2_aktiv", "Post_Erhebung_2", "Erhebung_3_aktiv")


def compliance_outer(*tables: DataFrame) -> DataFrame:
    """Full outer joins on customer of small per-customer tables."""
    found = tables[0]
    for t in tables[1:]:
        found = found.join(t, "customer", "full")
    return found


def compliance_table(roster: DataFrame, passive: DataFrame, gps: DataFrame, counts: DataFrame, statuses=ACTIVE) -> DataFrame:
    """Last data and session counts of active participants.  ``passive`` and ``gps``
    have customer, last_day_passive and last_day_GPS."""
    return compliance_outer(passive, roster, counts, gps).where(F.col("status").isin(*statuses))


def interruptions(table: DataFrame, week_ago: datetime.date, no_watch: list[str] = (), no_gps: list[str] = ()) -> DataFrame:
    """customer ids with a category: no_pd, no_gps, no_gpspd, no_gps_at_all; ids known
    to have no watch or GPS are left out of the categories that this explains."""
    g, p, ago = F.col("last_day_GPS"), F.col("last_day_passive"), F.lit(week_ago)
    watch, place = F.col("for_id").isin(*no_watch), F.col("for_id").isin(*no_gps)
    category = (
        F.when((g > ago) & (p < ago), F.when(~watch, "no_pd"))
        .when((g < ago) & (p > ago), F.when(~place, "no_gps"))
        .when((g < ago) & (p < ago), "no_gpspd")
        .when(g.isNull(), F.when(~place, "no_gps_at_all"))
    )
    return table.select("customer", "for_id", category.alias("category")).where("category is not null")


def alert_rows(found: DataFrame, today: datetime.date) -> DataFrame:
    """One row per alert, with its date and the id in its category's column."""
    own = lambda c: F.when(F.col("category") == c, F.col("for_id")).alias(c)
    return found.select(F.lit(today).alias("Datum"), *[own(c) for c in ("no_pd", "no_gps", "no_gpspd", "no_gps_at_all")])


def weekly_tasks(roster: DataFrame, week_start: datetime.date) -> DataFrame:
    """day (0: Monday), task, ids: who is due for what in the week.  Weekend tasks are
    there again for Monday, named after their day."""
    long, short = F.col("study_version").isin(*LONG_VERSIONS), F.col("study_version").isin(*SHORT_VERSIONS)
    before = lambda c: F.date_add(c, 1)  # noqa: E731  the day after an end
    rules = [
        ("onboarding", F.col("first_call_date"), F.lit(True)),
        ("baseline_end_long", before("ema_base_end"), long),
        ("t20_start", F.col("ema_t20_start"), F.lit(True)),
        ("t20_end", before("ema_t20_end"), F.lit(True)),
        ("short_ends_today", F.col("ema_base_end"), short),
        ("short_end", before("ema_base_end"), short),
        ("long_finished", before("ema_t20_end"), F.contains("t20_post", F.lit("ja"))),
        ("post_start", F.col("ema_post_start"), F.lit(True)),
        ("post_end", before("ema_post_end"), F.lit(True)),
    ]
    due = F.array(*[F.struct(F.lit(name).alias("task"), F.when(test, day).alias("due")) for name, day, test in rules])
    rows = roster.select("for_id", F.explode(due).alias("r")).select("for_id", "r.task", F.date_diff("r.due", F.lit(week_start)).alias("day"))
    rows = rows.where(F.col("day").between(0, 6))
    again = rows.where("day >= 5").select(
        "for_id", F.concat(F.when(F.col("day") == 5, "saturday: ").otherwise("sunday: "), "task").alias("task"), F.lit(0).alias("day")
    )
    return rows.unionByName(again).groupBy("day", "task").agg(F.array_join(F.array_sort(F.collect_list("for_id")), ",").alias("ids"))
