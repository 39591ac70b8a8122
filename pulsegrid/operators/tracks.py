"""Neighbours, ranks and totals within a group, without a group's rows in one task.

Rows meet in segments of a group: days of the first column that orders them, or what
the caller names, which must rise with it.  What crosses segments goes through a table
of a row for each segment, and comes back by a join on the segment, so that a task
holds segments, never a participant.  Nulls in keys are values, as in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _part(keys: list[str], order: list[str], segment: Column | None) -> Column:
    return F.struct(*keys, (F.to_date(order[0]) if segment is None else segment).alias("segment"))


def _along(keys: list[str]):
    """Segments of a group in their order."""
    return Window.partitionBy(F.struct(*[F.col("_part")[k].alias(k) for k in keys])).orderBy(F.col("_part")["segment"])


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], before: list[str] = (), after: list[str] = (), segment: Column | None = None) -> DataFrame:
    """Adds ``before_<c>`` and ``after_<c>``: the value of the row before and after in
    each group of ``keys`` by ``order`` (null at its ends).  Rows that are equal in
    ``order`` follow each other in any order, as in a window; nulls come first."""
    rows = df.withColumn("_part", _part(keys, order, segment))
    within = Window.partitionBy("_part").orderBy(*order)
    place = {**{f"before_{c}": F.lag(c).over(within) for c in before}, **{f"after_{c}": F.lead(c).over(within) for c in after}}
    place |= {"_first": F.row_number().over(within) == 1, "_last": F.lead(F.lit(True)).over(within).isNull()}
    # The edges are the rows that the window has put first and last, so that rows that
    # are equal in ``order`` have neighbours that agree with each other.
    rows = rows.withColumns(place)
    value = lambda cs, at: F.max(F.when(F.col(at), F.struct(*cs)))
    edges = {"_edge_before": value(before, "_last")} if before else {}
    edges |= {"_edge_after": value(after, "_first")} if after else {}
    ends = rows.groupBy("_part").agg(*[c.alias(n) for n, c in edges.items()])
    along = _along(keys)
    moved = {n: (F.lag if n == "_edge_before" else F.lead)(n).over(along) for n in edges}
    met = rows.join(ends.withColumns(moved), "_part")
    filled = {f"before_{c}": F.when(F.col("_first"), F.col("_edge_before")[c]).otherwise(F.col(f"before_{c}")) for c in before}
    filled |= {f"after_{c}": F.when(F.col("_last"), F.col("_edge_after")[c]).otherwise(F.col(f"after_{c}")) for c in after}
    return met.withColumns(filled).drop("_part", "_first", "_last", *edges)


def with_place(df: DataFrame, keys: list[str], order: list[str], segment: Column | None = None) -> DataFrame:
    """Adds ``place`` (from 1, as ``row_number``) and ``of`` (rows) in each group of
    ``keys`` by ``order``: the place in the segment and the rows of those before."""
    rows = df.withColumn("_part", _part(keys, order, segment))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes, along = rows.groupBy("_part").agg(F.count("*").alias("_n")), _along(keys)
    sizes = sizes.select("_part", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("of"))
    return rows.join(sizes, "_part").withColumn("place", F.col("place") + F.col("_before")).drop("_part", "_before")


def tile(n: int) -> Column:
    """``ntile(n)`` of a row from its place and the rows of its group."""
    size, longer = F.expr(f"of div {n}"), F.expr(f"of % {n}")
    split = longer * (size + 1)  # places in the tiles that are longer by one
    early = F.floor((F.col("place") - 1) / (size + 1))
    late = longer + F.floor((F.col("place") - 1 - split) / F.greatest(size, F.lit(1)))
    return F.when(F.col("place") <= split, early).otherwise(late).cast("int") + 1


def with_totals(df: DataFrame, keys: list[str], totals: dict[str, tuple], segment: Column) -> DataFrame:
    """Adds totals over each group of ``keys``: name -> (F.sum, F.min or F.max, column).
    Segments need no order here; any column that spreads a group's rows will do."""
    rows = df.withColumn("_part", F.struct(*keys, segment.alias("segment")))
    parts = rows.groupBy("_part").agg(*[f(c).alias(n) for n, (f, c) in totals.items()])
    whole = Window.partitionBy(F.struct(*[F.col("_part")[k].alias(k) for k in keys]))
    return rows.join(parts.select("_part", *[f(n).over(whole).alias(n) for n, (f, _) in totals.items()]), "_part").drop("_part")
