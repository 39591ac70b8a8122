"""Places in a total order, without a task that takes all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def numbered(df: DataFrame, order: list, column: str, name: str) -> DataFrame:
    """``df`` stored in ``order``, with each row's place in it from 0 as ``column``.

    Rows are dealt out by ranges of ``order`` and sorted within them; a place is the
    row's place within its range plus the rows of the ranges before.  Rows that are
    equal in ``order`` lie in one range: an order whose ties may be many needs a
    further column.
    """
    at, part, n = common.own_name("at"), common.own_name("part"), common.own_name("n")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = common.stored(dealt, name).withColumn(part, F.shiftright(at, 33))
    ranges = rows.groupBy(part).agg(F.count("*").alias(n))  # a row for each range
    before = ranges.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(n))
    place = F.col(n) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), part).withColumn(column, place).drop(part, at, n)
