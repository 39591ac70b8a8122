"""Written intermediate tables, and joins that deal out keys with many rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that the rows of a heavy key are dealt to.
PARTS = 64
#: A key is heavy with more rows than this and more than one in so many of all rows.
LEAST, SHARE = 10_000, 1_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; where that is
    unset, which only a local master may leave, below a temporary one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: computed once, and safe
    from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def heavy_keys(sizes: DataFrame, size: str) -> DataFrame | None:
    """The keys (other columns of ``sizes``, one row a key) that hold a large share of
    all rows: fewer than SHARE of them, so they may be broadcast.  None: no such key."""
    total = sizes.agg(F.sum(size)).first()[0] or 0
    found = sizes.where(F.col(size) > max(LEAST, total // SHARE)).drop(size)
    return None if found.isEmpty() else found


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], heavy: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``; rows of ``many`` with a heavy key are dealt to PARTS tasks by
    their columns ``by``, and the rows of ``few`` with that key are repeated for each."""
    if heavy is None:
        return many.join(few, keys, how)
    mark, part = (f"{n}_{uuid.uuid4().hex}" for n in ("mark", "part"))
    marked = F.broadcast(heavy.select(*keys).withColumn(mark, F.lit(True)))
    left = many.join(marked, keys, "left")
    left = left.withColumn(part, F.when(F.col(mark), F.pmod(F.xxhash64(*by), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")).drop(mark)
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col(mark), PARTS - 1).otherwise(0)))
    right = few.join(marked, keys, "left").withColumn(part, copies).drop(mark)
    return left.join(right, [*keys, part], how).drop(part)
