"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id in join keys; turned back into null in results.
NO_ID = -(2**63)

#: Word separators of all operators here: space, tab, newline, VT, FF, CR.
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder.

    The folder is what ``spark.checkpoint.dir`` names; only where that is unset and
    all runs on one machine (local tests) is a temporary folder set up and kept for
    the session.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows survives
    lost executors without recomputing it, and several readers share one run."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``scratch`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own_name(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def columns_of(df: DataFrame) -> list:
    """All columns, whatever their names (dots, quotes)."""
    return [F.col("`{}`".format(c.replace("`", "``"))) for c in df.columns]


#: A key with more than one in so many rows, and LIGHT rows at least, is heavy.
HEAVY, LIGHT = 1_000, 1_000
#: Tasks that the rows of a heavy key are dealt to.
SALTS = 64
#: Rows of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (stored, with narrow rows), broadcast if it has few rows by its count."""
    return F.broadcast(df) if df.count() <= rows else df


def joined(rows: DataFrame, values: DataFrame, keys: list[str], size: str, spread, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``values`` (stored; one row a key), by ``keys``.

    ``size`` is the column of ``values`` with the number of rows that a key has, and
    is dropped.  Heavy keys are fewer than HEAVY, so they are broadcast: their rows are dealt to
    SALTS tasks each by a hash of ``spread``, and their values repeated for each.
    """
    total = values.agg(F.sum(size)).first()[0] or 0
    heavy = values.where(F.col(size) > max(LIGHT, total // HEAVY)).select(*keys)
    if heavy.isEmpty():
        return rows.join(values.drop(size), keys, how)
    salt, many = own_name("salt"), own_name("many")
    marked = F.broadcast(heavy.withColumn(many, F.lit(SALTS)))
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col(many)), F.lit(0)).cast("int")
    left = rows.join(marked, keys, "left").withColumn(salt, part).drop(many)
    parts = F.explode(F.sequence(F.lit(0), F.when(F.col(size) > max(LIGHT, total // HEAVY), SALTS - 1).otherwise(0)))
    return left.join(values.withColumn(salt, parts).drop(size), [*keys, salt], how).drop(salt)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as an empty one."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def with_row_key(docs: DataFrame) -> DataFrame:
    """``did``, ``tk`` and text: a key of each row that holds for null ids and for
    several texts under one id (rows equal in both are equal in every result)."""
    return texts(docs).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("tk"), "text"
    )


def id_or_null(column: str = "did"):
    return F.nullif(F.col(column), F.lit(NO_ID)).alias("doc_id")


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column, without copying it."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return offsets.astype(np.int64), np.zeros(0, np.uint8)
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8)


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def in_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal ``key``, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            held.append(batch.slice(0, int(new[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(new[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
