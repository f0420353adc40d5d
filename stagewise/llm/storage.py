"""Shared storage for intermediate tables.

Lineage is cut by writing Parquet under the folder that the session names in
``spark.checkpoint.dir``; every executor can read it again after a loss.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode, where none is set, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "stagewise-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to shared storage and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stagewise-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stagewise_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more.

    The JVM is asked to collect its garbage, as Spark's cleaner removes the
    shuffle files of finished jobs only when the driver's references are gone.
    """
    for df in tables:
        path = df.stagewise_path
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can clash with nothing."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores, which no column of the table has."""
    while name in (c.lower() for c in df.columns):
        name += "_"
    return name


def row_hash() -> Column:
    """A 64-bit key of a row, made of doc_id and text: equal for repeated rows (and some 270 pairs of 10^11 others)."""
    return F.xxhash64("doc_id", "text")


def by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the row's hash in the place of doc_id."""
    return docs.select(row_hash().alias("doc_id"), "text")


def drop_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows whose hash is no doc_id of ``found``, a materialized table."""
    key = free_name(docs, "row_key")
    return docs.withColumn(key, row_hash()).join(found.select(F.col("doc_id").alias(key)), key, "left_anti").drop(key)


def hash_bitmap(df: DataFrame, column: str, digits: int = 24) -> np.ndarray:
    """Bits of the leading binary digits of 64-bit hashes: 2 MB, and 2^18 rows for the driver at most.

    The size does not depend on the table; a fuller bitmap only lets more strangers pass.
    """
    top = f"shiftrightunsigned({column}, {64 - digits})"
    words = df.selectExpr(f"shiftright({top}, 6) as at", f"shiftleft(1L, cast({top} & 63 as int)) as bit")
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (digits - 6), dtype=np.int64)
    bits[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return bits.view(np.uint64)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) hashes the bitmap lets pass."""
    digits = 6 + len(bits).bit_length() - 1
    at = hashes >> np.uint64(64 - digits)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


#: Rows up to which a table of one or two 64-bit columns may be broadcast: 16 MB of them.
BROADCAST_ROWS = 1_000_000


def few_rows(df: DataFrame) -> DataFrame:
    """A materialized table, with a broadcast hint if it has one or two 64-bit columns and at most ``BROADCAST_ROWS`` rows."""
    narrow = len(df.columns) <= 2 and all(kind == "bigint" for _, kind in df.dtypes)
    return F.broadcast(df) if narrow and df.count() <= BROADCAST_ROWS else df
