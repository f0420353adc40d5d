"""Positions over a whole table without a single-task window."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket that one window call ranks, and most buckets, which bounds the table of their starts.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 4096


def _quantile_ranges(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``name``: number of the range of ``key`` with about as many rows as the others, whatever the keys' spread."""
    buckets = min(MOST_BUCKETS, n // BUCKET_ROWS)
    if buckets < 2:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    value = F.col(key).cast("double").alias(key)
    cuts = df.select(value).approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=f"{name}_key", outputCol=f"{name}_cut", handleInvalid="keep")
    out = cut.transform(df.withColumn(f"{name}_key", F.col(key).cast("double")))
    return out.withColumn(name, F.col(f"{name}_cut").cast("bigint")).drop(f"{name}_key", f"{name}_cut")


def with_position(df: DataFrame, key: str, name: str = "pos", by: tuple[str, ...] = (), tie: tuple[str, ...] = ()) -> DataFrame:
    """Numbers from 0 in the order of a numeric ``key``, then ``tie``, within ``by``.

    Keys are cut at approximate quantiles; a window ranks each range, and the
    sums of the counts of earlier ranges are added, a table of at most
    ``MOST_BUCKETS`` rows for each value of ``by``. Rows of one key lie in one range.
    """
    cut = _quantile_ranges(df, key, df.count(), "_range")
    counts = cut.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(key, *tie)) - 1
    ranked = cut.withColumn("_place", place)
    joined = ranked.join(starts if by else F.broadcast(starts), [*by, "_range"])
    return joined.withColumn(name, (F.col("_before") + F.col("_place")).cast("bigint")).drop("_range", "_place", "_before")


def seeded(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on keys and seed alone, not on partitions."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def seeded_values(seed: int, *keys: tuple[np.ndarray, np.ndarray | None]) -> np.ndarray:
    """``seeded`` in Python, of long keys (values, which of them are not null, or None for all)."""
    with np.errstate(over="ignore"):
        h = np.full(len(keys[0][0]), 42, np.uint64)
        for values, known in keys:
            one = _turned(values.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
            new = _mixed(_turned((h + _P5 + np.uint64(8)) ^ one, 27) * _P1 + _P4)
            h = new if known is None else np.where(known, new, h)
        h = _mixed(_turned((h + _P5 + np.uint64(4)) ^ (np.uint64(seed & 0xFFFFFFFF) * _P1), 23) * _P2 + _P3)
    return (h & np.uint64((1 << 52) - 1)).astype(float) / float(1 << 52)


def lattice(seed: int, key: str, size: int = 9973) -> Column:
    """A number in [0, 1) from integer arithmetic alone, so that SQL can draw it too; ``LATTICE`` is its text."""
    return F.expr(LATTICE.format(key=key, seed=seed, size=size))


LATTICE = "cast(((({key} % 1000003) * 7919 + {seed}) * 104729 + {seed} * 31) % {size} as double) / {size}"
