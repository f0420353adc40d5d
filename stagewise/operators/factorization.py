"""Matrix factorization: alternating least squares and stratified SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def start_factors(ids: DataFrame, key: str, rank: int) -> DataFrame:
    """Deterministic first factors in [0, 1)."""
    return ids.select(key, *[(((F.col(key) * 37 + j * 17) % 100) / 100.0).alias(f"f{j}") for j in range(rank)])


def als_half_step(ratings: DataFrame, by: str, other: str, factors: DataFrame, lam: float) -> DataFrame:
    """New factors of ``by``: (sum q q' + lam n I) f = sum r q, rank 2 in closed form."""
    joined = ratings.join(factors, other)
    sums = joined.groupBy(by).agg(
        F.sum(F.col("f0") * F.col("f0")).alias("a"), F.sum(F.col("f0") * F.col("f1")).alias("b"), F.sum(F.col("f1") * F.col("f1")).alias("c"),
        F.sum(F.col("rating") * F.col("f0")).alias("p"), F.sum(F.col("rating") * F.col("f1")).alias("q"), F.count("*").alias("n"),
    )
    a, c = F.col("a") + lam * F.col("n"), F.col("c") + lam * F.col("n")
    det = a * c - F.col("b") * F.col("b")
    return sums.select(by, ((c * F.col("p") - F.col("b") * F.col("q")) / det).alias("f0"), ((a * F.col("q") - F.col("b") * F.col("p")) / det).alias("f1"))


def als_half_step_any(ratings: DataFrame, by: str, other: str, factors: DataFrame, lam: float, rank: int) -> DataFrame:
    """The same for any rank: the normal equations are partial sums, solved row by row in batches."""
    names = [f"f{j}" for j in range(rank)]
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    joined = ratings.join(factors, other)
    sums = joined.groupBy(by).agg(*[F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(F.col("rating") * F.col(n)).alias(f"r{n}") for n in names], F.count("*").alias("n"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            a = np.zeros((len(t), rank, rank))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = t[f"a{i}_{j}"]
            a += lam * t["n"].to_numpy()[:, None, None] * np.eye(rank)
            f = np.linalg.solve(a, t[[f"r{n}" for n in names]].to_numpy()[:, :, None])[:, :, 0]
            yield pd.DataFrame({by: t[by], **{n: f[:, j] for j, n in enumerate(names)}})

    return sums.mapInPandas(solve, f"{by} bigint, " + ", ".join(f"{n} double" for n in names))


def squared_error(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int = 2) -> DataFrame:
    """(n, mse, rmse) of predictions clamped to [1, 5]."""
    u = users.select("user", *[F.col(f"f{j}").alias(f"u{j}") for j in range(rank)])
    i = items.select("item", *[F.col(f"f{j}").alias(f"i{j}") for j in range(rank)])
    p = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.expr(" + ".join(f"u{j} * i{j}" for j in range(rank)))))
    e = ratings.join(u, "user").join(i, "item").agg(F.count("*").alias("n"), F.avg((F.col("rating") - p) * (F.col("rating") - p)).alias("mse"))
    return e.select("n", F.round("mse", 6).alias("mse"), F.round(F.sqrt("mse"), 6).alias("rmse"))


def sgd_epoch(ratings: DataFrame, users: DataFrame, items: DataFrame, blocks: int, eta: float) -> tuple[DataFrame, DataFrame]:
    """One stratified epoch: in sub-step s worker w has user block w and item block (s + w) mod blocks.

    Blocks of a stratum share no user and no item, so their order is free. The
    edges of a block stream in order; a worker keeps its factors only, so blocks
    are chosen so that a block's factors fit in a task. New factors are written
    after each sub-step, which the next one reads.
    """
    spark = ratings.sparkSession
    for s in range(blocks):
        rows = ratings.withColumn("w", F.col("user") % blocks).where((F.col("item") % blocks) == (F.col("w") + s) % blocks)
        edges = rows.join(users.toDF("user", "u0", "u1"), "user").join(items.toDF("item", "i0", "i1"), "item")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            u: dict[int, tuple[float, float]] = {}
            v: dict[int, tuple[float, float]] = {}
            for t in batches:
                for user, item, rating, u0, u1, i0, i1 in zip(*(t[c].tolist() for c in ("user", "item", "rating", "u0", "u1", "i0", "i1"))):
                    (a0, a1), (b0, b1) = u.get(user, (u0, u1)), v.get(item, (i0, i1))
                    e = eta * (rating - a0 * b0 - a1 * b1)
                    u[user], v[item] = (a0 + e * b0, a1 + e * b1), (b0 + e * a0, b1 + e * a1)
            for kind, d in (("u", u), ("i", v)):
                if d:
                    f = np.array(list(d.values()))
                    yield pd.DataFrame({"kind": kind, "id": list(d), "f0": f[:, 0], "f1": f[:, 1]})

        path = shared_folder(spark, "factors")
        edges.repartition("w").sortWithinPartitions("w", "user", "item").mapInPandas(run, "kind string, id bigint, f0 double, f1 double").write.partitionBy("kind").parquet(path)
        new = spark.read.schema("id bigint, f0 double, f1 double, kind string").parquet(path)
        merge = lambda old, key, kind: old.join(new.where(F.col("kind") == kind).select(F.col("id").alias(key), F.col("f0").alias("n0"), F.col("f1").alias("n1")), key, "left").select(key, F.coalesce("n0", "f0").alias("f0"), F.coalesce("n1", "f1").alias("f1"))
        users, items = merge(users, "user", "u"), merge(items, "item", "i")
    return users, items
