"""K-means: distances, assignment, inits, full and mini-batch steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import seeded


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def nearest(x: Column, centers: list[list[float]]) -> Column:
    """struct<d, k> of the nearest center; of equal distances (9 digits) the first."""
    # one constant array of arrays, so that the compiled code does not grow with k x dimensions
    table = F.array(*[F.lit(np.asarray(c, dtype=np.float64)) for c in centers])
    return F.array_min(F.transform(table, lambda c, k: F.struct(F.round(squared_distance(x, c), 9).alias("d"), k.alias("k"))))


def first_centers(points: DataFrame, k: int) -> list[list[float]]:
    return [r.x for r in points.orderBy("vec_id").limit(k).collect()]


def random_ids(points: DataFrame, k: int, draw: Column) -> list[int]:
    """Ids of k distinct points in the order of ``draw``, then of id; of equal points the first id counts."""
    one = points.groupBy("x").agg(F.min("vec_id").alias("vec_id"))
    return [r.vec_id for r in one.orderBy(draw, "vec_id").limit(k).collect()]


def random_centers(points: DataFrame, k: int, seed: int) -> list[list[float]]:
    """k distinct points by a seeded order."""
    return [r.x for r in points.dropDuplicates(["x"]).orderBy(seeded(seed, "vec_id")).limit(k).collect()]


def lloyd(points: DataFrame, centers: list[list[float]], steps: int) -> list[list[float]]:
    """Full steps; an empty cluster keeps its center."""
    for _ in range(steps):
        means = points.select(nearest(F.col("x"), centers).alias("best"), "x").select("best.k", F.posexplode("x").alias("i", "v")).groupBy("k", "i").agg(F.avg("v").alias("v")).collect()
        centers = [list(c) for c in centers]
        for r in means:
            centers[r.k][r.i] = r.v
    return centers


def plus_plus(points: DataFrame, k: int, shares: list[float] | None = None) -> DataFrame:
    """(round, vec_id, d): centers by squared distance; a round takes the first point, in
    order of vec_id, at which the cumulated distance passes the round's share of the total: a
    uniform draw for k-means++, and a half where no shares are given.
    """
    from ..operators.consistency import running
    from ..functions.ranks import with_position

    spark = points.sparkSession
    chosen = [points.orderBy("vec_id").limit(1).first()]
    out = [(0, chosen[0].vec_id, 0.0)]
    placed = with_position(points, "vec_id", "place")
    for turn in range(1, k):
        d = placed.withColumn("d", nearest(F.col("x"), [c.x for c in chosen]).getField("d"))
        total = d.agg(F.sum("d")).first()[0]
        summed = running(d.select("vec_id", "place", "x", "d"), "place", {"upto": ("sum", F.col("d"))})
        pick = summed.where(F.col("upto") >= (shares[turn] if shares else 0.5) * total).orderBy("place").limit(1).first()
        chosen.append(pick)
        out.append((turn, pick.vec_id, pick.d))
    return spark.createDataFrame(out, "round int, vec_id bigint, d double")


def parallel_init(points: DataFrame, k: int, rounds: int = 5, oversample: float = 2.0, seed: int = 11) -> list[list[float]]:
    """k-means||: oversampled rounds, then weighted k-means++ on the few candidates."""
    candidates = random_centers(points, 1, seed)
    for turn in range(rounds):
        d = points.withColumn("d", nearest(F.col("x"), candidates).getField("d"))
        phi = d.agg(F.sum("d")).first()[0]
        if not phi:
            break
        candidates += [r.x for r in d.where(seeded(seed + 1 + turn, "vec_id") < oversample * k * F.col("d") / phi).select("x").distinct().collect()]
    counts = {r.k: r.n for r in points.select(nearest(F.col("x"), candidates).getField("k").alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    x, weight, rng = np.array(candidates), np.array([counts.get(i, 0) for i in range(len(candidates))], dtype=float), np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    while len(chosen) < min(k, len(x)):
        gap = weight * ((x[:, None, :] - x[None, chosen, :]) ** 2).sum(axis=2).min(axis=1)
        if not gap.sum():
            break
        chosen.append(int(rng.choice(len(x), p=gap / gap.sum())))
    return x[chosen].tolist()


def mini_batch(points: DataFrame, centers: list[list[float]], eta: float = 1.0) -> list[list[float]]:
    """Sequential mini-batch steps of each worker; deltas of centers and counts are summed.

    points: part, vec_id, x. A worker's rows stream in order; only the centers are kept.
    """
    start = np.array(centers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, c, v = None, start.copy(), np.ones(len(start))

        def delta():
            return pd.DataFrame({"k": range(len(start)), "n": v - 1, "delta": list(c - start)})

        for frame in frames:
            for part, x in zip(frame["part"], frame["x"]):
                if part != at:
                    if at is not None:
                        yield delta()
                    at, c, v = part, start.copy(), np.ones(len(start))
                k = int(((c - x) ** 2).sum(axis=1).argmin())
                v[k] += 1
                c[k] -= eta / v[k] * (c[k] - x)
        if at is not None:
            yield delta()

    ordered = points.select("part", "vec_id", "x").repartition("part").sortWithinPartitions("part", "vec_id").drop("vec_id")
    deltas = ordered.mapInPandas(run, "k int, n double, delta array<double>")
    out, counts = start.copy(), np.zeros(len(start))
    for r in deltas.select("k", "n", F.posexplode("delta").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():
        out[r.k, r.i] += r.v
        counts[r.k] = r.n
    return out.tolist()
