"""Training loops: the model is small and stays on the driver, each step is one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.objectives import bind


def descend(samples: DataFrame, terms: list[str], weights: list[float], steps: int, rate: Callable[[int], float]) -> list[float]:
    """Full-gradient steps: w -= rate(t) * gradient(w), every coordinate in one aggregate."""
    for t in range(steps):
        row = samples.agg(*[F.expr(bind(term, weights)).alias(f"g{k}") for k, term in enumerate(terms)]).first()
        weights = [w - rate(t) * g for w, g in zip(weights, row)]
    return weights


def descend_batches(batched: DataFrame, terms: list[str], weights: list[float], batches: list[int], rate: Callable[[int], float]) -> list[float]:
    """Mini-batch steps with weights frozen in a batch; ``batch`` is a column."""
    for t, batch in enumerate(batches):
        row = batched.where(F.col("batch") == batch).agg(*[F.expr(bind(term, weights)).alias(f"g{k}") for k, term in enumerate(terms)]).first()
        if row[0] is not None:
            weights = [w - rate(t) * g for w, g in zip(weights, row)]
    return weights


def local_fold(samples: DataFrame, features: int, step: Callable[[np.ndarray, np.ndarray, float], np.ndarray], state: list[float]) -> DataFrame:
    """Sequential steps of each worker over its own rows in order; (part, n, state).

    Rows stream through a worker's task in order, whatever their number; the
    state is all that is kept. Columns: part, pos, x0 .., y.
    """
    names = [f"x{k}" for k in range(features)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, n, at = None, 0, None
        for frame in frames:
            x, y, parts = frame[names].to_numpy(), frame["y"].to_numpy(), frame["part"].to_numpy()
            for i in range(len(y)):
                if parts[i] != at:
                    if at is not None:
                        yield pd.DataFrame({"part": [at], "n": [n], "state": [current.tolist()]})
                    at, n, current = parts[i], 0, np.array(state, dtype=np.float64)
                current, n = step(current, x[i], y[i]), n + 1
        if at is not None:
            yield pd.DataFrame({"part": [at], "n": [n], "state": [current.tolist()]})

    ordered = samples.select("part", "pos", *names, "y").repartition("part").sortWithinPartitions("part", "pos")
    return ordered.drop("pos").mapInPandas(run, "part bigint, n bigint, state array<double>")


def inverse_decay(alpha: float, every: float) -> Callable[[int], float]:
    """max(1e-5, alpha / (floor(t / floor(c)) + 1))."""
    if every < 1:
        raise ValueError("a decay coefficient must be at least 1")
    return lambda t: max(1e-5, alpha / (t // int(every) + 1))


def linear_decay(alpha: float, step: float) -> Callable[[int], float]:
    return lambda t: alpha - t * step


def exponential_decay(alpha: float, factor: float) -> Callable[[int], float]:
    return lambda t: alpha * factor**t
