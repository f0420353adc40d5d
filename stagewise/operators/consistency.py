"""Serial specifications of the consistency protocols, and cache analytics, over a request log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket of the order at least, and most buckets, which bounds the table of their totals.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 4096


def running(df: DataFrame, order: str, how: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Running sums or maxima in the order of a gapless ``order`` column.

    how: new column -> ("sum" | "max", expression). Each bucket of the order has
    its own window; the totals of earlier buckets come from a table of at most
    ``MOST_BUCKETS`` rows.
    """
    combine = {"sum": F.sum, "max": F.max}
    most = df.agg(F.max(order)).first()[0] or 0
    cut = df.withColumn("_bucket", F.floor(F.col(order) / max(BUCKET_ROWS, -(-(most + 1) // MOST_BUCKETS))))
    totals = cut.groupBy("_bucket").agg(*[combine[kind](value).alias(f"_t_{name}") for name, (kind, value) in how.items()])
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_bucket", *[combine[kind](f"_t_{name}").over(earlier).alias(f"_b_{name}") for name, (kind, _) in how.items()])
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = cut
    for name, (kind, value) in how.items():
        out = out.withColumn(f"_w_{name}", combine[kind](value).over(inside))
    out = out.join(F.broadcast(before), "_bucket")
    for name, (kind, _) in how.items():
        a, b = F.col(f"_b_{name}"), F.col(f"_w_{name}")
        out = out.withColumn(name, F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if kind == "sum" else F.greatest(a, b))
    return out.drop("_bucket", *[f"_{p}_{name}" for name in how for p in "wb"])


def ssp_log(log: DataFrame, workers: int, staleness: int) -> DataFrame:
    """(seq, worker, push, clock, min_clock, admitted): may a request go on at once?

    A worker's clock is its number of pushes before the request; min_clock is
    the least clock of all workers.
    """
    counts = {f"c{w}": ("sum", (F.col("push") & (F.col("worker") == w)).cast("bigint")) for w in range(workers)}
    out = running(log, "seq", counts, inclusive=False)
    clock = F.coalesce(*[F.when(F.col("worker") == w, F.col(f"c{w}")) for w in range(workers)])
    least = F.least(*[F.col(f"c{w}") for w in range(workers)])
    return out.select("seq", "worker", "push", clock.alias("clock"), least.alias("min_clock"), (clock - staleness <= least).alias("admitted"))


def bsp_rounds(log: DataFrame, workers: int) -> DataFrame:
    """(round, n_workers, total, visible): pushes by round, and what a pull after it sees."""
    counts = {f"c{w}": ("sum", (F.col("push") & (F.col("worker") == w)).cast("bigint")) for w in range(workers)}
    clocked = running(log, "seq", counts, inclusive=False).where("push")
    number = F.coalesce(*[F.when(F.col("worker") == w, F.col(f"c{w}")) for w in range(workers)])
    rounds = clocked.groupBy(number.alias("round")).agg(F.count_distinct("worker").alias("n_workers"), F.sum("k").alias("total"))
    return running(rounds, "round", {"visible": ("sum", F.col("total"))})


def bsp_assigned(log: DataFrame, workers: int, epochs: int = 1) -> DataFrame:
    """(epoch, round, key, value): what the pull after a round reads of an assigned key.

    Pushes of a round are one set: of several to a key the one of the largest
    worker, then the last, stays. Clocks and rounds start anew in each epoch,
    the values go on; epochs are equal parts of the log.
    """
    span = (log.agg(F.max("seq")).first()[0] or 0) // epochs + 1
    number = F.count("*").over(Window.partitionBy("worker", "epoch").orderBy("seq")) - 1
    pushes = log.where("push").withColumn("epoch", F.floor(F.col("seq") / span)).withColumn("round", number)
    return pushes.groupBy("epoch", "round", F.col("k").alias("key")).agg(F.max_by("value", F.struct("worker", "seq")).alias("value"))


def bypass_reads(log: DataFrame) -> DataFrame:
    """(seq, k, n_seen): pulls without consistency control read all pushes of the key that came before, of any round."""
    seen = F.sum(F.col("push").cast("bigint")).over(Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("n_seen", F.coalesce(seen, F.lit(0))).where("not push").select("seq", "k", "n_seen")


def refreshes(log: DataFrame, by: tuple[str, str], staleness: int) -> DataFrame:
    """(seq, both of ``by``, fetched): does a request of ``log`` (by, clock, seq) refetch what a cache holds?

    An entry of the cache is a value of ``by``; it is fetched when it is first
    asked for, and when it was fetched more than ``staleness`` clocks ago. Rows
    stream by entry in order; the age of one entry is the only state.
    """
    one, two = by

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, 0
        for frame in frames:
            fetched = []
            for a, b, clock in zip(frame[one].tolist(), frame[two].tolist(), frame["clock"].tolist()):
                new = (a, b) != at or clock - last > staleness
                at, last = (a, b), clock if new else last
                fetched.append(new)
            yield frame[["seq", one, two]].assign(fetched=fetched)

    ordered = log.select("seq", one, two, "clock").repartition(one, two).sortWithinPartitions(one, two, "clock", "seq")
    return ordered.mapInPandas(run, f"seq bigint, {one} bigint, {two} bigint, fetched boolean")


def stale_refreshes(log: DataFrame, staleness: int) -> DataFrame:
    """(worker, chunk, n_reads, n_refreshes) of caches that refetch a chunk older than ``staleness``.

    A worker's clock is its number of earlier requests.
    """
    events = refreshes(log, ("worker", "chunk"), staleness)
    return events.groupBy("worker", "chunk").agg(F.count("*").alias("n_reads"), F.sum(F.col("fetched").cast("bigint")).alias("n_refreshes"))


def lru_hits(log: DataFrame, capacity: int) -> DataFrame:
    """(chunk, n_hits, n_misses) of a least-recently-used cache of ``capacity`` chunks, whatever their number.

    The order is cut into buckets. What the cache holds when a bucket begins
    follows from the last distinct chunks of the buckets before, at most
    ``MOST_BUCKETS`` x ``capacity`` of them; each bucket then streams in order.
    """
    most = log.agg(F.max("seq")).first()[0] or 0
    cut = log.select(F.floor(F.col("seq") / max(BUCKET_ROWS, -(-(most + 1) // MOST_BUCKETS))).alias("bucket"), "seq", "chunk")
    latest = Window.partitionBy("bucket").orderBy(F.desc("seq"))
    last = cut.groupBy("bucket", "chunk").agg(F.max("seq").alias("seq")).withColumn("place", F.row_number().over(latest)).where(F.col("place") <= capacity)
    recent: dict[int, list[int]] = {}
    for r in last.orderBy("bucket", "place").collect():
        recent.setdefault(r.bucket, []).append(r.chunk)
    before, held = {}, []
    for bucket in sorted(recent):
        before[bucket] = held
        held = (recent[bucket] + [c for c in held if c not in recent[bucket]])[:capacity]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cache = None, {}
        for frame in frames:
            hits = []
            for bucket, chunk in zip(frame["bucket"].tolist(), frame["chunk"].tolist()):
                if bucket != at:
                    # a dict keeps its order: the least recent chunk first
                    at, cache = bucket, dict.fromkeys(reversed(before[bucket]))
                hits.append(chunk in cache)
                cache.pop(chunk, None)
                cache[chunk] = None
                if len(cache) > capacity:
                    del cache[next(iter(cache))]
            yield frame[["chunk"]].assign(hit=hits).groupby("chunk", as_index=False)["hit"].agg(n_hits="sum", n="count")

    counted = cut.repartition("bucket").sortWithinPartitions("bucket", "seq").mapInPandas(run, "chunk bigint, n_hits bigint, n bigint")
    return counted.groupBy("chunk").agg(F.sum("n_hits").alias("n_hits"), (F.sum("n") - F.sum("n_hits")).alias("n_misses"))
