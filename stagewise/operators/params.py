"""The keyed parameter table: ranges, pulls, pushes, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def chunk_ranges(max_key: int, chunk: int, servers: int) -> list[tuple[int, int, int, int, int]]:
    """(server, begin, end, first chunk, last chunk exclusive) of contiguous, even chunk ranges.

    The first servers take the chunks that are left over; the last key range is
    clipped, and a server without chunks gets an empty range at the end.
    """
    chunks = (max_key - 1) // chunk + 1
    share, more = divmod(chunks, servers)
    out, at = [], 0
    for s in range(servers):
        to = at + share + (s < more)
        out.append((s, min(at * chunk, max_key), min(to * chunk, max_key), at, to))
        at = to
    return out


def custom_ranges(num_users: int, num_items: int, servers: int) -> list[tuple[int, int, int]]:
    """(server, begin, end): users on the first half of the servers, items on the second."""
    half = max(1, servers // 2)
    first = [(s, b, e) for s, b, e, _, _ in chunk_ranges(num_users, 1, half)]
    rest = [(s + half, b + num_users, e + num_users) for s, b, e, _, _ in chunk_ranges(num_items, 1, max(1, servers - half))]
    return first + rest


def range_table(spark: SparkSession, ranges: list[tuple]) -> DataFrame:
    return spark.createDataFrame([r[:3] for r in ranges], "server int, begin bigint, end bigint")


def server_of(key: Column, ranges: list[tuple]) -> Column:
    """The server of a key; ranges are few, so the lookup is an expression and no join."""
    out = F.lit(None).cast("int")
    for server, begin, end, *_ in ranges:
        out = F.when((key >= begin) & (key < end), F.lit(server)).otherwise(out)
    return out


def pull(params: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of the asked keys; a missing key is 0."""
    return keys.select("key").distinct().join(params, "key", "left").select("key", F.coalesce("val", F.lit(0.0)).alias("val"))


def push_add(params: DataFrame, delta: DataFrame) -> DataFrame:
    """Sum of the stored values and all pushes, partially aggregated before the shuffle."""
    return params.select("key", "val").unionByName(delta.select("key", "val")).groupBy("key").agg(F.sum("val").alias("val"))


def push_assign(params: DataFrame, delta: DataFrame) -> DataFrame:
    """The last push of a key (largest seq) replaces its value."""
    last = delta.groupBy("key").agg(F.max_by("val", "seq").alias("new"))
    return params.join(last, "key", "full_outer").select("key", F.coalesce("new", "val").alias("val"))


def to_chunks(params: DataFrame, chunk: int) -> DataFrame:
    """(chunk_id, vals): rows of ``chunk`` values in key order, the last one short."""
    rows = params.groupBy(F.floor(F.col("key") / chunk).alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("key") % chunk).alias("i"), "val"))).alias("rows"))
    return rows.select("chunk_id", F.col("rows.val").alias("vals"))


def push_chunks(chunks: DataFrame, delta: DataFrame, assign: bool = False) -> DataFrame:
    """Chunk rows with pushed rows added element by element, or put in their place."""
    pushed = delta.select("chunk_id", F.col("vals").alias("more"))
    joined = chunks.join(pushed, "chunk_id", "left")
    added = F.zip_with("vals", "more", lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    return joined.select("chunk_id", F.when(F.col("more").isNull(), F.col("vals")).otherwise(F.col("more") if assign else added).alias("vals"))


def dump(params: DataFrame, path: str, chunk: int) -> None:
    """Keys and values in key order, files clustered by chunk so that a load of some chunks skips the others."""
    rows = params.withColumn("chunk_id", F.floor(F.col("key") / chunk))
    rows.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id", "key").write.parquet(path)


def load(spark: SparkSession, path: str, chunks: list[int] | None = None) -> DataFrame:
    """(key, val) of a dumped model, or of the named chunks; the filter reaches the files' statistics."""
    rows = spark.read.parquet(path)
    return (rows if chunks is None else rows.where(F.col("chunk_id").isin(chunks))).select("key", "val")


def hot_cold_pull(params: DataFrame, reads: DataFrame, hot_share: int) -> DataFrame:
    """Values read by key: the hottest keys from a broadcast pool, the others by a shuffle.

    A key is hot if it has more than one read in ``hot_share``; there are fewer
    than ``hot_share`` such keys, which bounds the pool.
    """
    counts = reads.groupBy("key").agg(F.count("*").alias("n"))
    total = reads.count()
    hot = counts.where(F.col("n") * hot_share > total).select("key").join(params, "key").select("key", F.col("val").alias("hot_val"))
    marked = reads.join(F.broadcast(hot), "key", "left")
    warm = marked.where("hot_val is not null").select(*reads.columns, F.lit(True).alias("hot"), F.col("hot_val").alias("val"))
    cold = marked.where("hot_val is null").drop("hot_val").join(params, "key", "left").select(*reads.columns, F.lit(False).alias("hot"), F.coalesce("val", F.lit(0.0)).alias("val"))
    return warm.unionByName(cold)


def bucketed(params: DataFrame, name: str, buckets: int) -> DataFrame:
    """A store kept as a table bucketed and sorted by key: pulls and pushes of tables bucketed alike need no shuffle."""
    params.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").mode("overwrite").saveAsTable(name)
    return params.sparkSession.table(name)


def push_add_joined(params: DataFrame, delta: DataFrame) -> DataFrame:
    """``push_add`` of deltas with one row a key, as a join that uses the sides' buckets."""
    both = params.select("key", "val").join(delta.select("key", F.col("val").alias("more")), "key", "full_outer")
    return both.select("key", (F.coalesce("val", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("val"))


def pull_joined(params: DataFrame, keys: DataFrame) -> DataFrame:
    """``pull`` of distinct keys, as a join that uses the sides' buckets."""
    return keys.select("key").join(params, "key", "left").select("key", F.coalesce("val", F.lit(0.0)).alias("val"))
