"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked through the text's digest, a virtual node,
so a group of any size has one edge per member. Every document starts in the
shard of its hash. In each round a group wants the shard that most of its
members are in; members elsewhere ask to move there and are admitted while the
shard has room for linked documents. Unlinked documents then fill every shard up
to its quota, and linked ones beyond a quota are moved with them, so that shards
differ by at most one row (law ``rows``) while cut edges stay few.

Ranks inside a shard are counted in two levels: a window over (shard, bucket),
plus the sums of the buckets before it, of which there are at most some
``MOST_BUCKETS`` whatever the table's size. No shard, group
or window is ever gathered into one task. ``cut_edges`` measures what the
propagation gains.

Edge cases: null text has size 8 and crc32 0, and null texts are equal to each
other and to no other text; repeated rows of a doc_id are sharded each; a null
doc_id is sharded like others; ties go by hash, then doc_id; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import keep_columns, materialize

SHARDS = 24
ROUNDS = 3
#: Rows of one bucket of the two-level ranks, and most buckets of a rank.
BUCKET_ROWS = 20_000
MOST_BUCKETS = 4096


def _ranked(df: DataFrame, by: list[str], order: Column, buckets: int, name: str, tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Gapless numbers from 0 within ``by``, in the order of (bucket of order, salt, order, tie).

    The salt cuts a group that is larger than a bucket into several buckets.
    """
    cut = df.withColumn("_order", order).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_order", 40), F.lit(buckets)))
    cut = cut if "salt" in df.columns else cut.withColumn("salt", F.lit(0))
    local = F.row_number().over(Window.partitionBy(*by, "_bucket", "salt").orderBy("_order", *tie)) - 1
    sizes = cut.groupBy(*by, "_bucket", "salt").agg(F.count("*").alias("_n"))
    # shards x buckets rows, and the salts of large groups: both bounded; the join has the window's partitions
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before).drop("_n")
    return cut.withColumn("_local", local).join(starts, [*by, "_bucket", "salt"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_order", "_bucket", "_local", "_before")


def _salt(total: int) -> Column:
    """Part of a group whose ``members`` are more than a bucket's rows."""
    rows = max(BUCKET_ROWS, total // MOST_BUCKETS)
    return F.pmod(F.xxhash64("row"), F.ceil(F.coalesce(F.col("members"), F.lit(1)) / rows)).cast("int").alias("salt")


def _pick(shard: Column, values: list[int]) -> Column:
    """values[shard] as an expression."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), shard + 1)


def _counts(df: DataFrame, shards: int, column: str = "shard") -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(column).agg(F.count("*")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): row counts of shards at most one apart."""
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    base = keep_columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(raw) + 8).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5(raw)).otherwise(F.lit("null")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = materialize(base, "documents")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    buckets = min(MOST_BUCKETS, max(1, math.ceil(total / shards / BUCKET_ROWS)))
    groups = base.groupBy("digest").agg(F.count("*").alias("members")).where("members > 1")
    linked = base.join(groups, "digest").select("row", "doc_id", "digest", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), _salt(total))
    linked = materialize(linked, "linked")
    n_linked, columns = linked.count(), linked.columns
    for turn in range(rounds if n_linked else 0):
        # label propagation: the virtual node takes its members' most frequent shard
        votes = linked.groupBy("digest", "shard").agg(F.count("*").alias("votes"))
        wanted = votes.groupBy("digest").agg(F.max_by("shard", F.struct("votes", F.xxhash64("digest", "shard"))).alias("wanted"), F.sum("votes").alias("members"))
        asked = linked.join(wanted, "digest")
        held = _counts(asked.where("shard = wanted"), shards)
        room = [max(0, quota[s] - held[s]) for s in range(shards)]
        movers = _ranked(asked.where("shard <> wanted"), ["wanted"], F.xxhash64(F.lit(turn), "digest"), buckets, "place", ("digest", "row"))
        moved = movers.withColumn("shard", F.when(F.col("place") < _pick(F.col("wanted"), room), F.col("wanted")).otherwise(F.col("shard")))
        linked = materialize(asked.where("shard = wanted").select(*columns).unionByName(moved.select(*columns)), "linked")
    # linked documents beyond their shard's quota join the unlinked ones
    placed = _ranked(linked, ["shard"], F.xxhash64("digest"), buckets, "place", ("digest", "row"))
    kept = materialize(placed.where(F.col("place") < _pick(F.col("shard"), quota)).select("row", "shard"), "kept")
    load = _counts(kept, shards)
    ends, filled = [], 0
    for s in range(shards):
        filled += quota[s] - load[s]
        ends.append(filled)
    rest = base.select("row", "digest").join(kept.select("row"), "row", "left_anti").join(groups, "digest", "left").select("row", "digest", _salt(total), F.lit(0).alias("all"))
    fill_buckets = min(MOST_BUCKETS, max(1, math.ceil(total / BUCKET_ROWS)))
    # neighbours in this order have equal texts, so that what was moved stays together
    ordered = _ranked(rest, ["all"], F.xxhash64("digest"), fill_buckets, "place", ("digest", "row"))
    shard = F.lit(0)
    for s in range(shards - 1):
        shard = shard + (F.col("place") >= ends[s]).cast("int")
    assigned = kept.unionByName(ordered.select("row", shard.alias("shard")))
    full = base.join(assigned, "row")
    return _ranked(full, ["shard"], F.xxhash64("digest", "row"), buckets, "slot", ("digest", "row")).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"))


def cut_edges(rows: DataFrame) -> int:
    """Edges between a group and members outside the shard where most of it lies; rows: (digest, shard)."""
    parts = rows.groupBy("digest", "shard").agg(F.count("*").alias("n")).groupBy("digest").agg((F.sum("n") - F.max("n")).alias("cut"))
    return parts.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart."""
    sharded = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
