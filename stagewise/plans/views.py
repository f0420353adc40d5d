"""Views over the driver's tables: samples, ratings, points, tokens and the clock log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import with_position
from ..operators import blocks as bl
from ..sources.folders import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples_lineitem(spark: SparkSession, sf_dir: str, batches: int = 5) -> DataFrame:
    """x0 .. x2, y in {0, 1} and batches that together are the whole table."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 50).alias("x0"), (F.col("l_discount") * 10).alias("x1"), (F.col("l_tax") * 10).alias("x2"),
        (F.col("l_returnflag") == "R").cast("double").alias("y"), ((F.col("l_orderkey") + F.col("l_linenumber")) % batches).alias("batch"),
    )


SAMPLES_LINEITEM = """SELECT l_quantity / 50 AS x0, l_discount * 10 AS x1, l_tax * 10 AS x2,
  CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS y, (l_orderkey + l_linenumber) % 5 AS batch FROM lineitem"""


def samples_orders(spark: SparkSession, sf_dir: str, parts: int = 64) -> DataFrame:
    """id, x0, x1, y, and the worker ``part`` with the order ``pos`` in it."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("x0"), (F.substring("o_orderpriority", 1, 1).cast("double") / 5).alias("x1"),
        (F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_orderkey") % parts).alias("part"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("custkey"),
    )


SAMPLES_ORDERS = """SELECT o_orderkey AS id, o_totalprice / 500000 AS x0, CAST(left(o_orderpriority, 1) AS DOUBLE) / 5 AS x1,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS y, o_orderkey % 64 AS part, o_orderkey AS pos, o_custkey AS custkey FROM orders"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating of 1 to 5 for each user and item of the events."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("bigint").alias("item"), (1 + F.col("value") % 4).alias("rating"))
    return rows.groupBy("user", "item").agg(F.avg("rating").alias("rating"))


RATINGS = """SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, avg(1 + value % 4) AS rating FROM events GROUP BY 1, 2"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


POINTS = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"

TOPICS = 4


def _with_ids(words: DataFrame) -> DataFrame:
    """Distinct words with ``word_id``, from 0 in the words' order."""
    # six bytes of a word are a number in the order of words; ties go by the whole word
    head = F.conv(F.rpad(F.hex(F.substring(F.encode("word", "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("bigint")
    # the vocabulary is written once, as its positions take several looks at it
    return with_position(kept(words.withColumn("head", head), "vocabulary"), "head", "word_id", tie=("word",)).drop("head")


def token_blocks(spark: SparkSession, sf_dir: str, topics: int = TOPICS) -> DataFrame:
    """Every word of every document in blocks (``operators.blocks``), ids in the words' order; the first topic is arithmetic.

    Words are told by their place in a block, so that each of a block's words
    meets its id once; a document lies whole in one block.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    if not documents.groupBy("doc_id").count().where("count > 1").isEmpty():
        documents = documents.repartition("doc_id").sortWithinPartitions("doc_id", "text")
    coded = kept(bl.coded(documents), "coded")
    ids = _with_ids(coded.select(F.explode("words").alias("word")).distinct())
    entries = coded.select("block", F.posexplode("words").alias("i", "word")).join(ids, "word").withColumnRenamed("word_id", "ids")
    return kept(bl.start_topics(coded.drop("words").join(bl.gathered(entries, "i", "ids"), "block"), topics), "blocks")


def word_batches(spark: SparkSession, sf_dir: str, batches: int = 10) -> DataFrame:
    """(class, word_id) of the words of each batch doc_id % batches; class is the batch + batches - 1, and 2 batches - 1 where it is null.

    A word's batches are bits of a number, so that its tokens are one row before they are shuffled.
    """
    if not 0 < batches <= 31:
        raise ValueError("1 to 31 batches")
    number = F.coalesce(F.col("doc_id") % batches + (batches - 1), F.lit(2 * batches - 1)).cast("bigint")
    words = bl.words_of_sets(table(spark, sf_dir, "documents").select(number.alias("number"), "text"))
    held = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(1 << c) != 0, F.lit(c)) for c in range(2 * batches))))
    return kept(_with_ids(words).select(F.explode(held).alias("class"), "word_id"), "word-batches")


TOKENS = f"""t0 AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS words FROM documents)),
ids AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM t0)),
tokens AS (SELECT doc_id, pos, word_id, (doc_id * 31 + pos * 17 + word_id) % {TOPICS} AS topic FROM t0 JOIN ids USING (word))"""


def clock_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, worker, k, chunk, push, value): events in time order as requests of four workers."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("user_id") % 4).alias("worker"), k.alias("k"), F.floor(k / 10).alias("chunk"), (k % 2 == 0).alias("push"), "value", "event_id")
    return with_position(rows, "t", "seq", tie=("event_id",)).drop("t", "event_id")


CLOCK_LOG = """SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, user_id % 4 AS worker, k, k // 10 AS chunk, k % 2 = 0 AS push, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
