"""Queries over sources, data sets, the parameter store, ranges, protocols, caches and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import LATTICE, lattice, with_position
from ..operators import consistency as cc
from ..operators import params as kv
from ..sources import lines as src
from ..sources.folders import shared_folder
from .views import CLOCK_LOG, RATINGS, clock_log, ratings, samples_orders, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# sources -------------------------------------------------------------------

_DIGIT = "CAST(left(o_orderpriority, 1) AS INTEGER)"


@query(f"""SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS y, f.fea AS fea,
  CAST(CASE f.fea WHEN 0 THEN o_custkey ELSE {_DIGIT} END AS DOUBLE) AS val FROM orders, (VALUES (0), (4)) f(fea)""")
def src_libsvm_parse(spark, d):
    """SRC-1, 6, 10: LIBSVM text written from orders and parsed."""
    o = table(spark, d, "orders")
    line = F.concat_ws(" ", (F.col("o_orderstatus") == "F").cast("int"), F.concat(F.lit("1:"), "o_custkey"), F.concat(F.lit("5:"), F.substring("o_orderpriority", 1, 1)))
    return o.select(F.col("o_orderkey").alias("id"), src.parse_libsvm(line).alias("s")).select("id", "s.y", F.explode("s.x").alias("p")).select("id", "y", "p.fea", "p.val")


@query(f"""SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS x0, CAST({_DIGIT} AS DOUBLE) / 2 AS x1,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS y FROM orders""")
def src_tsv_parse(spark, d):
    """SRC-2, 7, 12: tab-separated text, decimals kept."""
    o = table(spark, d, "orders")
    line = F.concat_ws("\t", "o_custkey", (F.substring("o_orderpriority", 1, 1).cast("int") / 2).cast("string"), (F.col("o_orderstatus") == "F").cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), src.parse_tsv(line, 2).alias("s")).select("id", F.col("s.x")[0].alias("x0"), F.col("s.x")[1].alias("x1"), F.col("s.y").alias("y"))


@query(f"""WITH r AS ({RATINGS}) SELECT "user", item + (SELECT max("user") + 1 FROM r) AS item, CAST(floor(rating * 2) AS DOUBLE) / 2 AS rating FROM r""")
def src_ratings_parse(spark, d):
    """SRC-18: rating triples, items behind the users in one id space."""
    r = ratings(spark, d)
    users = r.agg(F.max("user") + 1).first()[0]
    line = F.concat_ws("\t", "user", "item", (F.floor(F.col("rating") * 2) / 2).cast("string"))
    return r.select(src.parse_rating(line, users).alias("s")).select("s.user", "s.item", "s.rating")


@query("""SELECT o_orderkey AS doc_id, CAST(word AS INTEGER) AS word, count(*) AS n FROM
  (SELECT o_orderkey, o_custkey % 7 AS word FROM orders, range(2) UNION ALL SELECT o_orderkey, 10 + o_custkey % 11 FROM orders, range(3)) GROUP BY 1, 2""")
def src_bow_parse(spark, d):
    """SRC-19: bag-of-words lines, every word repeated by its frequency."""
    line = F.expr("concat_ws(' ', o_orderkey, concat(o_custkey % 7 + 1, ':2'), concat(o_custkey % 11 + 11, ':3'))")
    words = table(spark, d, "orders").select(src.parse_bag_of_words(line).alias("s")).select("s.doc_id", F.explode("s.words").alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query(SQL["src_libsvm_parse"])
def src_libsvm_file(spark, d):
    """SRC-1, 3, 6, 10, 17: LIBSVM files written, found below a folder by a regex on their names, read and parsed."""
    o = table(spark, d, "orders")
    # the row's key is the third feature of the line
    line = F.concat_ws(" ", (F.col("o_orderstatus") == "F").cast("int"), F.concat(F.lit("1:"), "o_custkey"), F.concat(F.lit("3:"), "o_orderkey"), F.concat(F.lit("5:"), F.substring("o_orderpriority", 1, 1)))
    folder = shared_folder(spark, "libsvm")
    o.select(line.alias("value")).write.text(f"{folder}/deep/er")
    sample = src.read_lines(spark, folder, r"/part-[^/]*\.txt$").select(src.parse_libsvm(F.col("value")).alias("s")).select("s.y", "s.x")
    keyed = sample.withColumn("id", F.element_at(F.filter("x", lambda p: p["fea"] == 2), 1)["val"].cast("bigint"))
    return keyed.select("id", "y", F.explode(F.filter("x", lambda p: p["fea"] != 2)).alias("p")).select("id", "y", "p.fea", "p.val")


@query("SELECT CAST(o_custkey AS DOUBLE) AS x0, CAST(o_orderkey AS DOUBLE) AS x1, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS y FROM orders")
def src_tsv_file(spark, d):
    """SRC-2, 3, 7, 12: tab-separated files written, read and parsed."""
    folder = shared_folder(spark, "tsv")
    table(spark, d, "orders").select(F.concat_ws("\t", "o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").cast("int")).alias("value")).write.text(folder)
    return src.read_lines(spark, folder).select(src.parse_tsv(F.col("value"), 2).alias("s")).select(F.col("s.x")[0].alias("x0"), F.col("s.x")[1].alias("x1"), F.col("s.y").alias("y"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line, p_retailprice AS weight FROM part")
def snk_model_text(spark, d):
    """SNK-1, SRC-21: a model written as text, one weight a line in key order, and read by line."""
    folder = shared_folder(spark, "model")
    src.write_model(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("weight")), folder)
    return src.read_model(spark, folder)


@query("SELECT CAST(n_nationkey AS INTEGER) AS key, CAST(n_nationkey AS DOUBLE) / 4 AS weight FROM nation")
def src_model_text(spark, d):
    """SRC-21: a model in one line of text."""
    one = table(spark, d, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", (F.col("n_nationkey") / 4).alias("w")))), lambda s: s["w"].cast("string")), ",").alias("value"))
    return one.select(F.posexplode(src.parse_model(F.col("value"))).alias("key", "weight"))


@query(f"""SELECT pos // 20 AS batch, count(DISTINCT custkey % 50) AS n_keys, string_agg(DISTINCT CAST(custkey % 50 AS VARCHAR), ',' ORDER BY CAST(custkey % 50 AS VARCHAR)) AS keys
  FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM (SELECT o_orderkey AS id, o_custkey AS custkey FROM orders)) GROUP BY 1""")
def src_batch_keys(spark, d):
    """SRC-4, 5, 8, 9, DS-7, OB-7: batches of 20 rows and their sorted distinct keys."""
    rows = with_position(samples_orders(spark, d), "id", "at")
    keys = rows.groupBy(F.floor(F.col("at") / 20).alias("batch")).agg(F.array_sort(F.collect_set((F.col("custkey") % 50).cast("string"))).alias("keys"))
    return keys.select("batch", F.size("keys").cast("bigint").alias("n_keys"), F.array_join("keys", ",").alias("keys"))


@query("SELECT pos % 4 AS worker, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) GROUP BY 1")
def src_round_robin(spark, d):
    """SRC-20: line i goes to worker i mod n."""
    return with_position(samples_orders(spark, d), "id", "at").groupBy((F.col("at") % 4).alias("worker")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS y, CAST(0 AS INTEGER) AS fea, CAST(o_custkey AS DOUBLE) AS val FROM orders")
def src_binary_roundtrip(spark, d):
    """SRC-11, 15: binary records written and read."""
    rows = samples_orders(spark, d).select("id", "y", F.array(F.struct(F.lit(0).alias("fea"), F.col("custkey").cast("double").alias("val"))).alias("x"))
    return src.decode_binary(src.encode_binary(rows))


# data sets -----------------------------------------------------------------

_PARTED = "SELECT o_orderkey AS id, o_orderkey % 4 AS part, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS pos FROM orders"


def _parted(spark, d):
    return with_position(samples_orders(spark, d, 4).select("id", "part"), "id", "pos", ("part",))


@query(f"WITH p AS ({_PARTED}) SELECT id, part, pos, row_number() OVER (ORDER BY part, pos) - 1 AS turn FROM p")
def ds_iterate(spark, d):
    """DS-1, 2, 4: partition, then position order."""
    rows = _parted(spark, d)
    sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = F.lit(0).cast("bigint")
    for p in sizes:
        before = F.when(F.col("part") == p, F.lit(sum(n for q, n in sizes.items() if q < p)).cast("bigint")).otherwise(before)
    return rows.withColumn("turn", before + F.col("pos"))


@query("SELECT o_orderkey % 4 AS part, count(*) AS n, count(*) = 0 AS empty FROM orders GROUP BY 1")
def ds_size(spark, d):
    """DS-3: sizes of partitions."""
    return samples_orders(spark, d, 4).groupBy("part").agg(F.count("*").alias("n")).withColumn("empty", F.col("n") == 0)


@query("""WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
  SELECT draw, id FROM (SELECT range AS draw, (range + 7) % n AS pos FROM n, range((SELECT 2 * n FROM n))) JOIN p USING (pos)""")
def ds_loop_k(spark, d):
    """DS-5, 6: a cyclic scan of twice the table from a start offset."""
    rows = with_position(samples_orders(spark, d).select("id"), "id", "pos")
    n = rows.count()
    turns = spark.range(0, 2 * n).select(F.col("id").alias("draw"), ((F.col("id") + 7) % max(1, n)).alias("pos"))
    return turns.join(rows, "pos").select("draw", "id")


@query("""WITH p AS (SELECT o_orderkey AS id, o_custkey % 50 AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), n AS (SELECT count(*) AS n FROM p),
  t AS (SELECT range // 32 AS batch, (range + 11) % n AS pos FROM n, range((SELECT (n + 31) // 32 * 32 FROM n)))
  SELECT batch, CAST(sum(id) AS BIGINT) AS ids, count(DISTINCT k) AS n_keys FROM t JOIN p USING (pos) GROUP BY batch""")
def ds_cyclic_batch(spark, d):
    """DS-7: cyclic batches that wrap at the end."""
    rows = with_position(samples_orders(spark, d).select("id", "custkey"), "id", "pos")
    n = rows.count()
    turns = spark.range(0, -(-n // 32) * 32).select(F.floor(F.col("id") / 32).alias("batch"), ((F.col("id") + 11) % max(1, n)).alias("pos"))
    return turns.join(rows, "pos").groupBy("batch").agg(F.sum("id").alias("ids"), F.count_distinct(F.col("custkey") % 50).alias("n_keys"))


@query(f"WITH p AS ({_PARTED}) SELECT pos % 3 AS thread, part, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM p GROUP BY 1, 2")
def ds_load_balance(spark, d):
    """DS-8: thread t has the positions t mod n of each partition."""
    return _parted(spark, d).groupBy((F.col("pos") % 3).alias("thread"), "part").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH p AS (SELECT o_orderkey AS id, {LATTICE.format(key="o_orderkey", seed=7, size=9973)} AS turn FROM orders) SELECT id, turn, turn = (SELECT min(turn) FROM p) AS first FROM p""")
def ds_random_start(spark, d):
    """DS-6: a seeded random order, the same for any partitioning."""
    rows = samples_orders(spark, d).select("id", lattice(7, "id").alias("turn"))
    return rows.withColumn("first", F.col("turn") == rows.agg(F.min("turn")).first()[0])


# parameter store -----------------------------------------------------------

_STORE = "SELECT l_partkey AS key, sum(l_quantity) AS val FROM lineitem GROUP BY 1"
# a push query starts from the even lines and pushes the odd ones
_PARAMS = "SELECT l_partkey AS key, sum(l_quantity) AS val FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1"


def _deltas(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("val"), F.col("l_suppkey").alias("server"), F.col("l_linenumber").alias("line"))


def _store(spark, d):
    return _deltas(spark, d).groupBy("key").agg(F.sum("val").alias("val"))


def _params(spark, d):
    return _deltas(spark, d).where("line % 2 = 0").groupBy("key").agg(F.sum("val").alias("val"))


@query(f"WITH s AS ({_STORE}) SELECT p_partkey AS key, coalesce(val, 0) AS val FROM part LEFT JOIN s ON key = p_partkey")
def kv_pull(spark, d):
    """KV-3, 6, 10: a missing key reads as 0."""
    return kv.pull(_store(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("key")))


@query("SELECT l_partkey AS key, sum(l_quantity) AS val FROM lineitem GROUP BY 1")
def kv_push_add(spark, d):
    """KV-4: pushes are summed."""
    return kv.push_add(_params(spark, d), _deltas(spark, d).where("line % 2 = 1"))


@query(f"""WITH s AS ({_PARAMS}), n AS (SELECT l_partkey AS key, max(l_quantity * 100 + l_linenumber) AS seq FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1)
  SELECT coalesce(s.key, n.key) AS key, coalesce(floor(seq / 100), val) AS val FROM s FULL JOIN n ON s.key = n.key""")
def kv_push_assign(spark, d):
    """KV-5: the last push wins."""
    new = _deltas(spark, d).where("line % 2 = 1").select("key", "val", (F.col("val") * 100 + F.col("line")).alias("seq"))
    return kv.push_assign(_params(spark, d), new)


@query(f"WITH s AS ({_STORE}) SELECT key // 100 AS chunk_id, count(*) AS n, sum(val * (key % 100)) AS checksum FROM s GROUP BY 1")
def kv_pull_chunks(spark, d):
    """KV-8, 13: chunk rows in key order (the check sum is over key offsets)."""
    chunks = kv.to_chunks(_store(spark, d).withColumn("val", F.col("val") * (F.col("key") % 100)), 100)
    return chunks.select("chunk_id", F.size("vals").cast("bigint").alias("n"), F.aggregate("vals", F.lit(0.0), lambda a, v: a + v).alias("checksum"))


@query("""WITH s AS (SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS val FROM part), t AS (SELECT key // 100 AS chunk_id, row_number() OVER (PARTITION BY key // 100 ORDER BY key) - 1 AS place, val FROM s)
  SELECT chunk_id, place, CASE WHEN chunk_id % 2 = 0 THEN 2 * val ELSE val END AS val FROM t""")
def kv_push_chunks(spark, d):
    """KV-7: whole chunk rows are added."""
    chunks = kv.to_chunks(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("val")), 100)
    pushed = kv.push_chunks(chunks, chunks.where("chunk_id % 2 = 0"))
    return pushed.select("chunk_id", F.posexplode("vals").alias("place", "val")).select("chunk_id", F.col("place").cast("bigint").alias("place"), "val")


@query("""WITH s AS (SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS val FROM part), t AS (SELECT key // 100 AS chunk_id, row_number() OVER (PARTITION BY key // 100 ORDER BY key) - 1 AS place, val FROM s)
  SELECT chunk_id, place, CASE WHEN chunk_id % 2 = 0 THEN -val ELSE val END AS val FROM t""")
def kv_push_chunks_assign(spark, d):
    """KV-7: whole chunk rows are replaced."""
    chunks = kv.to_chunks(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("val")), 100)
    new = chunks.where("chunk_id % 2 = 0").select("chunk_id", F.transform("vals", lambda v: -v).alias("vals"))
    pushed = kv.push_chunks(chunks, new, assign=True)
    return pushed.select("chunk_id", F.posexplode("vals").alias("place", "val")).select("chunk_id", F.col("place").cast("bigint").alias("place"), "val")


@query(f"""WITH log AS ({CLOCK_LOG}), c AS (SELECT k % 3 AS server, count(*) AS clock FROM log WHERE push GROUP BY 1)
  SELECT chunk, min(clock) AS min_clock, CAST(sum(v.k) AS BIGINT) AS total FROM (SELECT DISTINCT chunk, k FROM log) v JOIN c ON c.server = v.k % 3 GROUP BY chunk""")
def kv_min_clock_pull(spark, d):
    """KV-9: chunks with the least clock of the servers that replied."""
    log = clock_log(spark, d)
    clocks = log.where("push").groupBy((F.col("k") % 3).alias("server")).agg(F.count("*").alias("clock"))
    asked = log.select("chunk", "k").distinct().withColumn("server", F.col("k") % 3)
    return asked.join(F.broadcast(clocks), "server").groupBy("chunk").agg(F.min("clock").alias("min_clock"), F.sum("k").alias("total"))


def _rank_sql(max_key: str, chunk: int, servers: int) -> str:
    return f"""WITH c AS (SELECT {max_key} AS m, ({max_key} - 1) // {chunk} + 1 AS n), s AS (SELECT range AS server, n // {servers} + CASE WHEN range < n % {servers} THEN 1 ELSE 0 END AS share, m FROM c, range({servers})),
  r AS (SELECT server, m, share, coalesce(sum(share) OVER (ORDER BY server ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM s)
  SELECT CAST(server AS INTEGER) AS server, CAST(least(first * {chunk}, m) AS BIGINT) AS "begin", CAST(least((first + share) * {chunk}, m) AS BIGINT) AS "end" FROM r"""


@query(_rank_sql("(SELECT max(p_partkey) + 1 FROM part)", 100, 7))
def rp_ranges(spark, d):
    """RP-1, 6, KV-1, 2: even chunk ranges over seven servers."""
    top = table(spark, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    return kv.range_table(spark, kv.chunk_ranges(top, 100, 7))


@query(f"""WITH u AS ({_rank_sql("(SELECT max(c_custkey) + 1 FROM customer)", 1, 2)}), i AS ({_rank_sql("(SELECT max(p_partkey) + 1 FROM part)", 1, 3)})
  SELECT * FROM u UNION ALL SELECT server + 2, "begin" + (SELECT max(c_custkey) + 1 FROM customer), "end" + (SELECT max(c_custkey) + 1 FROM customer) FROM i""")
def rp_custom(spark, d):
    """RP-2: users on the first half of five servers, items on the rest."""
    users = table(spark, d, "customer").agg(F.max("c_custkey") + 1).first()[0]
    items = table(spark, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    return kv.range_table(spark, kv.custom_ranges(users, items, 5))


_RANGES = _rank_sql("(SELECT max(p_partkey) + 1 FROM part)", 100, 7)


@query(f"""WITH g AS ({_RANGES}) SELECT server, count(*) AS n_keys, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part JOIN g ON p_partkey >= "begin" AND p_partkey < "end" GROUP BY 1""")
def rp_key_server(spark, d):
    """RP-3, 4, KV-12: the server of each key."""
    part = table(spark, d, "part")
    ranges = kv.chunk_ranges(part.agg(F.max("p_partkey") + 1).first()[0], 100, 7)
    return part.groupBy(kv.server_of(F.col("p_partkey"), ranges).alias("server")).agg(F.count("*").alias("n_keys"), F.sum("p_partkey").alias("keys"))


@query("SELECT p_partkey AS key, p_partkey // 100 AS chunk_id, p_partkey % 100 AS place FROM part")
def rp_key_chunk(spark, d):
    """RP-5: chunk and offset of a key."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.floor(F.col("p_partkey") / 100).alias("chunk_id"), (F.col("p_partkey") % 100).alias("place"))


@query(f"""WITH g AS ({_RANGES}) SELECT server, l_linenumber % 2 AS side, count(DISTINCT l_partkey) AS n_keys, count(*) AS n FROM lineitem JOIN g ON l_partkey >= "begin" AND l_partkey < "end" GROUP BY 1, 2""")
def kv_slice(spark, d):
    """KV-12: pushes of two senders cut by server range."""
    rows = _deltas(spark, d)
    ranges = kv.chunk_ranges(table(spark, d, "part").agg(F.max("p_partkey") + 1).first()[0], 100, 7)
    return rows.groupBy(kv.server_of(F.col("key"), ranges).alias("server"), (F.col("line") % 2).alias("side")).agg(F.count_distinct("key").alias("n_keys"), F.count("*").alias("n"))


# consistency and caches ------------------------------------------------------

_CLOCKS = f"""log AS ({CLOCK_LOG}), c AS (SELECT *, {', '.join(f"coalesce(sum(CASE WHEN push AND worker = {w} THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c{w}" for w in range(4))} FROM log),
  clocked AS (SELECT *, CASE worker WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS clock, least(c0, c1, c2, c3) AS min_clock FROM c)"""


@query(f"WITH {_CLOCKS} SELECT seq, worker, push, CAST(clock AS BIGINT) AS clock, CAST(min_clock AS BIGINT) AS min_clock, clock - 50 <= min_clock AS admitted FROM clocked")
def cc_ssp_admit(spark, d):
    """CC-3, 4, 9: may a request of a worker go on under staleness 50?"""
    return cc.ssp_log(clock_log(spark, d), 4, 50)


@query(f"""WITH {_CLOCKS}, r AS (SELECT clock AS round, count(DISTINCT worker) AS n_workers, sum(k) AS total FROM clocked WHERE push GROUP BY 1)
  SELECT CAST(round AS BIGINT) AS round, n_workers, CAST(total AS BIGINT) AS total, CAST(sum(total) OVER (ORDER BY round) AS BIGINT) AS visible FROM r""")
def cc_bsp_rounds(spark, d):
    """CC-1, 2, 6, 8: pushes by round and what the next pull sees."""
    return cc.bsp_rounds(clock_log(spark, d), 4)


@query(f"WITH log AS ({CLOCK_LOG}) SELECT k AS key, CAST(sum(worker + 1) AS BIGINT) AS total, max_by(worker, seq) AS last_worker FROM log WHERE push GROUP BY 1")
def cc_asp_total(spark, d):
    """CC-5, 7, 10: immediate updates, added and assigned."""
    return clock_log(spark, d).where("push").groupBy(F.col("k").alias("key")).agg(F.sum(F.col("worker") + 1).alias("total"), F.max_by("worker", "seq").alias("last_worker"))


@query(f"WITH log AS ({CLOCK_LOG}), c AS (SELECT worker, count(*) AS clock FROM log WHERE push GROUP BY 1) SELECT worker, clock, (SELECT min(clock) FROM c) AS min_clock FROM c")
def cc_min_clock(spark, d):
    """CC-3: final clocks; one row per worker."""
    clocks = clock_log(spark, d).where("push").groupBy("worker").agg(F.count("*").alias("clock"))
    return clocks.crossJoin(F.broadcast(clocks.agg(F.min("clock").alias("min_clock"))))


@query(f"WITH log AS ({CLOCK_LOG}) SELECT k AS key, count(DISTINCT worker) AS n_messages, CAST(sum(k + worker) AS BIGINT) AS total FROM log GROUP BY 1")
def wk_local_combine(spark, d):
    """WK-7: a worker's pushes of a key are one message."""
    local = clock_log(spark, d).groupBy("worker", "k").agg(F.sum(F.col("k") + F.col("worker")).alias("part"))
    return local.groupBy(F.col("k").alias("key")).agg(F.count("*").alias("n_messages"), F.sum("part").alias("total"))


@query(f"""WITH RECURSIVE log AS ({CLOCK_LOG}), a AS (SELECT worker, chunk, row_number() OVER (PARTITION BY worker ORDER BY seq) - 1 AS clock FROM log),
  o AS (SELECT *, row_number() OVER (PARTITION BY worker, chunk ORDER BY clock) AS i FROM a),
  r AS (SELECT worker, chunk, i, clock AS last, 1 AS fetched FROM o WHERE i = 1
    UNION ALL SELECT o.worker, o.chunk, o.i, CASE WHEN o.clock - last > 25 THEN o.clock ELSE last END, fetched + CASE WHEN o.clock - last > 25 THEN 1 ELSE 0 END
    FROM r JOIN o ON o.worker = r.worker AND o.chunk = r.chunk AND o.i = r.i + 1)
  SELECT worker, chunk, max(i) AS n_reads, CAST(max(fetched) AS BIGINT) AS n_refreshes FROM r GROUP BY 1, 2""")
def wk_stale_refresh(spark, d):
    """WK-9: a thread's cache of chunks, each refetched when it is older than 25 of the thread's requests."""
    log = with_position(clock_log(spark, d), "seq", "clock", ("worker",))
    return cc.stale_refreshes(log, 25)


def _refresh_sql(name: str, source: str, one: str, two: str, staleness: int) -> str:
    """CTEs of a request log's cache: ``name`` has each request of ``source`` (one, two, clock, seq) and whether it fetched."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {one}, {two} ORDER BY clock, seq) AS i FROM {source}),
  {name} AS (SELECT {one}, {two}, seq, i, clock AS last, true AS fetched FROM {name}_o WHERE i = 1
    UNION ALL SELECT o.{one}, o.{two}, o.seq, o.i, CASE WHEN o.clock - last > {staleness} THEN o.clock ELSE last END, o.clock - last > {staleness}
    FROM {name} r JOIN {name}_o o ON o.{one} = r.{one} AND o.{two} = r.{two} AND o.i = r.i + 1)"""


_WORKER_LOG = "a AS (SELECT *, worker % 2 AS process, row_number() OVER (PARTITION BY worker ORDER BY seq) - 1 AS clock FROM log)"
_PROCESS_LOG = "p AS (SELECT seq, worker % 2 AS process, chunk, row_number() OVER (PARTITION BY worker % 2 ORDER BY seq) - 1 AS clock FROM log)"


def _worker_clocks(spark, d):
    return with_position(clock_log(spark, d), "seq", "clock", ("worker",))


def _process_clocks(spark, d):
    return with_position(clock_log(spark, d).withColumn("process", F.col("worker") % 2), "seq", "clock", ("process",))


@query(f"""WITH RECURSIVE log AS ({CLOCK_LOG}), {_WORKER_LOG}, {_refresh_sql("r", "a", "worker", "k", 25)}
  SELECT worker, k AS key, count(*) AS n_reads, count(*) FILTER (WHERE fetched) AS n_fetches FROM r GROUP BY 1, 2""")
def wk_cache_keys(spark, d):
    """WK-8: a thread's cache of keys, each refetched when it is older than 25 of the thread's requests."""
    events = cc.refreshes(_worker_clocks(spark, d), ("worker", "k"), 25)
    return events.groupBy("worker", F.col("k").alias("key")).agg(F.count("*").alias("n_reads"), F.sum(F.col("fetched").cast("bigint")).alias("n_fetches"))


@query(f"""WITH RECURSIVE log AS ({CLOCK_LOG}), {_PROCESS_LOG}, {_refresh_sql("r", "p", "process", "chunk", 25)}
  SELECT process, chunk, count(*) AS n_reads, count(*) FILTER (WHERE fetched) AS n_fetches FROM r GROUP BY 1, 2""")
def wk_cache_process(spark, d):
    """WK-10: a process's cache of chunks, shared by its two threads."""
    events = cc.refreshes(_process_clocks(spark, d), ("process", "chunk"), 25)
    return events.groupBy("process", "chunk").agg(F.count("*").alias("n_reads"), F.sum(F.col("fetched").cast("bigint")).alias("n_fetches"))


def _two_level_sql(entry: str) -> str:
    return f"""WITH RECURSIVE log AS ({CLOCK_LOG}), {_WORKER_LOG}, {_PROCESS_LOG}, {_refresh_sql("t", "a", "worker", entry, 10)},
  missed AS (SELECT p.* FROM p JOIN t USING (seq) WHERE t.fetched), {_refresh_sql("q", "missed", "process", "chunk", 40)}
  SELECT process, chunk, count(*) AS n_thread_misses, count(*) FILTER (WHERE fetched) AS n_fetches FROM q GROUP BY 1, 2"""


def _two_level(spark, d, entry):
    """What a thread's cache misses asks the process's cache of chunks, which refetches by its own age."""
    missed = cc.refreshes(_worker_clocks(spark, d), ("worker", entry), 10).where("fetched").select("seq")
    events = cc.refreshes(_process_clocks(spark, d).join(missed, "seq", "left_semi"), ("process", "chunk"), 40)
    return events.groupBy("process", "chunk").agg(F.count("*").alias("n_thread_misses"), F.sum(F.col("fetched").cast("bigint")).alias("n_fetches"))


@query(_two_level_sql("k"))
def wk_cache_map_chunk(spark, d):
    """WK-11: a thread's cache of keys over its process's cache of chunks."""
    return _two_level(spark, d, "k")


@query(_two_level_sql("chunk"))
def wk_cache_chunk_chunk(spark, d):
    """WK-12: a thread's cache of chunks over its process's cache of chunks."""
    return _two_level(spark, d, "chunk")


@query(f"""WITH log AS ({CLOCK_LOG}), p AS (SELECT k AS key, max(worker) + k AS val FROM log GROUP BY k), n AS (SELECT k, count(*) AS n FROM log GROUP BY k), t AS (SELECT count(*) AS t FROM log)
  SELECT n.k AS key, n.n * 90 > t.t AS hot, n.n AS n_reads, CAST(n.n * p.val AS DOUBLE) AS total FROM n JOIN p ON p.key = n.k, t""")
def md_hot_cold_pull(spark, d):
    """MD-5: hot keys come from a broadcast pool, cold ones from a shuffle."""
    log = clock_log(spark, d)
    params = log.groupBy(F.col("k").alias("key")).agg((F.max("worker") + F.first("k")).cast("double").alias("val"))
    pulled = kv.hot_cold_pull(params, log.select(F.col("k").alias("key"), "seq"), 90)
    return pulled.groupBy("key", "hot").agg(F.count("*").alias("n_reads"), F.sum("val").alias("total"))


_LAST = ", ".join(f"max(CASE WHEN chunk = {c} THEN seq END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l{c}" for c in range(10))
_OWN = "CASE chunk " + " ".join(f"WHEN {c} THEN l{c}" for c in range(10)) + " END"
_OTHERS = " + ".join(f"CASE WHEN l{c} > own THEN 1 ELSE 0 END" for c in range(10))


@query(f"""WITH log AS ({CLOCK_LOG}), l AS (SELECT chunk, {_LAST} FROM log), o AS (SELECT *, {_OWN} AS own FROM l), h AS (SELECT chunk, own IS NOT NULL AND {_OTHERS} < 4 AS hit FROM o)
  SELECT chunk, count(*) FILTER (WHERE hit) AS n_hits, count(*) FILTER (WHERE NOT hit) AS n_misses FROM h GROUP BY 1""")
def md_lru_recency(spark, d):
    """MD-7, 8: hits and misses of a least-recently-used cache of four chunks."""
    return cc.lru_hits(clock_log(spark, d), 4)


@query(f"""WITH log AS ({CLOCK_LOG}), n AS (SELECT chunk, count(*) AS n_reads, max(seq) AS last_seq FROM log GROUP BY 1)
  SELECT *, row_number() OVER (ORDER BY n_reads, last_seq) <= 3 AS victim FROM n""")
def md_lfu_victims(spark, d):
    """MD-8: the three least used chunks would go."""
    counts = clock_log(spark, d).groupBy("chunk").agg(F.count("*").alias("n_reads"), F.max("seq").alias("last_seq"))
    victims = counts.orderBy("n_reads", "last_seq").limit(3).select("chunk", F.lit(True).alias("v"))
    return counts.join(F.broadcast(victims), "chunk", "left").select("chunk", "n_reads", "last_seq", F.coalesce("v", F.lit(False)).alias("victim"))


@query("SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS val FROM part")
def md_dump_load(spark, d):
    """SNK-3, 4, MD-1, 2, 10: a model dumped to storage in chunks and loaded by the next stage."""
    params = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("val"))
    folder = shared_folder(spark, "dump")
    kv.dump(params, folder, 100)
    return kv.load(spark, folder)


@query("SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS val FROM part WHERE (p_partkey // 100) IN (SELECT DISTINCT s_suppkey % 7 FROM supplier)")
def md_load_chunks(spark, d):
    """MD-2, SNK-4: only the chunks asked for are read from a dumped model."""
    folder = shared_folder(spark, "dump")
    kv.dump(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("val")), folder, 100)
    asked = [r.c for r in table(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("c")).distinct().collect()]
    return kv.load(spark, folder, asked)


_TURN = LATTICE.format(key="chunk", seed=5, size=9973)


@query(f"""WITH log AS ({CLOCK_LOG}), c AS (SELECT DISTINCT chunk FROM log) SELECT chunk, row_number() OVER (ORDER BY {_TURN}, chunk) <= 3 AS victim FROM c""")
def md_random_victims(spark, d):
    """MD-8: three chunks of a seeded draw would go."""
    chunks = clock_log(spark, d).select("chunk").distinct()
    drawn = [r.chunk for r in chunks.orderBy(lattice(5, "chunk"), "chunk").limit(3).collect()]
    return chunks.withColumn("victim", F.col("chunk").isin(drawn))


_BSP = """p AS (SELECT *, {epoch} AS epoch FROM log WHERE push), r AS (SELECT *, row_number() OVER (PARTITION BY worker, epoch ORDER BY seq) - 1 AS round FROM p)
  SELECT epoch, round, k AS key, max_by(value, (worker, seq)) AS value FROM r GROUP BY 1, 2, 3"""


@query(f"WITH log AS ({CLOCK_LOG}), " + _BSP.format(epoch="CAST(0 AS BIGINT)"))
def cc_bsp_assign(spark, d):
    """CC-2: assigned keys at the end of each round."""
    return cc.bsp_assigned(clock_log(spark, d), 4)


@query(f"WITH log AS ({CLOCK_LOG}), " + _BSP.format(epoch="seq // ((SELECT max(seq) FROM log) // 3 + 1)"))
def cc_epoch_reset(spark, d):
    """CC-6: clocks start anew in each of three epochs."""
    return cc.bsp_assigned(clock_log(spark, d), 4, epochs=3)


@query(f"""WITH log AS ({CLOCK_LOG}), c AS (SELECT *, coalesce(sum(CASE WHEN push THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM log)
  SELECT seq, k, CAST(n AS BIGINT) AS n_seen FROM c WHERE NOT push""")
def cc_bypass_reads(spark, d):
    """CC-7: pulls without consistency control see every push before them; keys are those pushed or pulled."""
    return cc.bypass_reads(clock_log(spark, d).withColumn("k", F.col("k")))


# messages, scheduling -----------------------------------------------------------


@query("""SELECT CAST(least(l_partkey // 700, 2) AS INTEGER) AS server, l_suppkey % 5 AS worker, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def mx_owner_route(spark, d):
    """MX-1, 2: two-level routing of keyed messages."""
    return _deltas(spark, d).groupBy(F.least(F.floor(F.col("key") / 700), F.lit(2)).cast("int").alias("server"), (F.col("server") % 5).alias("worker")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS id, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def mx_push_sum(spark, d):
    """MX-3, 4: messages to one object are summed where it lives."""
    return _deltas(spark, d).groupBy(F.col("server").alias("id")).agg(F.sum("val").alias("total"), F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 4 + 1) % 4 ELSE o_orderkey % 4 END AS part FROM orders")
def mx_migrate(spark, d):
    """MX-5: some objects move to another worker and are gone at the source."""
    return samples_orders(spark, d, 4).select("id", F.when(F.col("id") % 3 == 0, (F.col("part") + 1) % 4).otherwise(F.col("part")).alias("part"))


@query("SELECT count(*) AS n, sum(l_quantity) AS total, max(l_quantity) AS most FROM lineitem")
def mx_allreduce(spark, d):
    """MX-6: scalars of all workers in one place."""
    return _deltas(spark, d).agg(F.count("*").alias("n"), F.sum("val").alias("total"), F.max("val").alias("most"))
