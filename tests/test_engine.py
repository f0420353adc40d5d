"""Fixture cases of the store, ranges, protocols, sources and training."""

import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise.config import StageConfig, TrainConfig, parse_stages, store_update
from stagewise.functions import ranks
from stagewise.functions.ranks import with_position
from stagewise.functions.special import lgamma
from stagewise.operators import clustering as km
from stagewise.operators import consistency as cc
from stagewise.operators import factorization as mf
from stagewise.operators import params as kv
from stagewise.operators import schedule as sc
from stagewise.operators import topics as ld
from stagewise.plans import catalogue
from stagewise.plans import training as tr
from stagewise.sources import lines as src

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_ranges():
    assert kv.chunk_ranges(9, 2, 3) == [(0, 0, 4, 0, 2), (1, 4, 8, 2, 4), (2, 8, 9, 4, 5)]
    assert [r[1:3] for r in kv.chunk_ranges(3, 10, 3)] == [(0, 3), (3, 3), (3, 3)]


def test_lookup(spark):
    ranges = kv.chunk_ranges(9, 2, 3)
    got = [r[0] for r in spark.range(9).orderBy("id").select(kv.server_of(F.col("id"), ranges)).collect()]
    assert got == [0, 0, 0, 0, 1, 1, 1, 1, 2]


def test_push_and_pull(spark):
    params = spark.createDataFrame([(k, 1.0) for k in range(18)], "key bigint, val double")
    pushed = spark.createDataFrame([(k, v, 0) for k, v in zip([0, 1, 2, 8, 15, 17], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])], "key bigint, val double, seq int")
    added = {r.key: r.val for r in kv.push_add(params, pushed).collect()}
    assert added[8] == 1.4 and added[3] == 1.0
    assigned = {r.key: r.val for r in kv.push_assign(params, pushed).collect()}
    assert assigned[17] == 0.6 and assigned[3] == 1.0
    asked = {r.key: r.val for r in kv.pull(params, spark.createDataFrame([(3,), (99,)], "key bigint")).collect()}
    assert asked == {3: 1.0, 99: 0.0}
    chunks = kv.to_chunks(params, 4)
    assert {r.chunk_id: len(r.vals) for r in chunks.collect()} == {0: 4, 1: 4, 2: 4, 3: 4, 4: 2}
    twice = {r.chunk_id: r.vals for r in kv.push_chunks(chunks, chunks.where("chunk_id in (1, 2, 4)")).collect()}
    assert twice[4] == [2.0, 2.0] and twice[0] == [1.0] * 4


def test_bsp_sees_all_rounds_before(spark):
    log = spark.createDataFrame([(2 * i + w, w, 1, True) for i in range(100) for w in range(2)], "seq bigint, worker bigint, k bigint, push boolean")
    rounds = {r.round: r.visible for r in cc.bsp_rounds(log, 2).collect()}
    assert all(rounds[i] == 2 * (i + 1) for i in range(100))


def test_ssp_admits_within_staleness(spark):
    log = spark.createDataFrame([(i, 0, 1, True) for i in range(5)] + [(5, 1, 1, True), (6, 0, 1, True)], "seq bigint, worker bigint, k bigint, push boolean")
    got = {r.seq: (r.clock, r.min_clock, r.admitted) for r in cc.ssp_log(log, 2, 1).collect()}
    assert got[1] == (1, 0, True) and got[2] == (2, 0, False) and got[6] == (5, 1, False)


def test_lru(spark):
    log = spark.createDataFrame(list(enumerate([0, 1, 2, 0, 1, 3, 2])), "seq bigint, chunk bigint")
    got = {r.chunk: (r.n_hits, r.n_misses) for r in cc.lru_hits(log, 3).collect()}
    assert got == {0: (1, 1), 1: (1, 1), 2: (0, 2), 3: (0, 1)}


def test_lru_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(cc, "BUCKET_ROWS", 7)
    rng, held, expected = np.random.default_rng(5), [], {}
    asked = (rng.random(300) ** 2 * 40).astype(int).tolist()
    for c in asked:
        hit = c in held[-5:]
        held = [x for x in held if x != c] + [c]
        n = expected.get(c, (0, 0))
        expected[c] = (n[0] + hit, n[1] + (not hit))
    log = spark.createDataFrame(list(enumerate(asked)), "seq bigint, chunk bigint").repartition(3)
    assert {r.chunk: (r.n_hits, r.n_misses) for r in cc.lru_hits(log, 5).collect()} == expected


def test_positions_do_not_depend_on_partitions(spark):
    for n in (1, 4, 16):
        rows = with_position(spark.range(1000).repartition(n), "id", "pos")
        assert rows.where("id <> pos").isEmpty()
    assert with_position(spark.range(0), "id").isEmpty()


def test_libsvm(spark):
    rows = spark.createDataFrame([("1 3:0.5 1:2",), ("-1",), ("",), ("0 x:1 2:y 4:4 4:5",)], "value string")
    got = [r.s for r in rows.select(src.parse_libsvm(F.col("value")).alias("s")).collect()]
    assert [tuple(p) for p in got[0].x] == [(0, 2.0), (2, 0.5)] and got[0].y == 1.0
    assert got[1].x == [] and got[2] is None and [tuple(p) for p in got[3].x] == [(3, 5.0)]


def test_lgamma(spark):
    for x in (0.01, 0.5, 1.0, 3.7, 100.0, 1e6):
        assert spark.range(1).select(lgamma(F.lit(x))).first()[0] == pytest.approx(math.lgamma(x), rel=1e-9, abs=1e-9)


def test_settings():
    assert store_update("PS", "BSP", "assign") == "bsp-assign" and store_update("PS", "SSP") == "ssp-add" and store_update() == "assign"
    with pytest.raises(ValueError):
        TrainConfig(decay=0.5)
    with pytest.raises(ValueError):
        tr.inverse_decay(0.1, 0)
    with pytest.raises(ValueError):
        parse_stages("1,2", "1", "1", "1")
    assert [StageConfig(10, 1, 1.0, 4).share(w)[0] for w in range(4)] == [3, 3, 2, 2]


def test_scheduling():
    assert sc.increase_best([3.0, 2.0, 2.5, 1.0]) == 2 and sc.best_of_first([3.0, 2.0, 2.5, 1.0, 4.0, 0.1]) == 4
    assert sum(n for _, n in sc.plan_epochs(37, [3.0, 2.0, 2.5], sc.increase_best)) == 37
    assert sc.priority_order({"a": 1, "b": 6, "c": 3}) == [("b", 6, True), ("c", 3, False), ("a", 1, False)]
    with pytest.raises(ValueError):
        sc.placement("threads_per_worker", 9, 4, 5)


def test_any_rank_agrees_with_closed_form(spark):
    r = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(6) for i in range(5)], "user bigint, item bigint, rating double")
    items = mf.start_factors(r.select("item").distinct(), "item", 2)
    a = sorted(mf.als_half_step(r, "user", "item", items, 0.01).collect())
    b = sorted(mf.als_half_step_any(r, "user", "item", items, 0.01, 2).collect())
    assert all(x == pytest.approx(y) for x, y in zip(a, b))


@pytest.mark.parametrize("name", ["src_libsvm_parse", "ds_cyclic_batch", "kv_push_assign", "rp_ranges", "cc_ssp_admit", "wk_stale_refresh", "tr_gd_lr", "tr_sgd_single", "km_assign", "mf_rmse", "ld_posterior", "src_libsvm_file", "snk_model_text", "md_load_chunks", "kv_push_chunks_assign", "cc_epoch_reset", "cc_bypass_reads", "tr_grid_batch", "km_random_init"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    rel = con.execute(catalogue.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    assert mine == sorted(repr(tuple(row[i] for i in at)) for row in rel.fetchall())


def test_positions_of_skewed_keys_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 50)
    rows = [(i % 7 if i < 900 else 10**12 + i, 999 - i) for i in range(1000)]
    got = ranks.with_position(spark.createDataFrame(rows, "k bigint, t bigint").repartition(5), "k", "pos", tie=("t",)).collect()
    assert [(r.k, r.t) for r in sorted(got, key=lambda r: r.pos)] == sorted(rows)
    assert sorted(r.pos for r in got) == list(range(1000))


def test_libsvm_last_of_repeated_indices(spark):
    line = "1 3:1 2:5 3:2 x:1 3:7 2:6"
    row = spark.createDataFrame([(line,)], "l string").select(src.parse_libsvm(F.col("l")).alias("s")).first().s
    assert [(p.fea, p.val) for p in row.x] == [(1, 6.0), (2, 7.0)]


def test_model_text_keeps_key_order(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    src.write_model(spark.range(500).select((999 - F.col("id")).alias("key"), (F.col("id") / 4).alias("weight")).repartition(7), path)
    got = {r.line: r.weight for r in src.read_model(spark, path).collect()}
    assert got == {i: (499 - i) / 4 for i in range(500)}


def test_mini_batch_means_agree_with_a_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 3))
    start = x[:4]
    expected = start.copy()
    for part in range(5):
        c, v = start.copy(), np.ones(4)
        for i in range(part, 200, 5):
            k = int(((c - x[i]) ** 2).sum(axis=1).argmin())
            v[k] += 1
            c[k] -= (c[k] - x[i]) / v[k]
        expected += c - start
    frame = spark.createDataFrame([(i % 5, i, row.tolist()) for i, row in enumerate(x)], "part bigint, vec_id bigint, x array<double>")
    assert np.allclose(km.mini_batch(frame, start.tolist()), expected)


def test_stratified_sgd_agrees_with_a_loop(spark):
    edges = [(u, i, float((3 * u + i) % 5 + 1)) for u in range(12) for i in range(9) if (u + i) % 3]
    r = spark.createDataFrame(edges, "user bigint, item bigint, rating double")
    u, v = ({k: np.array([((k * 37 + j * 17) % 100) / 100 for j in range(2)]) for k in range(n)} for n in (12, 9))
    for s in range(4):
        for w in range(4):
            for a, b, x in sorted(e for e in edges if e[0] % 4 == w and e[1] % 4 == (w + s) % 4):
                e = x - u[a] @ v[b]
                u[a], v[b] = u[a] + 0.05 * e * v[b], v[b] + 0.05 * e * u[a]
    users, items = mf.sgd_epoch(r, mf.start_factors(r.select("user").distinct(), "user", 2), mf.start_factors(r.select("item").distinct(), "item", 2), 4, 0.05)
    assert all(np.allclose([row.f0, row.f1], u[row.user]) for row in users.collect())
    assert all(np.allclose([row.f0, row.f1], v[row.item]) for row in items.collect())


def test_sparse_draws_follow_the_posterior():
    dk, wk, nk = np.array([0.0, 3, 1, 0]), np.array([2.0, 0, 4, 0]), np.array([9.0, 7, 8, 5])
    p = (dk + 0.1) * (wk + 0.2) / (nk + 3)
    draws = [ld.sparse_draw(dk, wk, nk, 0.1, 0.2, 3, (i + 0.5) / 20_000) for i in range(20_000)]
    assert np.allclose(np.bincount(draws, minlength=4) / 20_000, p / p.sum(), atol=1e-3)


def test_sweeps_keep_tokens_and_gain_likelihood(spark, tmp_path):
    rows = [(d, i, (d % 2) * 5 + (i * i + d) % 5, (d + i) % 2) for d in range(40) for i in range(30)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, pos bigint, word_id bigint, topic bigint")
    stats = f"file://{tmp_path}/stats"
    after = ld.train(tokens, 2, 0.1, 0.1, 4, stats)
    assert sorted((r.doc_id, r.pos, r.word_id) for r in after.collect()) == sorted(r[:3] for r in rows)
    llh = [r.llh for r in spark.read.parquet(stats).orderBy("iteration").collect()]
    assert len(llh) == 4 and llh[-1] > ld.likelihood(tokens, 2, 0.1, 0.1)


def test_stream_of_one_file_is_one_step(spark):
    rows = catalogue.queries()["tr_stream_sgd"](spark, SF).collect()
    o = duckdb.sql(f"select o_totalprice / 500000 a, cast(left(o_orderpriority, 1) as double) / 5 b, cast(o_orderstatus = 'F' as double) y from '{SF}/orders.parquet'").fetchnumpy()
    x = np.stack([o["a"], o["b"], np.ones(len(o["y"]))], axis=1)
    expected = -0.5 * ((0.5 - o["y"]) @ x) / len(x)
    assert np.allclose([r.weight for r in sorted(rows, key=lambda r: r.key)], expected, atol=1e-6) and {r.n for r in rows} == {len(x)}


def test_binary_files(spark, tmp_path):
    def packed(samples):
        return b"".join(struct.pack("<fI", y, len(x)) + b"".join(struct.pack("<if", i + 1, v) for i, v in x) for y, x in samples)

    (tmp_path / "deep").mkdir()
    (tmp_path / "a.bin").write_bytes(packed([(1.0, [(0, 0.5), (7, 2.0)]), (0.0, [])]))
    (tmp_path / "deep" / "b.bin").write_bytes(packed([(-1.0, [(3, 4.0)])]))
    (tmp_path / "c.txt").write_bytes(b"no samples")
    got = src.read_binary(spark, f"file://{tmp_path}", r"\.bin$").collect()
    assert sorted(map(tuple, got)) == [(0, 1.0, 0, 0.5), (0, 1.0, 7, 2.0), (1, -1.0, 3, 4.0)]


def test_two_levels_of_caches(spark):
    log = spark.createDataFrame([(i, i % 2, 0, i // 2) for i in range(12)], "seq bigint, worker bigint, chunk bigint, clock bigint")
    got = sorted(cc.refreshes(log, ("worker", "chunk"), 1).collect())
    assert [r.fetched for r in got if r.worker == 0] == [True, False, True, False, True, False]
