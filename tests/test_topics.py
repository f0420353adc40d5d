"""Topic queries and sweeps on tokens in blocks."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from stagewise.functions.ranks import seeded, seeded_values
from stagewise.operators import blocks as bl
from stagewise.operators import topics as ld
from stagewise.plans import catalogue

ODD = [(7, "b a b"), (3, "Été ÜBER ΟΔΟΣ İX 1a2b_c"), (7, "c a zz"), (None, "a q"), (None, "q b"), (-6, "a b c a"), (-5, "zz  "), (4, None), (5, ""), (6, "12 ."), (40, "b")]


def odd(spark, folder, rows=tuple(ODD)):
    spark.createDataFrame(list(rows), "doc_id bigint, text string").repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


@pytest.mark.parametrize("name", ["ld_counts", "ld_vocab_slices", "ld_posterior", "ld_doc_llh", "ld_word_llh", "ld_summary_llh"])
def test_odd_documents_agree_with_sql(spark, tmp_path, name):
    df = catalogue.queries()[name](spark, odd(spark, tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.execute(catalogue.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in sorted(df.columns)]
    mine = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert mine == sorted(repr(tuple(row[i] for i in at)) for row in rel.fetchall())


def test_sweep_of_odd_documents_keeps_tokens(spark, tmp_path):
    got = catalogue.queries()["ld_gibbs"](spark, odd(spark, tmp_path)).collect()
    words = sum(len(duckdb.execute("select regexp_extract_all(lower(?), '\\p{L}+')", [t]).fetchone()[0]) for _, t in ODD if t)
    assert sum(r.n for r in got if r.word_id >= 0) == sum(r.n for r in got if r.word_id < 0) == words
    assert {r.topic for r in got} <= set(range(4))


def test_training_on_odd_documents_reports_each_sweep(spark, tmp_path):
    got = catalogue.queries()["ld_train"](spark, odd(spark, tmp_path)).collect()
    assert sorted(r.iteration for r in got) == [0, 1, 2] and all(np.isfinite(r.llh) for r in got)


def test_sweep_agrees_with_a_loop(spark):
    rng = np.random.default_rng(4)
    tokens = [(d, p, int(rng.integers(12)), int(rng.integers(3))) for d in range(20) for p in range(int(rng.integers(1, 30)))]
    frame = spark.createDataFrame(tokens, "doc_id bigint, pos bigint, word_id bigint, topic bigint").repartition(5)
    drawn = {(r.doc_id, r.pos): r.u for r in frame.select("doc_id", "pos", seeded(9, "doc_id", "pos").alias("u")).collect()}
    wk, dk, expected = np.zeros((12, 3)), np.zeros((20, 3)), {}
    for d, _, w, z in tokens:
        wk[w, z] += 1
        dk[d, z] += 1
    floor = len({w for _, _, w, _ in tokens}) * 0.2
    for d, p, w, z in tokens:
        own = np.arange(3) == z
        dk[d] -= own
        weights = (dk[d] + 0.1) * (wk[w] - own), dk[d] * 0.2, np.full(3, 0.1 * 0.2)
        mass = np.concatenate(weights) / np.tile(wk.sum(axis=0) - own + floor, 3)
        z = int(np.searchsorted(mass.cumsum(), drawn[d, p] * mass.sum(), side="right")) % 3
        dk[d, z] += 1
        expected[d, p] = w, z
    swept = bl.to_tokens(ld.gibbs_sweep(bl.from_tokens(frame), 3, 0.1, 0.2, 9)).collect()
    assert {(r.doc_id, r.pos): (r.word_id, r.topic) for r in swept} == expected


def test_seeded_values_are_those_of_spark(spark):
    keys = [(3, 0), (-7, 5), (None, 1 << 40), (2**62, -1)]
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i int, a bigint, b bigint").select("i", seeded(11, "a", "b").alias("u")).orderBy("i").collect()
    known = np.array([a is not None for a, _ in keys])
    assert [r.u for r in rows] == seeded_values(11, (np.array([a or 0 for a, _ in keys]), known), (np.array([b for _, b in keys]), None)).tolist()


def test_blocks_end_with_documents(monkeypatch):
    monkeypatch.setattr(bl, "BLOCK_TOKENS", 4)
    docs, sizes = [1, 1, 2, None, None, 3, 3, 3, 4], [2, 3, 1, 2, 1, 9, 1, 1, 2]
    tokens = pa.array(range(sum(sizes)))
    for cut in (1, 4, 7, 9):
        off = np.cumsum([0, *sizes])
        pieces = [(pa.array(docs[a:b], pa.int64()), np.zeros(b - a, np.int64), np.array(sizes[a:b]), tokens.slice(off[a], off[b] - off[a])) for a, b in ((0, cut), (cut, 9))]
        got = list(bl._cut(iter(pieces)))
        assert [g[0].to_pylist() for g in got] == [[1, 1], [2, None, None], [3, 3, 3], [4]]
        assert [x for g in got for x in g[3].to_pylist()] == tokens.to_pylist()
        assert all(g[2].sum() == len(g[3]) for g in got)


def test_packed_numbers_take_little_room():
    for values in ([], [0], [255, 256, 3], [1 << 24, 5], [-3, bl.NONE, 7]):
        assert bl.unpack(bl.pack(np.array(values, np.int32)), len(values)).tolist() == values
    assert len(bl.pack(np.random.default_rng(1).integers(0, 4, 100_000).astype(np.int32))) < 40_000
