"""The corpus pipeline's stages against brute force on a small planted corpus."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from stagewise.llm.decontamination import drop_leaked
from stagewise.llm.ngram_jaccard import one_of_each_group
from stagewise.llm.storage import materialize
from stagewise.llm.tokens import default_path
from stagewise.llm.toxicity import toxicity_filter

ITEM = "A train of 24 wagons leaves Northtown at 9 hours and travels 350 km to reach Southville before the evening storm begins"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _corpus(spark, folder):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(200)]
    texts, labels = {}, []
    for i in range(200):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if i % 4 == 0:
            words[7] = words[21] = "vilegrot"
        texts[i] = " ".join(words)
        labels.append((i, 1, int(i % 4 == 0)))
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts |= {300: texts[1] + " tail", 301: texts[1], 302: f"{make(30)} {ITEM} {make(30)}", 303: f"{make(40)} password: hunter2secret {make(10)}", 304: None, 305: "", 306: make(6000)}
    spark.createDataFrame([(i, t, "en", None, 0) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(10, ITEM), (11, None), (12, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_filters_decide_by_row(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    toxic, clean, same = "vilegrot " * 3 + make(30), make(40), make(50)
    rows = [(None, toxic), (1, toxic), (1, clean), (2, same), (2, same), (None, same), (None, ITEM), (3, ITEM), (3, make(40))]
    rows += [(10 + i, " ".join(["vilegrot" if i % 4 == 0 and k in (7, 21) else make(1) for k in range(40)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(10 + i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    few = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.where("doc_id is null or doc_id < 10").collect())
    left = few(toxicity_filter(docs, labels))
    assert not [i for i, t in left if t == toxic] and (1, clean) in left
    assert [i for i, t in few(one_of_each_group(docs)) if t == same] == [2]
    left = few(drop_leaked(docs, spark.createDataFrame([(10, ITEM)], "item_id bigint, text string")))
    assert not [i for i, t in left if t == ITEM] and [i for i, _ in left].count(3) == 1


def test_pipeline_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    _corpus(spark, folder)
    docs, tables = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        tables.append({r.doc_id: r.text for r in docs.collect()})
        docs = materialize(stage(spark, docs, folder), name)
        assert name == "packing" or docs.columns == COLUMNS
    # the first stage may reject planted documents, so these two are also held to the whole corpus
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    assert tables[0].keys() - {r.doc_id for r in corpus_pipeline.decontamination(spark, whole, folder).collect()} == {302}
    assert {r.doc_id for r in corpus_pipeline.secrets(spark, whole, folder).collect() if r.text != tables[0][r.doc_id]} == {303}
    before, clean, unique, fair, final = tables
    toxic = {i for i in range(200) if i % 4 == 0}
    rejected = before.keys() - clean.keys()
    assert len(rejected ^ toxic) <= 4, rejected ^ toxic
    assert clean.keys() - unique.keys() == {300, 301} & clean.keys() and 1 in unique
    assert unique.keys() - fair.keys() == {302} & unique.keys()
    assert fair.keys() == final.keys() and {i for i in fair if fair[i] != final[i]} == {303} & fair.keys()
    assert "hunter2secret" not in final.get(303, "")
    encode, rows = Tokenizer.from_file(default_path()), docs.collect()
    bins = {}
    for r in rows:
        ids = np.asarray(encode.encode(final[r.doc_id] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert r.start == r.piece * 4096 and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert r.length == min(4096, len(ids) - r.start)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {r.doc_id for r in rows} == final.keys()
    for places in bins.values():
        places.sort()
        ends = np.cumsum([n for _, n in places])
        assert [o for o, _ in places] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_stages_with_clashing_columns_nulls_repeats_and_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    _corpus(spark, folder)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, row_key string, key string, score double, secrets string, mask int, class string, doc string"
    extra = (7, "k", "k", 0.5, "s", 1, "c", "d")
    same = " ".join(f"word{i}" for i in range(40))
    rows = [(None, None, None, None, None, *extra)] * 2 + [(5, same, "en", "s", 1, *extra)] * 3 + [(6, "", "en", "s", 0, *extra), (7, "token: abcdef123 " * 3, "en", "s", 1, *extra)]
    docs = spark.createDataFrame(rows, schema).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, folder), stage(spark, docs.where("false"), folder)
        assert none.isEmpty(), name
        if name != "packing":
            assert out.dtypes == docs.dtypes, name
        got = sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect())
        # of equal rows one stays in the second stage; the others keep all
        assert got == ([-1, -1, 5, 6, 7] if name == "near_duplicates" else [-1, -1, 5, 5, 5, 6, 7]), name
