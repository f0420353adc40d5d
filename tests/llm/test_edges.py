"""Null ids, repeated rows, clashing columns and empty tables for each operator."""

import re

import pytest
from pyspark.sql import functions as F

from stagewise.llm import decontamination, embedding_dedup, licenses, ngram_jaccard, packing, secrets, sharding, substring_dedup, token_counts, toxicity

TEXT = "GNU General Public License version 3, token=abcdef99 and " + " ".join(f"word{i}" for i in range(40))
#: columns that operators use inside
CLASH = "row bigint, key string, signature bigint, text_ string, matches int, doc string, secrets string, words string, salt int, class string, component string"
ROWS = [(None, TEXT), (None, TEXT), (1, TEXT), (1, TEXT), (2, None), (3, ""), (4, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (9, "k", 5, "t", 1, "d", "s", "w", 3, "c", "c")
    return spark.createDataFrame([(*r, *extra) for r in ROWS], "doc_id bigint, text string, " + CLASH).repartition(2)


def _ids(df, column="doc_id"):
    return sorted(-1 if r[column] is None else r[column] for r in df.collect())


def test_every_row_of_documents_has_its_result(spark, docs):
    model = toxicity.train(["vilegrot a", "good b"] * 50, [1, 0] * 50)
    every = {
        "toxicity": lambda d: toxicity.score_documents(d, model), "packing": packing.pack_documents, "jaccard": ngram_jaccard.ngram_jaccard, "tokens": token_counts.count_tokens,
        "substrings": substring_dedup.cut_duplicates, "secrets": secrets.scan_secrets, "licenses": licenses.scan_licenses, "shards": sharding.shard_documents,
    }
    for name, run in every.items():
        assert _ids(run(docs)) == [-1, -1, 1, 1, 2, 3, 4], name
        assert run(docs.where("false")).isEmpty(), name


def test_rows_of_one_text_are_treated_alike(docs):
    tokens = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs).collect()}
    assert len({n for i, n in tokens if i in (None, 1)}) == 1 and {n for i, n in tokens if i in (2, 3)} == {0}
    found = licenses.scan_licenses(docs).collect()
    assert {r.labels for r in found if r.doc_id in (None, 1)} == {"gpl,gpl-3"} and {r.n_words for r in found if r.doc_id in (2, 3)} == {0}
    spans = {r.doc_id: [(s.start, s.end) for s in r.secrets] for r in secrets.scan_secrets(docs).collect()}
    at = TEXT.index("token=")
    assert spans[1] == spans[None] == [(at, at + len("token=abcdef99"))] and not spans[2] and not spans[3]
    # rows without an id are no source and keep all their words; equal rows of an id count as one
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.cut_duplicates(docs).collect()} == {(None, 0), (1, 0), (2, 0), (3, 0), (4, 0)}
    groups = {(r.doc_id, r.component_id) for r in ngram_jaccard.ngram_jaccard(docs).collect()}
    assert groups == {(None, 1), (1, 1), (2, 2), (3, 3), (4, 4)}
    shards = sharding.shard_documents(docs, shards=2).collect()
    assert {r.size for r in shards if r.doc_id == 2} == {8} and {r.text_crc32 for r in shards if r.doc_id in (2, 3)} == {0}


def test_leaks_by_id(spark, docs):
    item = " ".join(re.findall(r"word\d+", TEXT)[3:25])
    benchmark = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (None, item, "x"), (2, None, "x")], "item_id bigint, text string, plain string")
    found = decontamination.leaks(docs, benchmark).collect()
    assert (1, 1) in {(r.doc_id, r.item_id) for r in found} and len({(r.doc_id, r.item_id) for r in found}) == len(found)
    assert decontamination.leaks(docs, benchmark.where("false")).isEmpty() and decontamination.leaks(docs.where("false"), benchmark).isEmpty()
    assert _ids(decontamination.drop_leaked(docs, benchmark)) == [2, 3, 4]


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (None, None, None), (3, [1.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 0), (5, [1.0, None], 0)]
    frame = spark.createDataFrame([(*r, 7, "n") for r in rows], "vec_id bigint, embedding array<float>, label int, cell int, node string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(frame).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)}
    assert embedding_dedup.embedding_dedup(frame.where("false")).isEmpty()


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels)).where(F.col("score") != 0).isEmpty()
    assert toxicity.toxicity_filter(docs, labels).count() == len(ROWS)
