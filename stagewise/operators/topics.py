"""Topic models: count tables, posterior, likelihoods and Gibbs sweeps over tokens in blocks."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import seeded_values
from ..functions.special import lgamma
from ..sources.folders import kept
from .blocks import BLOCKS, Block, from_tokens, per_block, to_tokens, with_words


def word_counts(blocks: DataFrame) -> DataFrame:
    """(word_id, topic, n)."""

    def run(b: Block) -> pa.RecordBatch:
        word, topic, n = b.by_topic(b.code, len(b.ids))
        return pa.record_batch([b.ids[word], topic, n], names=["word_id", "topic", "n"])

    return per_block(blocks, run, "word_id bigint, topic bigint, n bigint").groupBy("word_id", "topic").agg(F.sum("n").alias("n"))


def doc_counts(blocks: DataFrame) -> DataFrame:
    """(doc_id, topic, n); a document lies in one block."""

    def run(b: Block) -> pa.RecordBatch:
        doc, topic, n = b.by_topic(b.doc(), len(b.first))
        return pa.record_batch([b.doc_ids(doc), topic, n], names=["doc_id", "topic", "n"])

    return per_block(blocks, run, "doc_id bigint, topic bigint, n bigint")


def counts(blocks: DataFrame) -> DataFrame:
    """(word_id, topic, n); the topic summary is word_id -1."""
    words = kept(word_counts(blocks), "word-counts")
    return words.union(words.groupBy("topic").agg(F.sum("n").alias("n")).select(F.lit(-1).cast("bigint"), "topic", "n"))


def doc_likelihood(n: DataFrame, topics: int, alpha: float) -> DataFrame:
    """Sum over documents of the log-likelihood of their topic counts, of ``doc_counts``."""
    per_doc = n.groupBy("doc_id").agg(F.sum("n").alias("total"), F.count("*").alias("used"), F.sum(lgamma(F.col("n") + alpha)).alias("s"))
    base = math.lgamma(topics * alpha) - topics * math.lgamma(alpha)
    rest = (topics - F.col("used")) * math.lgamma(alpha)
    return per_doc.agg(F.sum(F.lit(base) + F.col("s") + rest - lgamma(F.col("total") + topics * alpha)).alias("llh"))


def word_likelihood(n: DataFrame, topics: int, beta: float) -> DataFrame:
    """Sum of lgamma(n_wk + beta) over all topics of the words that occur, of ``word_counts``."""
    per_word = n.groupBy("word_id").agg(F.sum(lgamma(F.col("n") + beta)).alias("s"), F.count("*").alias("used"))
    return per_word.agg(F.sum(F.col("s") + (topics - F.col("used")) * math.lgamma(beta)).alias("llh"))


def summary_likelihood(words: DataFrame, topics: int, vocabulary: int, beta: float) -> DataFrame:
    n = words.groupBy("topic").agg(F.sum("n").alias("n"))
    base = topics * (math.lgamma(vocabulary * beta) - vocabulary * math.lgamma(beta))
    return n.agg((F.lit(base) - F.sum(lgamma(F.col("n") + vocabulary * beta)) - (topics - F.count("*")) * math.lgamma(vocabulary * beta)).alias("llh"))


def word_topics(words: DataFrame, topics: int) -> DataFrame:
    """(word_id, wk): a word's counts by topic as an array, of ``word_counts``."""
    own: list[Column] = [F.coalesce(F.sum(F.when(F.col("topic") == k, F.col("n"))), F.lit(0)) for k in range(topics)]
    return words.groupBy("word_id").agg(F.array(*own).alias("wk"))


def topic_totals(words: DataFrame, topics: int) -> list[int]:
    found = {r.topic: r.n for r in words.groupBy("topic").agg(F.sum("n").alias("n")).collect()}
    return [found.get(k, 0) for k in range(topics)]


def vocabulary_size(words: DataFrame) -> int:
    return words.agg(F.count_distinct("word_id")).first()[0]


def _with_counts(blocks: DataFrame, words: DataFrame, topics: int) -> DataFrame:
    """Blocks with ``wk``, the counts of their words by topic, one word after another."""
    return with_words(blocks, word_topics(words, topics), "wk").withColumn("wk", F.flatten("wk"))


def posterior(blocks: DataFrame, topics: int, alpha: float, beta: float) -> DataFrame:
    """(doc_id, word_id, p0, p1 ..): normalised (n_dk + a)(n_wk + b) / (n_k + V b) of the words of each document.

    A word's counts come to each block that has it; those of a document are in its block.
    """
    words = kept(word_counts(blocks), "word-counts")
    nk = topic_totals(words, topics)
    floor = vocabulary_size(words) * beta

    def run(b: Block) -> pa.RecordBatch:
        of, n = b.doc(), len(b.ids)
        wk, dk = b.array("wk").reshape(n, topics), b.of_topics(of, len(b.first), topics)
        # rows of a word together take less room than those of a document
        pair = np.unique(b.code * np.int64(len(b.first)) + of)
        word, doc = pair // len(b.first), pair % len(b.first)
        weights = [(dk[doc, k] + alpha) * (wk[word, k] + beta) / (nk[k] + floor) for k in range(topics)]
        total = sum(weights, np.zeros(len(pair)))
        return pa.record_batch([b.doc_ids(doc), b.ids[word], *(w / total for w in weights)], names=["doc_id", "word_id", *(f"p{k}" for k in range(topics))])

    schema = "doc_id bigint, word_id bigint, " + ", ".join(f"p{k} double" for k in range(topics))
    share = per_block(_with_counts(blocks, words, topics), run, schema)
    return share.select("doc_id", "word_id", *[F.round(f"p{k}", 6).alias(f"p{k}") for k in range(topics)])


def sparse_draw(dk: np.ndarray, wk: np.ndarray, nk: np.ndarray, alpha: float, beta: float, floor: float, u: float) -> int:
    """A topic for u in [0, 1): the posterior as smoothing, document and word buckets, the largest search last.

    (n_dk + a)(n_wk + b) / (n_k + floor) is the sum of a b, n_dk b and
    (n_dk + a) n_wk over the same denominator; the document's bucket has only
    its own topics, and the word's only those of the word.
    """
    return int(sparse_draws(dk[None], wk[None], (1 / (nk + floor))[None], alpha, beta, np.array([u]))[0])


def sparse_draws(dk: np.ndarray, wk: np.ndarray, below: np.ndarray, alpha: float, beta: float, u: np.ndarray) -> np.ndarray:
    """``sparse_draw`` of many tokens at once, a row each; below is 1 / (n_k + floor). What is zero in a bucket is never drawn."""
    topics = dk.shape[1]
    mass = np.concatenate([(dk + alpha) * wk * below, dk * beta * below, alpha * beta * below], axis=1).cumsum(axis=1)
    at = u * mass[:, -1]
    return np.minimum((mass <= at[:, None]).sum(axis=1), 3 * topics - 1) % topics


def _swept(b: Block, wk: np.ndarray, nk: np.ndarray, alpha: float, beta: float, floor: float, seed: int) -> np.ndarray:
    """New topics of a block's tokens: the first token of each document, then the second of each that has one, and so on."""
    topics, of = len(nk), b.doc()
    u = seeded_values(seed, (b.key[b.run], b.known[b.run]), (b.pos(), None))
    length = np.bincount(of, minlength=len(b.first))
    order = np.argsort(-length, kind="stable")
    begin, left = (np.cumsum(length) - length)[order], length[order]
    dk = b.of_topics(of, len(b.first), topics).astype(float)[order]
    old, new = np.where((b.topic >= 0) & (b.topic < topics), b.topic, -1), np.empty(len(of), np.int64)
    # the totals less the token's own topic, the last row less none
    below = 1 / (np.vstack([nk - np.eye(topics), nk]) + floor)
    own = np.vstack([np.eye(topics), np.zeros(topics)])
    active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
    rows = np.arange(len(left))
    for i, m in enumerate(active):
        at = begin[:m] + i
        z = old[at]
        d = dk[:m]
        d -= own[z]
        z = sparse_draws(d, wk[b.code[at]] - own[z], below[z], alpha, beta, u[at])
        d[rows[:m], z] += 1
        new[at] = z
    return new


def gibbs_sweep(blocks: DataFrame, topics: int, alpha: float, beta: float, seed: int, words: DataFrame | None = None) -> DataFrame:
    """Blocks with newly drawn topics; word counts are frozen for the sweep and merged after it.

    A word's counts come to each block that has it; only the totals of topics
    are on the driver. A document's own counts follow its tokens in order.
    ``words``: the blocks' ``word_counts``, where they are known.
    """
    words = kept(word_counts(blocks), "word-counts") if words is None else words
    nk = np.array(topic_totals(words, topics), dtype=float)
    floor = vocabulary_size(words) * beta

    def run(b: Block) -> pa.RecordBatch:
        wk = b.array("wk").reshape(len(b.ids), topics).astype(float)
        return b.with_topic(_swept(b, wk, nk, alpha, beta, floor, seed))

    return per_block(_with_counts(blocks, words, topics), run, BLOCKS)


def likelihood(tokens: DataFrame, topics: int, alpha: float, beta: float, words: DataFrame | None = None) -> float:
    """Log-likelihood of documents, words and the topic summary together, of tokens or blocks."""
    blocks = tokens if "block" in tokens.columns else kept(from_tokens(tokens), "blocks")
    words = kept(word_counts(blocks), "word-counts") if words is None else words
    parts = (doc_likelihood(doc_counts(blocks), topics, alpha), word_likelihood(words, topics, beta), summary_likelihood(words, topics, vocabulary_size(words), beta))
    return sum(p.first().llh for p in parts)


def train(tokens: DataFrame, topics: int, alpha: float, beta: float, sweeps: int, stats: str, seed: int = 5) -> DataFrame:
    """Tokens or blocks after some sweeps; each one appends (iteration, seconds, llh) to the table at ``stats``."""
    spark, single = tokens.sparkSession, "block" not in tokens.columns
    blocks = kept(from_tokens(tokens), "blocks") if single else tokens
    words = kept(word_counts(blocks), "word-counts")
    for sweep in range(sweeps):
        began = time.perf_counter()
        # the sweep's tokens are written, as the next one reads them many times
        path = f"{stats}-tokens-{sweep}"
        gibbs_sweep(blocks, topics, alpha, beta, seed + sweep, words).write.mode("overwrite").parquet(path)
        blocks = spark.read.parquet(path)
        words = kept(word_counts(blocks), "word-counts")
        row = (sweep, time.perf_counter() - began, likelihood(blocks, topics, alpha, beta, words))
        spark.createDataFrame([row], "iteration int, seconds double, llh double").coalesce(1).write.mode("append").parquet(stats)
    return to_tokens(blocks) if single else blocks
