"""Substring deduplication by relative Lempel-Ziv parsing against the corpus.

Every window of ``window`` words whose words also start earlier (in a smaller
doc_id, or earlier in the same document) is a duplicate, and the words that
duplicate windows cover are removed.

The corpus is its own reference. It is cut into phrases by minimizers: the
windows that share their least ``anchor``-word hash are neighbours, and the
words under them form one phrase. A reference block holds all phrases of an
anchor, indexed by their hashes; since equal windows have equal anchors, a
document has to be factored only against the blocks of its own anchors, and
these hold every possible source. A phrase that its block has earlier matches
as a whole, with its source. Where the block has other phrases only, a match
may begin or end inside the phrase: its windows are looked up one by one.
Matches that continue one source, place by place, extend to one long match, and
the greedy parse of a document takes, from the first word on that no factor
holds, the match that reaches furthest as the next factor (start, length,
source). At factor boundaries a match from another source may overlap both, so
that every window across a seam is covered by a factor that was looked up.

Only (anchor, phrase hash, doc_id, position) moves for the first step. Anchors
with a single phrase end there; equal phrases of a task are matched in it, so a
passage that a third of the corpus shares leaves each task once. First
occurrences are minima with map-side combine, looked up by joins that AQE can
split.

Edge cases: null text has no words; a text of fewer than ``window`` words keeps
them all; kept_sha256 of no words is that of the empty string; equal rows of a
doc_id count as one and are cut alike, its rows with different texts come in
the order of the texts' hashes; rows with a null doc_id are kept whole and are
no source;
columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import discard, keep_columns, materialize
from .text import LocalRepeats, mix, released, slices, window_hashes, Words

WINDOW = 20
ANCHOR = 6


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _phrases(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, anchor hash) of each phrase of a slice.

    The anchor of a window is the least hash of ``anchor`` words in it, the
    leftmost of equal ones, so it depends on the window's words alone.
    """
    count = np.diff(words.bounds)
    windows = np.maximum(count - window + 1, 0)
    doc = np.repeat(np.arange(len(count)), windows)
    ends = np.cumsum(windows)
    start = np.repeat(words.bounds[:-1] - (ends - windows), windows) + np.arange(ends[-1] if len(ends) else 0)
    if not len(start):
        return doc, start, start, np.empty(0, np.uint64)
    grams = len(words.hash) - anchor + 1
    value = window_hashes(words.hash, np.arange(grams), anchor)
    span = window - anchor + 1
    best = np.zeros(len(start), dtype=np.int64)
    least = value[start]
    for k in range(1, span):
        other = value[start + k]
        less = other < least
        least[less] = other[less]
        best[less] = k
    at = start + best
    new = np.ones(len(start), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    # the anchor's place in the first window is a part of the phrase
    return doc[first], start[first], np.diff(np.append(first, len(start))), least[first]


def phrase_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Phrases that no earlier equal phrase of their task covers, and those that one does.

    ``matched`` rows are duplicates already and carry no key to compare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = LocalRepeats()
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                words = Words(data, off, lower=False)
                doc, start, windows, key = _phrases(words, window, anchor)
                phrase = window_hashes(words.hash, start, windows + window - 1)
                ids = part.column("doc_id")
                number = np.asarray(ids)[doc]
                place = start - words.bounds[doc] + (np.asarray(part.column("row"))[doc] << 32)
                # equal phrases of the slice: the first in order stands for them
                order = np.lexsort((place, number, phrase))
                first = np.ones(len(order), dtype=bool)
                first[1:] = phrase[order[1:]] != phrase[order[:-1]]
                source = np.empty(len(order), dtype=np.int64)
                source[order] = order[first][np.cumsum(first) - 1]
                # a repeated row is no later occurrence
                matched = (number != number[source]) | (place != place[source])
                stands, repeated = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
                own = np.flatnonzero(~matched)
                stands[own], repeated[own] = repeats.mark(key[own])
                salt = np.where(stands, 0, 1 + (mix(phrase + number.view(np.uint64)) & np.uint64(0x3FF)).astype(np.int64)).astype(np.int16)
                yield pa.record_batch(
                    [_as_long(key), pa.array(salt), pa.array(repeated | matched), pa.array(matched), _as_long(phrase), ids.take(pa.array(doc)), pa.array(place), pa.array(windows.astype(np.int32)), pa.array(number[source]), pa.array(place[source])],
                    ["anchor", "salt", "repeated", "matched", "phrase", "doc_id", "place", "windows", "source_doc", "source_place"],
                )

    return docs.mapInArrow(released(run), "anchor bigint, salt smallint, repeated boolean, matched boolean, phrase bigint, doc_id bigint, place bigint, windows int, source_doc bigint, source_place bigint")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, hash, doc_id, place) of the windows of the phrases in ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            for part, data, off in slices(batch, "text"):
                words = Words(data, off, lower=False)
                asked = part.column("asked")
                rows = asked.flatten()
                doc = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(asked.offsets)))
                place, count = np.asarray(rows.field("place")), np.asarray(rows.field("windows"))
                begin = words.bounds[doc] + (place & 0xFFFFFFFF)
                which = np.repeat(np.arange(len(doc)), count)
                step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                value = window_hashes(words.hash, begin[which] + step, window)
                yield pa.record_batch([rows.field("anchor").take(pa.array(which)), _as_long(value), part.column("doc_id").take(pa.array(doc[which])), pa.array(place[which] + step)], ["anchor", "hash", "doc_id", "place"])

    return docs.mapInArrow(released(run), "anchor bigint, hash bigint, doc_id bigint, place bigint")


def repeated_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key other rows have too; a task's marks count without a meeting."""
    w = Window.partitionBy(key, "salt")
    return rows.withColumn("many", F.count("*").over(w) > 1).where("many or repeated").drop("many", "salt", "repeated")


def duplicate_matches(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, row, start, windows, source_doc, source_start): runs of windows that also start at a source; docs has doc_id, row, text. Materialized."""
    rows = materialize(repeated_rows(phrase_rows(docs, window, anchor), "anchor"), "phrases")
    block = ["anchor", "phrase"]
    own = rows.where("not matched").drop("source_doc", "source_place")
    # whole phrases with an earlier source in the block
    source = own.groupBy(*block).agg(F.min(F.struct("doc_id", "place")).alias("source"))
    parsed = own.join(source, block).withColumn("later", F.struct("doc_id", "place") > F.col("source"))
    # first occurrences in blocks of several phrases
    several = source.groupBy("anchor").agg(F.min("phrase").alias("low"), F.max("phrase").alias("high")).where("low <> high").select("anchor")
    boundary = materialize(parsed.where("not later").join(several, "anchor").select("anchor", "doc_id", "place", "windows"), "boundaries")
    asked = boundary.groupBy("doc_id", F.shiftright("place", 32).alias("row")).agg(F.collect_list(F.struct("anchor", "place", "windows")).alias("asked"))
    ids = materialize(asked, "asked")
    windows = materialize(_window_rows(docs.join(ids, ["doc_id", "row"]).select("doc_id", "text", "asked"), window), "windows")
    first = windows.groupBy("anchor", "hash").agg(F.min(F.struct("doc_id", "place")).alias("source"))
    single = windows.join(first, ["anchor", "hash"]).where(F.struct("doc_id", "place") > F.col("source"))
    found = rows.where("matched").select("doc_id", "place", "windows", "source_doc", "source_place")
    found = found.union(parsed.where("later").select("doc_id", "place", "windows", "source.doc_id", "source.place"))
    found = found.union(single.select("doc_id", "place", F.lit(1), "source.doc_id", "source.place"))
    at = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    out = materialize(found.select("doc_id", F.shiftright("place", 32).alias("row"), at("place").alias("start"), F.col("windows").cast("bigint").alias("windows"), "source_doc", at("source_place").alias("source_start")), "matches")
    discard(rows, boundary, ids, windows)
    return out


def greedy_factors(start: np.ndarray, windows: np.ndarray, source_doc: np.ndarray, source_start: np.ndarray, window: int) -> np.ndarray:
    """Rows (start, length, source_doc, source_start) of a document's factors; equal arrays of its matches."""
    shift = source_start - start
    order = np.lexsort((start, shift, source_doc))
    start, end, source_doc, shift = start[order], (start + windows + window - 1)[order], source_doc[order], shift[order]
    # matches of one source and shift whose windows follow each other are one
    new = np.ones(len(start), dtype=bool)
    new[1:] = (source_doc[1:] != source_doc[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > end[:-1] - window + 1)
    first = np.flatnonzero(new)
    begin, reach, source_doc, shift = start[first], np.maximum.reduceat(end, first), source_doc[first], shift[first]
    order = np.lexsort((-reach, begin))
    begin, reach, source_doc, shift = (x[order] for x in (begin, reach, source_doc, shift))
    # the furthest reach of the matches that begin by then, and which one has it
    furthest = np.maximum.accumulate(reach)
    which = np.maximum.accumulate(np.where(reach == furthest, np.arange(len(reach)), 0))
    out, at, i = [], 0, 0
    while i < len(begin):
        at = max(at, int(begin[i]))
        last = int(np.searchsorted(begin, at, side="right")) - 1
        best = int(which[last])
        if furthest[last] > at:
            out.append((at, int(reach[best]) - at, int(source_doc[best]), at + int(shift[best])))
            at = int(reach[best])
        i = max(last + 1, int(np.searchsorted(furthest, at, side="right")))
    return np.array(out, dtype=np.int64).reshape(-1, 4)


FACTORS = "array<struct<start: bigint, length: bigint, source_doc: bigint, source_start: bigint>>"


def cut_duplicates(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_factors, factors[, text]) of every document.

    factors are those of the greedy parse; n_factors counts the runs of removed
    words, each of one or more factors.
    """
    texts = keep_columns(docs, "doc_id", "text").withColumn("row", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    found = duplicate_matches(texts.where("doc_id is not null"), window, anchor)
    lists = materialize(found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "windows", "source_doc", "source_start")).alias("matches")), "lists")
    discard(found)
    joined = texts.join(lists, ["doc_id", "row"], "left").select("doc_id", "text", "matches")
    fields = ("start", "windows", "source_doc", "source_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                raw, bounds, matches = data.tobytes(), off.tolist(), part.column("matches")
                n_words, n_removed, digest, n_runs, kept_text, factors = [], [], [], [], [], []
                for d, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    words = raw[a:b].split()
                    n_words.append(len(words))
                    spans = matches[d].values
                    parsed = np.empty((0, 4), dtype=np.int64)
                    if spans is not None and len(spans):
                        parsed = greedy_factors(*(np.asarray(spans.field(f)) for f in fields), window)
                        cover = np.zeros(len(words), dtype=bool)
                        for start, length, _, _ in parsed.tolist():
                            cover[start : start + length] = True
                        words = [words[i] for i in np.flatnonzero(~cover).tolist()]
                        n_runs.append(int((cover[1:] & ~cover[:-1]).sum() + cover[0]))
                    else:
                        n_runs.append(0)
                    factors.append(parsed)
                    n_removed.append(n_words[-1] - len(words))
                    kept = b" ".join(words)
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_text.append(kept.decode("utf-8", "replace"))
                flat = np.concatenate(factors)
                listed = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(4)], ["start", "length", "source_doc", "source_start"])
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(f) for f in factors])).astype(np.int32)), listed)
                columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(n_runs, pa.int64()), listed]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "factors"]
                yield pa.record_batch(columns + [pa.array(kept_text, pa.string())] * with_text, names + ["text"] * with_text)

    return joined.mapInArrow(released(run), f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_factors bigint, factors {FACTORS}" + ", text string" * with_text)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that 20-word windows found earlier in the corpus cover, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cut_duplicates(docs).drop("factors")
