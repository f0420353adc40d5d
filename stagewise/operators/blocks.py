"""Tokens in blocks: a row holds many whole documents, the words that occur in them, and a code into these for each token.

A block has runs of tokens (``doc``, first position ``start``, ``size``), which
are whole documents one after another, then for each token its ``code``, the
place of its word in ``ids``, and its ``topic``, both packed. What is known of words reaches a
block by its own words, once each, so that tokens are never shuffled one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens after which a block ends, at the next document.
BLOCK_TOKENS = 1 << 21
#: Bytes of text that are split at once.
PIECE_BYTES = 1 << 22
#: The topic of tokens that have none, as they have no doc_id.
NONE = -(1 << 31)

_RUNS = "block bigint, doc array<bigint>, start array<bigint>, size array<int>, code binary"
CODED = f"{_RUNS}, words array<string>"
BLOCKS = f"{_RUNS}, ids array<bigint>, topic binary"


def pack(values: np.ndarray) -> bytes:
    """32-bit numbers in few bytes: their first bytes, then their second ones, and so on, compressed."""
    width = 4 if len(values) and values.min() < 0 else max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, dtype="<i4").view(np.uint8).reshape(-1, 4)[:, :width]
    return bytes([width]) + pa.compress(planes.T.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed[1:], decompressed_size=n * packed[0], codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 4), np.uint8)
    out[:, : packed[0]] = planes.reshape(packed[0], n).T
    return out.view("<i4").reshape(-1)


def _told(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The code of each word and the words by code, frequent ones first."""
    told = words.dictionary_encode()
    codes = told.indices.to_numpy()
    order = np.argsort(-np.bincount(codes, minlength=len(told.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return rank[codes], told.dictionary.take(pa.array(order))


def _row(schema: str, values: list) -> pa.RecordBatch:
    """A row of a block's number, arrays and packed bytes."""
    first, *rest = values
    lists = [pa.array([x], pa.binary()) if isinstance(x, bytes) else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x) if isinstance(x, np.ndarray) else x) for x in rest]
    return pa.record_batch([pa.array([first], pa.int64()), *lists], names=[c.split()[0] for c in schema.split(", ")])


def _cut(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """Pieces (doc, start, size, flat arrays ..) put together to blocks; runs of one doc_id that follow each other stay in one."""
    held, count, last = [], 0, None
    for doc, start, size, *flat in pieces:
        if not len(doc):
            continue
        off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        key, known = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), pc.is_valid(doc).to_numpy(zero_copy_only=False)
        fresh = np.concatenate([[last != (key[0], known[0])], (key[1:] != key[:-1]) | (known[1:] != known[:-1])])
        last, cuts, at = (key[-1], known[-1]), np.flatnonzero(fresh), 0

        def part(a: int, b: int) -> list:
            return [doc.slice(a, b - a), start[a:b], size[a:b], *(f.slice(off[a], off[b] - off[a]) for f in flat)]

        while True:
            j = max(np.searchsorted(off[cuts], off[at] + BLOCK_TOKENS - count), np.searchsorted(cuts, at))
            if j == len(cuts):
                held.append(part(at, len(doc)))
                count += off[-1] - off[at]
                break
            if cuts[j] > at:
                held.append(part(at, cuts[j]))
            yield _together(held)
            held, count, at = [], 0, cuts[j]
    if held:
        yield _together(held)


def _together(held: list[list]) -> tuple:
    doc, start, size, *flat = zip(*held)
    return pa.concat_arrays(doc), np.concatenate(start), np.concatenate(size).astype(np.int32), *(pa.concat_arrays(f) for f in flat)


def _numbers() -> Iterator[int]:
    """Numbers for the blocks of this task."""
    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pieces (doc, start, size, words) of rows (doc_id, text): runs of letters of the text in lower case.

    As in SQL, letters are those of RE2 and each is lowered alone, whatever stands beside it.
    """
    for batch in batches:
        doc, text = batch.column(0), pc.fill_null(batch.column(1), "")
        length = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + PIECE_BYTES, side="right")))
            split = pc.split_pattern_regex(pc.utf8_lower(text.slice(at, to - at).cast(pa.string())), r"\P{L}+")
            words = split.flatten()
            # what stands before the first separator and after the last one may be empty
            run = np.repeat(np.arange(to - at), pc.list_value_length(split).to_numpy(zero_copy_only=False))
            some = pc.not_equal(words, "")
            size = np.bincount(run[some.to_numpy(zero_copy_only=False)], minlength=to - at)
            rows = np.flatnonzero(size)
            yield doc.slice(at, to - at).take(pa.array(rows)), np.zeros(len(rows), np.int64), size[rows], words.filter(some)
            at = to


def coded(rows: DataFrame) -> DataFrame:
    """Blocks, yet without ids and topics, of rows (doc_id, text); rows of one doc_id follow each other in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (doc, start, size, words) in zip(_numbers(), _cut(_words(batches))):
            code, of = _told(words)
            yield _row(CODED, [k, doc, start, size, pack(code), of])

    return rows.mapInArrow(run, CODED)


def words_of_sets(rows: DataFrame) -> DataFrame:
    """(word, bits) of rows (number, text): the sum of 2 ^ number over the different numbers, below 63, of rows with the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, size, words in _cut(_words(batches)):
            told = words.dictionary_encode()
            bits = np.zeros(len(told.dictionary), np.int64)
            np.bitwise_or.at(bits, told.indices.to_numpy(), np.repeat(np.int64(1) << number.to_numpy().astype(np.int64), size))
            yield pa.record_batch([told.dictionary, bits], names=["word", "bits"])

    return rows.mapInArrow(run, "word string, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))


def from_tokens(tokens: DataFrame) -> DataFrame:
    """Blocks of rows (doc_id, pos, word_id, topic)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            doc, pos, word, topic = batch.columns
            key, known, p = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), pc.is_valid(doc).to_numpy(zero_copy_only=False), pos.to_numpy()
            begins = np.ones(len(p), bool)
            begins[1:] = (key[1:] != key[:-1]) | (known[1:] != known[:-1]) | (p[1:] != p[:-1] + 1)
            at = np.flatnonzero(begins)
            yield doc.take(pa.array(at)), p[at], np.diff(at, append=len(p)), word, pc.fill_null(topic, NONE).cast(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (doc, start, size, word, topic) in zip(_numbers(), _cut(pieces(batches))):
            code, of = _told(word)
            yield _row(BLOCKS, [k, doc, start, size, pack(code), of, pack(topic.to_numpy())])

    rows = tokens.select(*(F.col(c).cast("bigint") for c in ("doc_id", "pos", "word_id", "topic")))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "word_id", "topic").mapInArrow(run, BLOCKS)


class Block:
    """A row of blocks as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.number = batch["block"][i].as_py()
        self.has = {c: batch[c][i] for c in batch.schema.names}
        self.docs = self.has["doc"].values
        self.start, self.size, self.ids = (self.array(c) for c in ("start", "size", "ids"))
        self.code, self.topic = (unpack(self.has[c].as_py(), int(self.size.sum())) if c in self.has else None for c in ("code", "topic"))
        self.key, self.known = pc.fill_null(self.docs, 0).to_numpy(zero_copy_only=False), pc.is_valid(self.docs).to_numpy(zero_copy_only=False)
        fresh = np.ones(len(self.key), bool)
        fresh[1:] = (self.key[1:] != self.key[:-1]) | (self.known[1:] != self.known[:-1])
        #: The first run of each document, and the document of each run.
        self.first, self.of_run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        self.run = np.repeat(np.arange(len(self.size)), self.size)

    def array(self, column: str) -> np.ndarray:
        return self.has[column].values.to_numpy()

    def doc(self) -> np.ndarray:
        """The document of each token, from 0."""
        return self.of_run[self.run]

    def pos(self) -> np.ndarray:
        before = np.cumsum(self.size, dtype=np.int64) - self.size
        return self.start[self.run] + np.arange(len(self.code)) - before[self.run]

    def doc_ids(self, which: np.ndarray) -> pa.Array:
        return self.docs.take(pa.array(self.first[which]))

    def by_topic(self, group: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(group, topic, tokens) of all pairs that occur; group has a number below n for each token."""
        some = self.topic[self.topic != NONE]
        low, high = (int(some.min()), int(some.max())) if len(some) else (0, -1)
        width = high - low + 2
        place = np.where(self.topic == NONE, width - 1, self.topic - np.int64(low))
        found = np.bincount(group.astype(np.int64) * width + place, minlength=n * width)
        at = np.flatnonzero(found)
        return at // width, pa.array(at % width + low, mask=at % width == width - 1), found[at]

    def of_topics(self, group: np.ndarray, n: int, topics: int) -> np.ndarray:
        """Tokens by group and topic; those without one of the topics do not count."""
        ok = (self.topic >= 0) & (self.topic < topics)
        return np.bincount(group[ok].astype(np.int64) * topics + self.topic[ok], minlength=n * topics).reshape(n, topics)

    def with_topic(self, topic: np.ndarray) -> pa.RecordBatch:
        return _row(BLOCKS, [self.number, self.docs, self.start, self.size, self.has["code"].as_py(), self.ids, pack(topic)])


def per_block(blocks: DataFrame, run: Callable[[Block], pa.RecordBatch], schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield run(Block(batch, i))

    return blocks.mapInArrow(each, schema)


def start_topics(blocks: DataFrame, topics: int) -> DataFrame:
    """Blocks with first topics by arithmetic: (doc_id * 31 + pos * 17 + word_id) % topics, the remainder of SQL."""

    def run(b: Block) -> pa.RecordBatch:
        if len(b.key) and max(-int(b.key.min()), int(b.key.max())) > (1 << 58) - (1 << 53):
            raise OverflowError("a doc_id times 31 is beyond 64 bits")
        topic = np.fmod((b.key * 31)[b.run] + b.pos() * 17 + b.ids[b.code], topics)
        return b.with_topic(np.where(b.known[b.run], topic, NONE))

    return per_block(blocks, run, BLOCKS)


def to_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, word_id, topic) of every token."""

    def run(b: Block) -> pa.RecordBatch:
        columns = [b.docs.take(pa.array(b.run)), b.pos(), b.ids[b.code], pa.array(b.topic.astype(np.int64), mask=b.topic == NONE)]
        return pa.record_batch(columns, names=["doc_id", "pos", "word_id", "topic"])

    return per_block(blocks, run, "doc_id bigint, pos bigint, word_id bigint, topic bigint")


def gathered(entries: DataFrame, i: str, *values: str) -> DataFrame:
    """(block, an array for each of ``values``): a block's entries in the order of ``i``."""
    rows = entries.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(i, *values))).alias("t"))
    return rows.select("block", *(F.col(f"t.{v}").alias(v) for v in values))


def with_words(blocks: DataFrame, words: DataFrame, *values: str) -> DataFrame:
    """Blocks with an array for each of ``values``, a column of ``words`` by word_id, of the block's words."""
    entries = blocks.select("block", F.posexplode("ids").alias("i", "word_id")).join(words, "word_id")
    return blocks.join(gathered(entries, "i", *values), "block")
