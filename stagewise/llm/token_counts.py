"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but 16- or 32-bit ids, each document closed by an
end-of-document id. Files are read as blocks of fixed length, cut without regard
to documents. Each block is searched for the separator with numpy on its own; a
prefix scan over the blocks' separator counts numbers the documents, and parts
of a document that lie in several blocks meet under its number as a sum.

Edge cases: null text is a document of no ids; a file without a separator at its
end leaves an open last document (``closed`` false); an empty block or file
gives no rows; bytes at the end of a file that make no whole id are passed over; repeated doc_ids are counted each; null doc_ids stay null;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import keep_columns, materialize
from .text import released, slices
from .tokens import default_path, shared_tokenizer

END_OF_DOCUMENT = 49407
BLOCK_TOKENS = 1 << 16
#: A file is closed after the document that takes it to so many ids.
FILE_TOKENS = 1 << 24


def token_blocks(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_OF_DOCUMENT, block: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Documents as flat files: (file, block, payload, names), names only with a file's last block.

    names lists the doc_ids of a file in order; nothing tells where one starts.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part_no = shared_tokenizer(path, encode_special=True), TaskContext.get().partitionId()
        number, at, written, names, rest = 0, 0, 0, [], b""
        size = 2 * block

        def rows(payloads, listed):
            n = len(payloads)
            return pa.record_batch([pa.array([f"{part_no}-{number}"] * n), pa.array(range(at, at + n), pa.int32()), pa.array(payloads, pa.binary()), pa.array(listed, pa.list_(pa.int64()))], ["file", "block", "payload", "names"])

        for batch in batches:
            for part, data, off in slices(batch, "text"):
                ids, _ = encoder.encode(data, off, end_id)
                names += part.column("doc_id").to_pylist()
                rest += ids.astype("<u2").tobytes()
                written += len(ids)
                full = len(rest) // size
                if full:
                    yield rows([rest[i * size : (i + 1) * size] for i in range(full)], [None] * full)
                    rest, at = rest[full * size :], at + full
                if written >= file_tokens:
                    yield rows([rest], [names])
                    number, at, written, names, rest = number + 1, 0, 0, [], b""
        if names:
            yield rows([rest], [names])

    return keep_columns(docs, "doc_id", "text").mapInArrow(released(run), "file string, block int, payload binary, names array<bigint>")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, payload) of the flat files under a path that Spark can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for i, start in enumerate(range(0, len(content), width * block)):
                    yield pa.record_batch([pa.array([file]), pa.array([i], pa.int32()), pa.array([content[start : start + width * block]], pa.binary())], ["file", "block", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(released(run), "file string, block int, payload binary")


def scan_separators(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, closed): the ids of every document without its separator."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("payload")[i].as_buffer()
                ids = np.frombuffer(raw, dtype=kind, count=len(raw) // width)
                if not len(ids):
                    continue
                ends = np.flatnonzero(ids == end_id)
                lengths = np.diff(np.append(-1, ends)) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                lengths = np.append(lengths, tail)
                closed = np.ones(len(lengths), dtype=np.int32)
                closed[-1] = 0
                n = len(lengths)
                yield pa.record_batch([batch.column("file").slice(i, 1).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, batch.column("block")[i].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int64)), pa.array(lengths.astype(np.int64)), pa.array(closed)], ["file", "block", "place", "tokens", "closed"])

    parts = materialize(blocks.select("file", "block", "payload").mapInArrow(released(run), "file string, block int, place bigint, tokens bigint, closed int"), "parts")
    seps = parts.groupBy("file", "block").agg(F.sum("closed").alias("n"))
    # a file has a bounded number of blocks
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = seps.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = parts.where("tokens > 0 or closed = 1").join(starts, ["file", "block"]).withColumn("ordinal", F.col("before") + F.col("place"))
    return numbered.groupBy("file", "ordinal").agg(F.sum("tokens").alias("n_tokens"), (F.max("closed") == 1).alias("closed"))


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal) of documents written to flat files and scanned."""
    blocks = materialize(token_blocks(docs, tokenizer), "blocks")
    names = blocks.where("names is not null").select("file", F.posexplode("names").alias("ordinal", "doc_id"))
    counted = scan_separators(blocks)
    return names.join(counted, [names["file"] == counted["file"], names["ordinal"].cast("bigint") == counted["ordinal"]]).select("doc_id", "n_tokens", counted["file"], counted["ordinal"])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, from flat token files."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
