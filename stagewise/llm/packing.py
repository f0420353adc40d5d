"""Best-fit packing with certified repacking.

Documents become token pieces of at most ``capacity`` ids (only longer ones are
cut). Full pieces are sequences of their own. The others are dealt into groups
by hash and packed best-fit decreasing; a group's bin count is compared with
lower bounds from dual feasible functions. Every group, at its bound or not,
gives up the documents of its emptiest bins, of one at least; these are
exchanged between groups and packed again, in ever fewer groups, until a last
group packs them all. ``certified_bound`` takes the bounds over the lengths of
all pieces, so that the number of sequences can be held against it.

Edge cases: null text packs as an empty text, which is its end id alone;
repeated rows of one doc_id are packed each (they share doc_id and piece
numbers); an empty table gives no rows; ties in length go by hash and doc_id;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import keep_columns, materialize
from .text import released, slices
from .tokens import default_path, int_array, shared_tokenizer

CAPACITY = 4096
END_ID = 1
#: Pieces packed together by one task, and most pieces that a group gives up.
GROUP_PIECES = 4096
EXCHANGE_PIECES = 1024

PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document; ``row`` tells repeated doc_ids apart; ``with_ids`` adds the ids."""
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_tokenizer(path)
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                ids, at = encoder.encode(data, off, end_id)
                size = np.diff(at)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                begin = at[doc] + start
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                columns = [part.column("doc_id").take(pa.array(doc)), part.column("row").take(pa.array(doc)), pa.array(piece.astype(np.int32)), int_array(start), int_array(length), int_array(crc)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]).astype(np.int32)), pa.array(ids)))
                yield pa.record_batch(columns, ["doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    # the row number is computed before anything is exploded
    rows = keep_columns(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(released(cut), PIECES + ", ids array<int>" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the free room of each bin.

    Open bins are kept by free room in a bitmap, so the tightest bin that fits
    is one shift and one lowest-bit search away.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    free: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            which = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, which = capacity, len(free)
            free.append(capacity)
        bins[i], offset[i] = which, capacity - room
        left = room - size
        free[which] = left
        if left:
            by_room.setdefault(left, []).append(which)
            rooms |= 1 << left
    return bins, offset, np.asarray(free, dtype=np.int64)


def bin_lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Largest bound over two families of dual feasible functions; counts: items of each length.

    u_k rounds sizes to k+1 classes; the threshold family counts items above
    C - t as whole bins, keeps those of at least t and drops the smaller.
    """
    if not len(lengths):
        return 0
    counts = np.ones(len(lengths), dtype=np.int64) if counts is None else counts
    best = -(-int((lengths * counts).sum()) // capacity)
    for k in range(1, 21):
        scaled = lengths * (k + 1)
        whole = scaled % capacity == 0
        value = np.where(whole, lengths * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    order = np.argsort(lengths, kind="stable")
    ordered, items = lengths[order], np.append(0, np.cumsum(counts[order]))
    total = np.append(0, np.cumsum(ordered * counts[order]))
    t = np.unique(ordered[ordered <= capacity // 2])
    low = np.searchsorted(ordered, t)
    high = np.searchsorted(ordered, capacity - t, side="right")
    if len(t):
        best = max(best, int((items[-1] - items[high] + -(-(total[high] - total[low]) // capacity)).max()))
    return best


def certified_bound(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """Fewest sequences that any packing of the pieces needs, by their lengths; at most ``capacity`` rows reach the driver."""
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    return bin_lower_bound(sizes["length"].to_numpy(dtype=np.int64), capacity, sizes["n"].to_numpy(dtype=np.int64))


def _pack_group(round_no: int, last: bool, capacity: int, exchange: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id", "row", "piece"], ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, offset, free = best_fit_decreasing(lengths, capacity)
        bound = bin_lower_bound(lengths, capacity)
        released = np.zeros(len(free), dtype=bool)
        if not last:
            emptiest = np.argsort(-free, kind="stable")
            emptiest = emptiest[free[emptiest] > 0]
            sizes = np.bincount(bins, minlength=len(free))[emptiest]
            released[emptiest[np.cumsum(sizes) <= exchange]] = True
            released[emptiest[:1]] = True
        number = (round_no << 56) + (int(group["group"].iloc[0]) << 20) + bins
        return group[["doc_id", "row", "piece", "length"]].assign(sequence_id=number, offset=offset, open=released[bins], bound=bound)

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, exchange: int = EXCHANGE_PIECES) -> DataFrame:
    """(doc_id, row, piece, sequence_id, offset) for every piece of a materialized piece table."""
    key = ["doc_id", "row", "piece"]
    full = pieces.where(F.col("length") >= capacity).select(*key, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    done = [full]
    rest, round_no = pieces.where(F.col("length") < capacity).select(*key, "length"), 0
    schema = "doc_id bigint, row bigint, piece int, length bigint, sequence_id bigint, offset bigint, open boolean, bound bigint"
    groups = None
    while n := rest.count():
        # fewer each round, even where groups of tiny pieces give up all they have
        groups = max(1, min(math.ceil(n / group_pieces), n if groups is None else groups // 2))
        dealt = rest.withColumn("order", F.xxhash64(F.lit(round_no), *key)).withColumn("group", F.pmod(F.xxhash64(F.lit(round_no + 1000), *key), F.lit(groups)))
        packed = materialize(dealt.groupBy("group").applyInPandas(_pack_group(round_no, groups == 1, capacity, exchange), schema), "packed")
        done.append(packed.where("not open").select(*key, "sequence_id", "offset"))
        rest, round_no = packed.where("open").select(*key, "length"), round_no + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and place, and the certified bound on sequences; sequence ids are any distinct numbers."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    # ids of rows are unique, null doc_ids among them
    placed = pack(pieces, capacity).drop("doc_id")
    return pieces.join(placed, ["row", "piece"]).withColumn("bound", F.lit(certified_bound(pieces, capacity)).cast("bigint"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bound")
