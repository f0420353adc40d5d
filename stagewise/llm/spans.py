"""Offsets of regex matches, in DataFrame expressions whose cost is linear in the matches.

A fold that appends to an array copies it at each step. Here an array is cut
into blocks, each block is folded to one value, and the values before an element
come from its block's start and the few elements before it there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
#: Characters of a chunk of text, which is cut from in place of the whole.
CHUNK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: Column, merge: Callable[[Column, Column], Column], depth: int = 2) -> Column:
    """For each element the merged elements before it, beginning with ``start``; depth: levels of blocks."""

    def fold(part: Column, first: Column) -> Column:
        return F.aggregate(part, first, merge)

    def before(v: Column, first: Column) -> Column:
        return F.transform(v, lambda _, i: fold(F.slice(v, F.lit(1), i), first))

    def of(v: Column) -> Column:
        blocks = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        part = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        starts = running(F.transform(blocks, lambda b: fold(part(b), start)), start, merge, depth - 1)
        return F.flatten(let(starts, lambda s: F.transform(blocks, lambda b: let(part(b), lambda p: before(p, F.get(s, b))))))

    return let(values, of if depth else lambda v: before(v, start))


def matches(text: Column, pattern: Column, group: int = 0) -> Column:
    """array of (start, end, body): places of the leftmost non-overlapping matches in characters, and the group's length."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    bodies = F.regexp_extract_all(text, pattern, F.lit(group)) if group else found
    sizes = F.transform(F.arrays_zip(pieces.alias("piece"), found.alias("match"), bodies.alias("body")), lambda x: F.struct(*[F.char_length(x[c]).cast("bigint").alias(c) for c in ("piece", "match", "body")]))
    placed = lambda x, at: F.struct((at + x["piece"]).alias("start"), (at + x["piece"] + x["match"]).alias("end"), x["body"].alias("body"))

    def place(v: Column) -> Column:
        before = running(F.transform(v, lambda x: x["piece"] + x["match"]), F.lit(0).cast("bigint"), lambda a, b: a + b)
        return F.zip_with(v, before, placed)

    # the last piece has no match after it
    return let(F.filter(sizes, lambda x: x["match"].isNotNull()), place)


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span (start, end), sorted by start, replaced by a mark; spans that overlap get one."""

    def between(chunks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        cut = lambda i, start, n: F.coalesce(F.substring(F.get(chunks, i), (start + 1).cast("int"), n.cast("int")), F.lit(""))
        far = F.concat(cut(first, a % CHUNK, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), cut(last, F.lit(0), b % CHUNK))
        return F.when(a >= b, "").when(first == last, cut(first, a % CHUNK, b - a)).otherwise(far)

    def cut_out(chunks: Column) -> Column:
        ends = F.transform(spans, lambda x: x["end"])
        before = running(ends, F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))
        kept = F.zip_with(spans, before, lambda x, at: F.concat(between(chunks, at, x["start"]), F.when(x["start"] >= at, mark).otherwise("")))
        return F.concat(F.array_join(kept, ""), between(chunks, F.array_max(ends), F.char_length(text).cast("bigint")))

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0)), cut_out)
