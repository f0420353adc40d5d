"""Benchmark decontamination by template windows.

Words are lower-cased (ASCII and Latin-1) runs of ASCII letters, digits and
non-ASCII bytes. Numbers,
units and names become typed placeholders and keep their values as slots: a
number starts with a digit (neighbouring ones are one), a unit is in ``UNITS``,
a name is a capitalised word inside a sentence. Windows of ``WIDTH`` template
words of documents and benchmark items are hash-joined; windows with more
placeholders than words are no evidence. Beside them, windows of plain
lower-case words (numbers and names literal) find verbatim copies in any case;
an item of which ``COVERAGE`` of the plain windows are found is an exact leak. An item leaks into a document if at
least ``COVERAGE`` of its windows are found in one occurrence there and its
slots are consistent: one item value never stands for two document values. An
occurrence is the hits of one offset between document and item, the hits of
neighbouring offsets (at most ``TOLERANCE`` apart, for inserted or dropped words),
or all hits of the document; one that passes is enough. Items that were only given
other numbers, names or units are thereby caught, and marked as not ``exact``.

Before the join, document windows pass a bitmap of the benchmark's hashes. The
bitmap has a fixed size (2 MB) whatever the benchmark holds; it only lets
through more strangers, which the join then drops.

Edge cases: null or empty texts and items have no windows; items of 4 to
``WIDTH`` - 1 words are one window of their own length, shorter ones and those
of placeholders mostly are never found by template, and ``found_verbatim_only`` lists them; an item shorter than ``WIDTH`` plain words is one plain window
whatever its length, so an item of one word is found wherever that word is; repeated documents are found each (one row per doc_id and item_id);
equal items are all reported; empty tables give no rows; columns other than
doc_id, item_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import by_row, drop_rows, hash_bitmap, in_bitmap, keep_columns, materialize
from .text import released, slices, window_hashes, Words

WIDTH = 8
LEAST_WIDTH = 4
COVERAGE = 0.5
#: Words by which the offsets of an occurrence may differ from hit to hit.
TOLERANCE = 8

# Unit words that stand for a placeholder.
UNITS = """
mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons
ounce ounces pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes
hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents
degree degrees watt watts volt volts joule joules hertz meter meters metre metres kilometer kilometers
""".split()

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[10, 33, 46, 63]] = True
_PLACEHOLDERS = np.array([0, 0x1B56C4E9A7F2D381, 0x2545F4914F6CDD1D, 0x3C6EF372FE94F82B], dtype=np.uint64)

_PLAIN = np.uint64(0x7C15D1B54A32D192)


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    return np.unique(Words(raw, np.array([0, len(raw)]), lower=True, word_bytes=_WORD).hash)


_UNIT_HASHES = _unit_hashes()


class Template:
    """Template words of a slice: hash with placeholders, value, and document bounds."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        folded = data.copy()
        accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        folded[accent] += 0x20
        words = Words(folded, off, lower=True, word_bytes=_WORD)
        n, doc = len(words.start), words.doc_of()
        if not n:
            self.hash = self.value = self.plain = np.empty(0, np.uint64)
            self.kind, self.bounds = np.empty(0, np.int64), np.zeros(len(off), np.int64)
            self.plain_bounds = self.bounds
            return
        first = data[words.start]
        second, third, fourth = (data[np.minimum(words.start + k, len(data) - 1)] for k in (1, 2, 3))
        kind = np.where((first >= 48) & (first <= 57), 1, 0)
        kind[np.isin(words.hash, _UNIT_HASHES)] = 2
        ends = np.append(0, np.cumsum(_ENDS[data]))
        inside = np.zeros(n, dtype=bool)
        inside[1:] = (doc[1:] == doc[:-1]) & (ends[words.start[1:]] == ends[words.end[:-1]])
        capital = ((first >= 65) & (first <= 90) & (second >= 97) & (second <= 122)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (((third >= 97) & (third <= 122)) | ((third == 0xC3) & (fourth >= 0xA0))))
        kind[inside & capital & (words.end - words.start > 1) & (kind == 0)] = 3
        keep = np.ones(n, dtype=bool)
        keep[1:] = ~((kind[1:] == 1) & (kind[:-1] == 1) & (doc[1:] == doc[:-1]))
        self.kind, self.value = kind[keep], words.hash[keep]
        self.hash = np.where(self.kind > 0, _PLACEHOLDERS[self.kind], self.value)
        self.bounds = np.append(0, np.cumsum(keep))[words.bounds]
        #: plain words, salted so that their windows are never template windows
        self.plain, self.plain_bounds = words.hash ^ _PLAIN, words.bounds


def template_windows(df: DataFrame, key: str, widths: list[int], plain_widths: list[int], bitmap: np.ndarray | None = None, own_width: bool = False) -> DataFrame:
    """(key, plain, place, n_windows, hash, slots) of the template and plain windows that pass the bitmap.

    own_width: a text shorter than ``WIDTH`` is one window of its own length.
    """
    shared = None if bitmap is None else df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                t = Template(data, off)
                slots = np.flatnonzero(t.kind)
                for plain, width in [*((False, w) for w in widths), *((True, w) for w in plain_widths)]:
                    words, bounds = (t.plain, t.plain_bounds) if plain else (t.hash, t.bounds)
                    count = np.diff(bounds)
                    if own_width:
                        windows = np.where(np.minimum(count, WIDTH) == width, count - width + 1, 0)
                    else:
                        windows = np.maximum(count - width + 1, 0)
                    if not windows.any():
                        continue
                    doc = np.repeat(np.arange(len(count)), windows)
                    ends = np.cumsum(windows)
                    start = np.repeat(bounds[:-1] - (ends - windows), windows) + np.arange(ends[-1])
                    value = window_hashes(words, start, width)
                    if bits is not None:
                        hit = np.flatnonzero(in_bitmap(bits, value))
                        doc, start, value = doc[hit], start[hit], value[hit]
                    if plain:
                        low = high = np.zeros(len(start), np.int64)
                    else:
                        low, high = np.searchsorted(slots, start), np.searchsorted(slots, start + width)
                        fine = 2 * (high - low) <= width
                        doc, start, value, low, high = (x[fine] for x in (doc, start, value, low, high))
                    if not len(doc):
                        continue
                    size = high - low
                    edge = np.append(0, np.cumsum(size))
                    which = np.repeat(low - edge[:-1], size) + np.arange(edge[-1])
                    lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(t.value[slots[which]].view(np.int64)))
                    columns = [part.column(key).take(pa.array(doc)), pa.array(np.full(len(doc), plain)), pa.array(start - bounds[doc]), pa.array(windows[doc]), pa.array(value.view(np.int64)), lists]
                    yield pa.record_batch(columns, [key, "plain", "place", "n_windows", "hash", "slots"])

    return keep_columns(df, key, "text").mapInArrow(released(run), f"{key} bigint, plain boolean, place bigint, n_windows bigint, hash bigint, slots array<bigint>")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, found_windows, exact, first_place) of leaked items."""
    items = materialize(template_windows(benchmark, "item_id", list(range(LEAST_WIDTH, WIDTH + 1)), list(range(1, WIDTH + 1)), own_width=True), "items")
    # item windows that can't be evidence don't count against an item
    sizes = items.groupBy("item_id", "plain").agg(F.count("*").alias("n_windows"))
    short = _short_widths(benchmark).collect()
    lengths, plain_lengths = (sorted({WIDTH, *(r.w for r in short if r.plain == plain)}) for plain in (False, True))
    found = template_windows(docs, "doc_id", lengths, plain_lengths, hash_bitmap(items, "hash"))
    hits = found.select("doc_id", F.col("place").alias("at"), "plain", "hash", F.col("slots").alias("mine")).join(items.select("item_id", "plain", "place", "hash", "slots"), ["plain", "hash"]).where(F.size("mine") == F.size("slots"))
    hits = materialize(hits.select("doc_id", "item_id", "plain", "place", "at", "slots", "mine"), "hits")
    pair = ["doc_id", "item_id"]
    enough = lambda c: F.coalesce(F.col(c), F.lit(0)) >= F.col("n_windows") * coverage
    counted = lambda rows, by: rows.groupBy(*by).agg(F.count_distinct("place").alias("found_windows"), F.min("at").alias("first_place"))
    verbatim = counted(hits.where("plain"), pair).join(sizes.where("plain").drop("plain"), "item_id").where(enough("found_windows"))
    verbatim = verbatim.select(*pair, "n_windows", "found_windows", F.lit(True).alias("exact"), "first_place")
    hits, sizes = hits.where("not plain"), sizes.where("not plain").drop("plain")
    # each hit counts in three occurrences: its offset's, its neighbouring offsets', the document's
    offset = F.col("at") - F.col("place")
    step = Window.partitionBy(*pair).orderBy("offset")
    offsets = hits.select(*pair, offset.alias("offset")).distinct().withColumn("jump", (F.col("offset") - F.lag("offset").over(step) > TOLERANCE).cast("int"))
    near = offsets.select(*pair, "offset", F.sum(F.coalesce("jump", F.lit(0))).over(step.rowsBetween(Window.unboundedPreceding, 0)).alias("near"))
    level = lambda k, c: F.struct(F.lit(k).alias("level"), c.cast("bigint").alias("number"))
    occurrence = F.explode(F.array(level(0, F.col("offset")), level(1, F.col("near")), level(2, F.lit(0))))
    hits = materialize(hits.withColumn("offset", offset).join(near, [*pair, "offset"]).select(*pair, occurrence.alias("occurrence"), "place", "at", "slots", "mine"), "occurrences")
    by = [*pair, "occurrence"]
    pairs = hits.select(*by, F.explode(F.arrays_zip("slots", "mine")).alias("p")).select(*by, F.col("p.slots").alias("theirs"), F.col("p.mine").alias("ours")).distinct()
    slots = pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_distinct("theirs").alias("values"))
    same = hits.where("slots = mine").groupBy(*by).agg(F.count_distinct("place").alias("same_windows"))
    joined = counted(hits, by).join(sizes, "item_id").join(slots, by, "left").join(same, by, "left")
    consistent = F.coalesce(F.col("pairs") == F.col("values"), F.lit(True))
    passed = joined.where((enough("found_windows") & consistent) | enough("same_windows")).withColumn("exact", enough("same_windows"))
    # the occurrence with the most windows speaks for the pair, the first of equal ones
    best = F.max_by(F.struct("n_windows", "found_windows", "first_place"), F.struct("found_windows", -F.col("first_place"))).alias("r")
    typed = passed.groupBy(*pair).agg(best, F.max("exact").alias("exact")).select(*pair, "r.n_windows", "r.found_windows", "exact", "r.first_place")
    # one row a pair, counts of the template where it leaks by both
    both = typed.withColumn("turn", F.lit(0)).union(verbatim.withColumn("turn", F.lit(1))).groupBy(*pair).agg(F.min_by(F.struct("n_windows", "found_windows", "first_place"), "turn").alias("r"), F.max("exact").alias("exact"))
    return both.select(*pair, "r.n_windows", "r.found_windows", "exact", "r.first_place")


def _short_widths(benchmark: DataFrame) -> DataFrame:
    """Lengths below ``WIDTH`` of the items' templates and plain words; at most eleven rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, off in slices(batch, "text"):
                t = Template(data, off)
                for plain, bounds, least in ((False, t.bounds, LEAST_WIDTH), (True, t.plain_bounds, 1)):
                    count = np.unique(np.diff(bounds))
                    count = count[(count >= least) & (count < WIDTH)]
                    yield pa.record_batch([pa.array(np.full(len(count), plain)), pa.array(count)], ["plain", "w"])

    return keep_columns(benchmark, "text").mapInArrow(released(run), "plain boolean, w bigint").distinct()


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item, all columns kept; repeated rows and null doc_ids are judged by their text."""
    found = leaks(by_row(docs), benchmark).select("doc_id").distinct()
    return drop_rows(docs, materialize(found, "leaked"))


def found_verbatim_only(benchmark: DataFrame) -> DataFrame:
    """(item_id): items with words but without a template window, which are found as plain copies alone."""
    windows = template_windows(benchmark, "item_id", list(range(LEAST_WIDTH, WIDTH + 1)), list(range(1, WIDTH + 1)), own_width=True)
    return windows.groupBy("item_id").agg(F.min(F.col("plain").cast("int")).alias("plain")).where("plain = 1").select("item_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items found in them."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
