"""N-gram Jaccard self-join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Sizes fall in
bands so wide that two linked sets lie in one band or in neighbouring ones; a
set takes part in the instance of its own band and in that of the band below.
In an instance linked sets differ in at most ``k`` shingles. The hash domain is
cut into ``partitions`` parts, each of them into ``pieces``, and for every part
all subsets of ``pieces - missing`` pieces are enumerated; the shingles in one
such subset give a signature. As at least ``slack + 1`` parts of linked sets
differ in at most ``missing`` shingles, each of these has a subset in which the
sets agree. The shape is the one with the fewest signatures whose subsets hold
enough shingles on average; where ``k`` is large next to the size, that is one
piece a signature, as no shape has fewer than k + 1 signatures.

Subsets without shingles give no signature, as they would be shared by
strangers. A part that may have such a subset is thin, and linked sets share at
least ``slack + 1 - thin`` signatures, which is a set's ``need``. A set whose
thin parts use up the slack takes part in the next level too, which cuts by
another hash: of two linked sets either one has enough on a level, or both go
on. Those left after the last level share one signature of the instance.

Signatures that one set alone has are dropped, and so are sets with fewer
shared signatures than their need. The others form groups. In each
of a few rounds a group has one hub, a member of its largest component, and the
members of other components are verified against it, by 512-bit parity sketches
first, which bound the difference of two sets from below, and by the exact sets
then; links merge components, the hub, now compared with all it could link to,
leaves its group, and sets that are left in fewer open groups than their need
leave them. A group that still has several components then compares all
members outside its largest one with all its members, in tiles of bounded size
and by sketches; only pairs that the bound allows leave a tile and are
verified. So no link between components is lost, and no group is expanded into
its pairs.

Edge cases: null or blank texts have no words, an empty set, n_shingles 0 and
their own component; shorter texts than a shingle are one shingle; equal sets
link with similarity 1; repeated rows of a doc_id give repeated rows; a null
doc_id keeps its row, with the component of its class, or a null one where the
class has no other doc_id; columns other than doc_id and text
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, few_rows, free_name, hash_bitmap, in_bitmap, keep_columns, materialize, row_hash
from .text import LocalRepeats, mix, released, slices, window_hashes, Words

#: Shapes of an instance, (missing, pieces), by number of signatures; mean shingles that a signature should hold.
SHAPES, LEAST_SHINGLES = ((0, 1), (1, 3), (2, 5), (3, 6)), 2.5
#: Hash levels before the sets left share one signature.
LEVELS = 4
#: Rounds with one hub a group, before what is left is compared in tiles; sets of a tile's side; members a task compares at once.
HUB_ROUNDS, TILE, BATCH = 3, 1024, 50_000
SKETCH_WORDS = 8
#: Sets that a task remembers, so that equal sets speak once.
SEEN_SETS = 1_000_000


@dataclass(frozen=True)
class Shape:
    """Parts of an instance, pieces of a part, pieces that a signature leaves out, and spare parts."""

    partitions: int
    pieces: int
    missing: int
    slack: int


def instance_shape(differ: int, smallest: int) -> Shape:
    """The shape with the fewest signatures that hold ``LEAST_SHINGLES`` of a set of the smallest size."""
    found = []
    for missing, pieces in SHAPES:
        if missing <= differ:
            base = differ // (missing + 1) + 1
            slack = (base + 3) // 8
            found.append((smallest / (base + slack) * (pieces - missing) / pieces, Shape(base + slack, pieces, missing, slack)))
    return next((shape for mean, shape in found if mean >= LEAST_SHINGLES), max(found, key=lambda x: x[0])[1])


class Instances:
    """Bands of set sizes up to a largest size, and the shape of each band's instance."""

    def __init__(self, percent: int, most: int):
        upper = [0]
        while upper[-1] < most:
            upper.append((upper[-1] + 1) * 100 // percent)
        self.upper = np.asarray(upper, dtype=np.int64)
        #: linked sets, the smaller one in the band, differ in at most so many elements
        self.differ = self.upper * (100 - percent) // percent
        shapes = [instance_shape(int(k), int(low) + 1) for k, low in zip(self.differ, np.append(0, self.upper[:-1]))]
        self.partitions, self.pieces, self.missing, self.slack = (np.array([getattr(s, f) for s in shapes]) for f in ("partitions", "pieces", "missing", "slack"))


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents of a slice, and n+1 offsets."""
    count = np.diff(words.bounds)
    windows = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    ends = np.cumsum(windows)
    at = np.repeat(words.bounds[:-1] - (ends - windows), windows) + np.arange(ends[-1] if len(ends) else 0)
    value = window_hashes(words.hash, at, np.repeat(np.minimum(count, width), windows))
    parts = [np.unique(value[a:b]) for a, b in zip((ends - windows).tolist(), ends.tolist())]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return (np.concatenate(parts) if parts else value), np.append(0, np.cumsum(sizes))


def _set_ids(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set."""
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(mix(values ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64))
        return mix((total[off[1:]] - total[off[:-1]]) ^ np.diff(off).astype(np.uint64))


def _enumerated(values: np.ndarray, off: np.ndarray, sets: np.ndarray, instance: np.ndarray, shapes: Instances, level: int):
    """Signatures of some sets, whose instances have one shape, on one level: (set number, signature), and each set's need."""
    size = off[sets + 1] - off[sets]
    owner = np.repeat(np.arange(len(sets)), size)
    element = np.repeat(off[sets] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    hashed = mix(values[element] + np.uint64((level + 1) * 0x9FB21C651E98DF25 % (1 << 64)))
    pieces, missing = int(shapes.pieces[instance[0]]), int(shapes.missing[instance[0]])
    parts = shapes.partitions[instance]
    base = np.cumsum(parts) - parts
    total = int(parts.sum())
    slot = base[owner] * pieces + (hashed % (parts[owner] * pieces).astype(np.uint64)).astype(np.int64)
    filled = np.bincount(slot, minlength=total * pieces).reshape(total, pieces)
    # sums of 32-bit halves stay exact in doubles
    low, high = (np.bincount(slot, half.astype(np.float64), total * pieces).astype(np.uint64).reshape(total, pieces) for half in (hashed & np.uint64(0xFFFFFFFF), hashed >> np.uint64(32)))
    who = np.repeat(np.arange(len(sets)), parts)
    with np.errstate(over="ignore"):
        tag = mix((instance[who].astype(np.uint64) << np.uint64(44)) + (np.uint64(level) << np.uint64(40)) + (np.arange(total) - base[who]).astype(np.uint64))
        numbers, found = [], []
        for subset, kept in enumerate(combinations(range(pieces), pieces - missing)):
            held, a, b = (x[:, kept].sum(axis=1, dtype=x.dtype) for x in (filled, low, high))
            some = held > 0
            value = mix(mix(a[some]) + b[some] * np.uint64(0x9E3779B97F4A7C15) + held[some].astype(np.uint64)) ^ (tag[some] + np.uint64(subset))
            numbers.append(sets[who[some]])
            found.append(mix(value))
    thin = np.bincount(who[(filled > 0).sum(axis=1) <= missing], minlength=len(sets))
    return np.concatenate(numbers), np.concatenate(found), shapes.slack[instance] + 1 - thin


def signatures(values: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PartEnum signatures of the sets of a slice: (set number, signature, need and scheme).

    A scheme is an instance's level; linked sets share a scheme of which they
    have at least as many common signatures as either one's need.
    """
    size = np.diff(off)
    shapes = Instances(percent, int(size.max(initial=1)))
    band = np.searchsorted(shapes.upper, size)
    sets, found, needs = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for step in (0, 1):
        instance = band - step
        # sets that may not differ at all are equal, and told by their ids
        here = np.flatnonzero((instance > 0) & (shapes.differ[np.maximum(instance, 0)] > 0))
        for level in range(LEVELS):
            further = []
            for missing, pieces in SHAPES:
                some = here[(shapes.missing[instance[here]] == missing) & (shapes.pieces[instance[here]] == pieces)]
                if not len(some):
                    continue
                who, value, need = _enumerated(values, off, some, instance[some], shapes, level)
                every = np.zeros(len(size), dtype=np.int64)
                every[some] = np.maximum(need, 1)
                sets.append(who)
                found.append(value)
                needs.append((every[who] << 16) + instance[who] * 8 + level)
                further.append(some[need <= 0])
            here = np.concatenate(further) if further else here[:0]
        sets.append(here)
        found.append(mix((instance[here].astype(np.uint64) << np.uint64(44)) + np.uint64(LEVELS << 40)))
        needs.append((1 << 16) + instance[here] * 8 + LEVELS)
    return np.concatenate(sets), np.concatenate(found), np.concatenate(needs)


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sketches(values: np.ndarray, off: np.ndarray) -> list[bytes]:
    """512 parity bits a set: two sets differ in at least as many elements as sketches do in bits."""
    bits = SKETCH_WORDS * 64
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    odd = np.bincount(owner * bits + (mix(values) >> np.uint64(55)).astype(np.int64), minlength=(len(off) - 1) * bits) & 1
    return [x.tobytes() for x in np.packbits(odd.astype(np.uint8)).reshape(len(off) - 1, bits // 8)]


def document_sets(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, n_shingles, set_id, sketch) of every row of texts(doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                values, at = shingle_sets(Words(data, off, lower=True), width)
                columns = [part.column("doc_id"), part.column("row"), pa.array(np.diff(at)), _as_long(_set_ids(values, at)), pa.array(_sketches(values, at), pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "row", "n_shingles", "set_id", "sketch"])

    return texts.mapInArrow(released(run), "doc_id bigint, row bigint, n_shingles bigint, set_id bigint, sketch binary")


class _Seen:
    """Sets that a task has met; a forgotten one only speaks once more."""

    def __init__(self):
        self.ids = np.empty(0, dtype=np.uint64)

    def fresh(self, ids: np.ndarray) -> np.ndarray:
        """Which of the ids are the first of their kind."""
        unique, first = np.unique(ids, return_index=True)
        new = ~np.isin(unique, self.ids, assume_unique=True)
        self.ids = np.union1d(self.ids, unique[new]) if len(self.ids) < SEEN_SETS else unique[new]
        keep = np.zeros(len(ids), dtype=bool)
        keep[first[new]] = True
        return keep


def signature_rows(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(signature, set_id, scheme, salt): rows with salt 0 stand for their task.

    A task sends the first set of a signature with salt 0. Further sets that
    have it are salted, so that a hot signature spreads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, seen = LocalRepeats(), _Seen()
        for batch in batches:
            for _, data, off in slices(batch, "text"):
                values, at = shingle_sets(Words(data, off, lower=True), width)
                ids = _set_ids(values, at)
                keep = np.flatnonzero(seen.fresh(ids))
                size = np.diff(at)[keep]
                ends = np.cumsum(size)
                values = values[np.repeat(at[keep] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
                who, signature, scheme = signatures(values, np.append(0, ends), percent)
                owner = ids[keep][who]
                stands, repeated = repeats.mark(signature)
                # the first of several in the slice is salted as well, so that any salt tells that a task has two
                salt = np.where(repeated, 1 + (owner & np.uint64(0x3FF)).astype(np.int64), 0)
                first = stands & repeated
                columns = [np.concatenate([x, x[first]]) for x in (signature.view(np.int64), owner.view(np.int64), scheme)]
                yield pa.record_batch([*map(pa.array, columns), pa.array(np.concatenate([salt, np.zeros(first.sum(), np.int64)]).astype(np.int16))], ["signature", "set_id", "scheme", "salt"])

    return texts.select("text").mapInArrow(released(run), "signature bigint, set_id bigint, scheme bigint, salt smallint")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(signature, set_id, scheme, need) of signatures that several sets have, for sets with as many of them as they need."""
    w = Window.partitionBy("signature", "salt")
    several = rows.withColumn("low", F.min("set_id").over(w)).withColumn("high", F.max("set_id").over(w)).where("low <> high or salt > 0")
    once = several.select("signature", "set_id", "scheme").distinct()
    # a set has no more signatures than shingles
    own = once.groupBy("set_id", "scheme").agg(F.collect_list("signature").alias("own")).withColumn("need", F.shiftright("scheme", 16)).where(F.size("own") >= F.col("need"))
    return own.select(F.explode("own").alias("signature"), "set_id", "scheme", "need")


def _tile_pairs(percent: int):
    """Pairs of a group's stragglers and members that sizes and sketches allow to be links."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, t in rows.groupby("tile", sort=False):
            left = t["straggler"].to_numpy()
            if left.all() or not left.any():
                continue
            ids, component, n = t["set_id"].to_numpy(), t["component"].to_numpy(), t["n"].to_numpy()
            sketch = np.frombuffer(b"".join(t["sketch"]), dtype=np.uint64).reshape(len(t), SKETCH_WORDS)
            x, y = np.flatnonzero(left), np.flatnonzero(~left)
            for i in x:
                apart = np.bitwise_count(sketch[y] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                fine = (apart * (100 + percent) <= (n[y] + n[i]) * (100 - percent)) & (component[y] != component[i]) & (np.minimum(n[y], n[i]) * 100 >= np.maximum(n[y], n[i]) * percent)
                hit = ids[y[fine]]
                out_a.append(np.minimum(hit, ids[i]))
                out_b.append(np.maximum(hit, ids[i]))
        if not out_a:
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)}).drop_duplicates()

    return compare


class Sets:
    """The distinct sets of a table of documents, and their shingles as far as pairs need them."""

    def __init__(self, texts: DataFrame, base: DataFrame, width: int, percent: int):
        self.texts, self.width, self.percent = texts, width, percent
        one = F.min_by(F.struct(F.col("n_shingles").alias("n"), "sketch", "row"), "row").alias("one")
        self.sets = materialize(base.where("n_shingles > 0").groupBy("set_id").agg(one).select("set_id", "one.*"), "sets")
        self.repeated_rows = not base.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def shingles(self, wanted: DataFrame) -> DataFrame:
        """(set_id, shingles) of the sets in wanted(set_id), from one row of each; materialized."""
        rows = materialize(self.sets.join(wanted, "set_id", "left_semi").select("row"), "rows")
        shared, width = rows.sparkSession.sparkContext.broadcast(hash_bitmap(rows, "row")), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_bitmap(shared.value, batch.column("row").to_numpy(zero_copy_only=False).view(np.uint64))
                for part, data, off in slices(batch.filter(pa.array(hit)), "text"):
                    values, at = shingle_sets(Words(data, off, lower=True), width)
                    yield pa.record_batch([part.column("row"), _as_long(_set_ids(values, at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _as_long(values))], ["row", "set_id", "shingles"])

        # the bitmap leaves few strangers to the join
        found = self.texts.select("row", "text").mapInArrow(released(run), "row bigint, set_id bigint, shingles array<bigint>").join(few_rows(rows), "row", "left_semi")
        out = materialize(found.dropDuplicates(["row"]) if self.repeated_rows else found, "shingles")
        discard(rows)
        return out

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links, materialized: sketches first, then the exact sets of those that remain."""
        percent = self.percent
        brief = self.sets.select("set_id", "n", "sketch")
        both = pairs.join(brief.toDF("a", "na", "ka"), "a").join(brief.toDF("b", "nb", "kb"), "b")
        both = both.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))

        def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in parts:
                if t.num_rows:
                    ka, kb = (np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_WORDS) for c in ("ka", "kb"))
                    na, nb = (np.asarray(t.column(c)) for c in ("na", "nb"))
                    apart = np.bitwise_count(ka ^ kb).sum(axis=1, dtype=np.int64)
                    fine = apart * (100 + percent) <= (na + nb) * (100 - percent)
                    yield t.select(["a", "b", "na", "nb"]).filter(pa.array(fine))

        left = materialize(both.mapInArrow(released(near), "a bigint, b bigint, na bigint, nb bigint"), "near")
        shingles = self.shingles(left.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())

        # row by row in the JVM: a batch of pairs of long documents would not fit in a Python worker
        content = shingles.select("set_id", "shingles")
        joined = left.join(content.toDF("a", "sa"), "a").join(content.toDF("b", "sb"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        out = materialize(joined.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b").distinct(), "links")
        discard(left, shingles)
        return out


def linked_sets(members: DataFrame, sets: Sets) -> DataFrame:
    """(set_id, component) of sets that link with another one; materialized.

    members: (signature, set_id, scheme, need), materialized.
    """
    found = None

    def merge(new: DataFrame) -> None:
        nonlocal found
        if found is None or not new.isEmpty():
            # classes so far are stars already; new links only join them
            edges = new if found is None else new.union(found.where("set_id <> component").select("set_id", "component"))
            before, found = found, connected_components(edges, "set_id")
            if before is not None:
                discard(before)
        discard(new)

    def still_open(rows: DataFrame) -> DataFrame:
        """Groups of several components, without sets that are in fewer of them than their links would be."""
        labelled = rows.select("signature", "set_id", "scheme", "need").join(found, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        labelled = materialize(labelled, "labelled")
        spread = labelled.groupBy("signature").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("signature")
        inside = materialize(labelled.join(spread, "signature", "left_semi"), "inside")
        enough = inside.groupBy("set_id", "scheme").agg(F.count("*").alias("n"), F.max("need").alias("least")).where("n >= least").select("set_id", "scheme")
        out = materialize(inside.join(enough, ["set_id", "scheme"], "left_semi"), "open")
        discard(labelled, inside)
        return out

    here = members.withColumn("component", F.col("set_id"))
    for turn in range(HUB_ROUNDS):
        # one hub of the group's largest component; a common order, so that groups share hubs and pairs
        parts = here.groupBy("signature", "component").agg(F.count("*").alias("n"), F.min_by("set_id", F.xxhash64("set_id", F.lit(turn))).alias("hub"))
        order = F.struct("n", F.xxhash64("hub", F.lit(turn)))
        chosen = materialize(parts.groupBy("signature").agg(F.max_by(F.struct("hub", "component"), order).alias("hub")), "hubs")
        pairs = here.join(chosen, "signature").where("component <> hub.component").select(F.least("set_id", "hub.hub").alias("a"), F.greatest("set_id", "hub.hub").alias("b")).distinct()
        merge(sets.linked(pairs))
        # a hub has met all members outside its component: its group needs it no more
        after = still_open(here.join(chosen, "signature").where("set_id <> hub.hub"))
        discard(chosen, *[here] * (turn > 0))
        here = after
        if here.isEmpty():
            discard(here)
            return found
    # all other pairs between components: those outside a group's largest component against all its members
    parts = here.groupBy("signature", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("signature").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"))
    marked = here.join(largest, "signature").join(sets.sets.select("set_id", "n", "sketch"), "set_id")
    marked = marked.withColumn("rows", F.ceil(F.col("size") / TILE).cast("int")).withColumn("columns", F.ceil((F.col("size") - F.col("most")) / TILE).cast("int"))
    # a member meets every block of stragglers, a straggler every block of members; it is a member as well
    block = F.pmod(F.xxhash64("set_id"), F.col("rows")).cast("int")
    group = F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("columns")).cast("int")
    as_member = marked.withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).withColumn("line", block).withColumn("straggler", F.lit(False))
    as_straggler = marked.where("component <> main").withColumn("line", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("column", group).withColumn("straggler", F.lit(True))
    tiled = as_member.unionByName(as_straggler).withColumn("tile", F.xxhash64("signature", "line", "column"))
    # groups of one tile share a task's call
    calls = max(64, here.count() // BATCH)
    key = F.when(F.col("rows") * F.col("columns") == 1, F.pmod(F.xxhash64("signature"), F.lit(calls))).otherwise(F.col("tile"))
    rest = tiled.select(key.alias("key"), "tile", "set_id", "component", "n", "sketch", "straggler").groupBy("key").applyInPandas(_tile_pairs(sets.percent), "a bigint, b bigint").distinct()
    pairs = materialize(rest, "pairs")
    merge(sets.linked(pairs))
    discard(pairs, here)
    return found


def classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, set_id, class) of every row; the class of an empty set is null. Materialized.

    row is ``row_hash``; rows of one class are connected by links.
    """
    texts = keep_columns(docs, "doc_id", "text").withColumn("row", row_hash())
    base = materialize(document_sets(texts, width), "base")
    members = materialize(shared_signatures(signature_rows(texts, width, percent)), "members")
    sets = Sets(texts, base, width, percent)
    found = linked_sets(members, sets)
    joined = base.drop("sketch").join(found, "set_id", "left").withColumn("class", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set_id")))
    out = materialize(joined.select("doc_id", "row", "n_shingles", "set_id", "class"), "classes")
    discard(members, sets.sets, base, found)
    return out


def ngram_jaccard(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) for every document.

    Documents link if their shingle sets have a Jaccard similarity of at least
    ``percent`` / 100; component_id is the smallest doc_id reachable by links.
    """
    labelled = classes(docs, width, percent)
    least = labelled.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "class", "left").select("doc_id", "n_shingles", "set_id", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents that are the first of their group, all columns kept.

    The first has the least doc_id, null ones come last; of repeated rows one
    stays. Documents without words belong to no group and stay.
    """
    grouped = classes(docs, width, percent).where("class is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = grouped.groupBy("class").agg(F.min(order).alias("first"))
    extra = materialize(grouped.join(first, "class").where(F.col("row") != F.col("first.row")).select("row"), "extra")
    again = materialize(grouped.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "again")
    key = free_name(docs, "row_key")
    left = docs.withColumn(key, row_hash()).join(extra.withColumnRenamed("row", key), key, "left_anti")
    if not again.isEmpty():
        again = again.withColumnRenamed("row", key)
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
    return left.drop(key)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a similarity of 0.9."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_jaccard(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id")
