"""Near-duplicate embeddings by NN-descent.

Vectors compare within one label (and one length). Equal vectors are one node.
The neighbour graph starts from random-hyperplane sort orders: vectors sorted by
their sign codes are near their neighbours, and each takes the nearest of a few
that follow it. NN-descent then joins neighbours of neighbours (both directions),
pairs with an edge that is new since the last round only, and keeps each node's
nearest, until less than ``CONVERGED`` of the edges are new; a list that is full
of links is saturated and may hold twice as many. Lists only steer the search:
every edge found at or above the threshold is kept for the components, whatever
its rank, and two links of one node are not compared, as it joins them already.

What saturated lists can't hold is completed exactly. A component with a
saturated node is compared, in tiles of bounded size, with every vector of its
label outside it that the triangle inequality lets link with it. The direct
links inside a component are counted without listing pairs: members within half
the threshold's angle of the component's centre all link with each other, and
the others are multiplied with all members in tiles. A hash sample of each label's vectors,
which grows with the root of the label's size, is compared with all its vectors; each query counts
once, however many links it has. A label in which any query lacks a link is
searched again with more sort orders, and after ``ATTEMPTS`` searches all its
pairs are compared in tiles. The column ``recall`` is the part of all queries
that had all their links at the last audit, labels compared whole counting as 1.

Edge cases: a vector that is null, empty, all zero or holds null or non-finite
components, or whose label is null, has no links and is its own component;
repeated rows of a vec_id count as one vector; a null vec_id keeps its row and
links with nothing; columns other than vec_id, embedding and label are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, keep_columns, materialize

THRESHOLD = 0.98
NEIGHBOURS = 8
ORDERS = 10
AHEAD = 4
#: Share of new edges at which the descent has converged, and most rounds before the audit decides.
CONVERGED, MOST_ROUNDS = 0.01, 8
TILE = 512
#: Vectors of small groups that share a task's call.
BATCH = 20_000
#: Queries of the audit: of the whole table, of a label at least, and times the root of a label's size.
QUERIES, CELL_QUERIES, ROOT_QUERIES = 1000, 64, 2
ATTEMPTS = 3


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column that have one length, and their unit vectors in double precision."""
    offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
    size = np.diff(offsets)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        x = flat[offsets[rows][:, None] + np.arange(length)].astype(np.float64)
        yield rows, x / np.linalg.norm(x, axis=1)[:, None]


def _usable() -> F.Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size("embedding") > 0) & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))


def _sorted_edges(nodes: DataFrame, orders: int, seed: int) -> DataFrame:
    """(a, b, sim): near vectors in random-hyperplane sort orders, both directions."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _by_length(batch.column("embedding")):
                part = batch.take(pa.array(rows))
                for order in range(seed, seed + orders):
                    planes = np.random.default_rng([order, x.shape[1]]).standard_normal((x.shape[1], 30))
                    code = ((x @ planes > 0) @ (1 << np.arange(30))[::-1]).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(rows), order, np.int32)), part.column("cell"), pa.array(code), part.column("node"), part.column("embedding")], ["order", "cell", "code", "node", "embedding"])

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            fresh = 0 if tail is None else tail.num_rows
            part = batch if tail is None else pa.concat_batches([tail, batch])
            tail = part.slice(max(0, part.num_rows - AHEAD))
            order, cell, node = (np.asarray(part.column(c)) for c in ("order", "cell", "node"))
            for rows, x in _by_length(part.column("embedding")):
                found = []
                for step in range(1, AHEAD + 1):
                    i = np.arange(len(rows) - step)
                    one, two = rows[i], rows[i + step]
                    i = i[(two >= fresh) & (order[one] == order[two]) & (cell[one] == cell[two])]
                    found.append(pd.DataFrame({"a": node[rows[i]], "b": node[rows[i + step]], "sim": np.einsum("ij,ij->i", x[i], x[i + step])}))
                edges = pd.concat(found)
                both = pd.concat([edges, edges.rename(columns={"a": "b", "b": "a"})])
                best = both["sim"] >= both.groupby("a")["sim"].transform("max")
                yield pa.RecordBatch.from_pandas(both[best | (both["sim"] >= 0.7)][["a", "b", "sim"]], preserve_index=False)

    rows = nodes.select("cell", "node", "embedding").mapInArrow(coded, "order int, cell bigint, code bigint, node bigint, embedding array<float>")
    # range bounds are sampled: the rows are written first, so that they are not made twice
    rows = materialize(rows, "codes")
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = rows.repartitionByRange(int(parts), "order", "cell", "code", "node").sortWithinPartitions("order", "cell", "code", "node")
    out = materialize(spread.mapInArrow(ahead, "a bigint, b bigint, sim double").where("a <> b"), "edges")
    discard(rows)
    return out


def _nearest(edges: DataFrame, saturated_at: float) -> DataFrame:
    """The nearest ``NEIGHBOURS`` of each node, twice as many where all of them are links.

    edges: (a, b, sim, known); the result's ``fresh`` tells edges that were not known.
    """
    one = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), (~F.max("known")).alias("fresh"))
    ranked = one.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("place") <= 2 * NEIGHBOURS)
    full = F.max((F.col("place") == NEIGHBOURS) & (F.col("sim") >= saturated_at)).over(Window.partitionBy("a"))
    return ranked.withColumn("full", full).where((F.col("place") <= NEIGHBOURS) | F.col("full")).select("a", "b", "sim", "fresh")


def _similar(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, sim) of pairs, the cosine in double precision."""

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (rows, x), (_, y) in zip(_by_length(batch.column("x")), _by_length(batch.column("y"))):
                yield pa.record_batch([batch.column("a").take(pa.array(rows)), batch.column("b").take(pa.array(rows)), pa.array(np.einsum("ij,ij->i", x, y))], ["a", "b", "sim"])

    # vectors of one cell have one length
    left = pairs.join(nodes.select(F.col("node").alias("a"), "cell", F.col("embedding").alias("x")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("cell").alias("other"), F.col("embedding").alias("y")), "b").where("cell = other")
    return both.select("a", "b", "x", "y").mapInArrow(cosine, "a bigint, b bigint, sim double")


def _links(edges: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each edge at or above the threshold once."""
    return edges.where(F.col("sim") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def descend(graph: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One round: pairs of neighbours of a node, both directions, then the nearest again; and all links met.

    Both results are materialized. A node has at most 3 * ``NEIGHBOURS`` neighbours.
    """
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "fresh")
    back = back.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))).where(F.col("place") <= NEIGHBOURS).drop("place")
    around = graph.union(back).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
    other = around.select("a", F.col("b").alias("c"), F.col("sim").alias("sim_c"), F.col("fresh").alias("fresh_c"))
    # two links of a node are joined by it, and counted with their component
    useful = (F.col("fresh") | F.col("fresh_c")) & (F.least("sim", "sim_c") < threshold)
    pairs = around.join(other, "a").where("b < c").where(useful).select(F.col("b").alias("a"), F.col("c").alias("b")).distinct()
    known = graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    new = materialize(_similar(pairs.join(known, ["a", "b"], "left_anti"), nodes).where("sim >= 0.7"), "similar")
    # both directions of a pair from one row, so that no cosine is computed twice
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = new.select(ends.alias("pair"), "sim").select("pair.a", "pair.b", "sim", F.lit(False).alias("known"))
    nearest = materialize(_nearest(graph.select("a", "b", "sim", F.lit(True).alias("known")).union(both), threshold), "graph")
    links = materialize(_links(new, threshold), "met")
    discard(new)
    return nearest, links


def _tiles(left: DataFrame, right: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """compare(x, y, cosines) of each block of left and each block of right that share a part.

    left and right: (part, node, embedding) and the same further columns.
    """

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, tile in group.groupby("tile"):
            x, y = tile[tile["first"]], tile[~tile["first"]]
            # a block may be empty by hash
            if len(x) and len(y):
                out.append(compare(x, y, _unit(x["embedding"]) @ _unit(y["embedding"]).T))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    blocks = lambda rows, name: rows.groupBy("part").agg(F.ceil(F.count("*") / TILE).alias(name))
    sizes = materialize(blocks(left, "lows").join(blocks(right, "highs"), "part"), "sizes")
    hashed = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    first = left.join(sizes, "part").withColumn("low", hashed("lows")).withColumn("high", every("highs")).withColumn("first", F.lit(True))
    second = right.join(sizes, "part").withColumn("high", hashed("highs")).withColumn("low", every("lows")).withColumn("first", F.lit(False))
    tiles = first.unionByName(second).withColumn("tile", F.xxhash64("part", "low", "high"))
    # parts of one tile share a task's call
    calls = max(64, sizes.where("lows * highs = 1").count() * TILE // BATCH)
    key = F.when(F.col("lows") * F.col("highs") == 1, F.pmod(F.xxhash64("part"), F.lit(calls))).otherwise(F.col("tile"))
    return tiles.withColumn("key", key).drop("part", "lows", "highs", "low", "high").groupBy("key").applyInPandas(multiply, schema)


def _stars(threshold: float):
    """Stars that join the same nodes of a tile as all its links."""

    def join(x: pd.DataFrame, y: pd.DataFrame, cosines: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(cosines >= threshold)
        names, at = np.unique(np.concatenate([x["node"].to_numpy()[i], y["node"].to_numpy()[j]]), return_inverse=True)
        i, j, root = at[: len(i)], at[len(i) :], np.arange(len(names))
        while True:
            least, after = np.minimum(root[i], root[j]), root.copy()
            np.minimum.at(after, root[i], least)
            np.minimum.at(after, root[j], least)
            after = after[after]
            if (after == root).all():
                break
            root = after
        edges = pd.DataFrame({"a": names[root], "b": names})
        return edges[edges["a"] != edges["b"]]

    return join


def saturated_links(graph: DataFrame, nodes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that join each component with a saturated node to all it links with outside.

    found: (node, component). A vector can only link with a component whose
    members all lie within r of its centre if it lies within r plus the
    threshold's angle of the centre; such vectors meet the members in tiles.
    """
    full = graph.where(F.col("sim") >= threshold).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") >= NEIGHBOURS)
    named = materialize(nodes.select("cell", "node", "embedding").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    hot = named.join(full, "node").select("component").distinct()
    members = materialize(named.join(materialize(hot, "hot"), "component"), "saturated")
    # the centre is the component's least node
    reach = _similar(members.select(F.col("component").alias("a"), F.col("node").alias("b")), nodes).groupBy(F.col("a").alias("node")).agg(F.min("sim").alias("sim"))
    widest = F.acos(F.least(F.col("sim"), F.lit(1.0))) + float(np.arccos(threshold)) + 1e-6
    centres = materialize(members.join(reach, "node").select(F.col("cell").alias("part"), "node", "component", "embedding", F.when(widest < np.pi, F.cos(widest)).otherwise(-2.0).alias("least")), "centres")
    others = named.select(F.col("cell").alias("part"), "node", "component", "embedding", F.lit(0.0).alias("least"))

    def near(x: pd.DataFrame, y: pd.DataFrame, cosines: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero((cosines >= x["least"].to_numpy()[:, None]) & (x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None, :]))
        return pd.DataFrame({"part": x["component"].to_numpy()[i], "node": y["node"].to_numpy()[j]})

    close = materialize(_tiles(centres, others, near, "part bigint, node bigint"), "near")
    outside = close.join(nodes.select("node", "embedding"), "node").select("part", "node", "embedding")
    return _tiles(members.select(F.col("component").alias("part"), "node", "embedding"), outside, _stars(threshold), "a bigint, b bigint").distinct()


def component_links(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, links): direct links of each node inside its component, each copy of a node counted.

    members: (component, node, copies, embedding), materialized. Nodes within
    half the threshold's angle of their component's least node, the core, link
    with each other by the triangle inequality; the others are compared with all.
    """
    reach = _similar(members.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")), nodes).select(F.col("b").alias("node"), "sim")
    half = float(np.cos(np.arccos(threshold) / 2 - 1e-7))
    marked = materialize(members.join(reach, "node", "left").withColumn("core", F.coalesce(F.col("sim") >= half, F.lit(True))).drop("sim"), "marked")
    core = marked.where("core").groupBy("component").agg(F.sum("copies").alias("together"))
    inside = marked.where("core").join(core, "component").select("node", (F.col("together") - F.col("copies")).alias("links"))

    def count(x: pd.DataFrame, y: pd.DataFrame, cosines: np.ndarray) -> pd.DataFrame:
        linked = (cosines >= threshold) & (x["node"].to_numpy()[:, None] != y["node"].to_numpy()[None, :])
        own = pd.DataFrame({"node": x["node"], "links": linked @ y["copies"].to_numpy()})
        # what lies in the core learns of its links with the others here, as the others are compared with all
        core = y["core"].to_numpy()
        return pd.concat([own, pd.DataFrame({"node": y["node"][core], "links": x["copies"].to_numpy() @ linked[:, core]})])

    rows = marked.select(F.col("component").alias("part"), "node", "copies", "core", "embedding")
    across = _tiles(rows.where("not core"), rows, count, "node bigint, links bigint")
    return inside.union(across).groupBy("node").agg(F.sum("links").alias("links"))


def _audit(nodes: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(cell, queries, complete): query nodes of each cell, and how many have all their true links."""
    sizes = materialize(nodes.groupBy("cell").agg(F.count("*").alias("n")), "cells")
    rate = F.greatest(F.greatest(F.lit(CELL_QUERIES), ROOT_QUERIES * F.sqrt("n")) / F.col("n"), F.lit(QUERIES / max(1, nodes.count())))
    drawn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) < rate * (1 << 30)
    chosen = materialize(nodes.join(sizes, "cell").where(drawn).select(F.col("cell").alias("part"), "node", "copies", "embedding"), "queries")

    def count(x: pd.DataFrame, y: pd.DataFrame, cosines: np.ndarray) -> pd.DataFrame:
        hit = (cosines >= threshold) & (x["node"].to_numpy()[:, None] != y["node"].to_numpy()[None, :])
        return pd.DataFrame({"node": x["node"], "true": hit @ y["copies"].to_numpy()})

    true = _tiles(chosen, nodes.select(F.col("cell").alias("part"), "node", "copies", "embedding"), count, "node bigint, true bigint").groupBy("node").agg(F.sum("true").alias("true"))
    both = chosen.select(F.col("part").alias("cell"), "node").join(true, "node", "left").join(links, "node", "left")
    whole = F.coalesce("links", F.lit(0)) >= F.coalesce("true", F.lit(0))
    return both.groupBy("cell").agg(F.count("*").alias("queries"), F.sum(whole.cast("bigint")).alias("complete"))


def all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that join what links in each cell, all pairs compared in tiles."""
    rows = nodes.select(F.col("cell").alias("part"), "node", "embedding")
    return _tiles(rows, rows, _stars(threshold), "a bigint, b bigint").distinct()


def _search(nodes: DataFrame, threshold: float, attempt: int) -> DataFrame:
    """(a, b): edges that join the links found by one search; materialized."""
    edges = _sorted_edges(nodes, ORDERS, seed=1 + attempt * ORDERS)
    graph, linked = materialize(_nearest(edges.withColumn("known", F.lit(False)), threshold), "graph"), [materialize(_links(edges, threshold), "met")]
    discard(edges)
    for _ in range(MOST_ROUNDS):
        before = graph
        graph, met = descend(graph, nodes, threshold)
        linked.append(met)
        discard(before)
        state = graph.agg(F.count("*").alias("edges"), F.sum(F.col("fresh").cast("bigint")).alias("new")).first()
        if (state.new or 0) <= CONVERGED * state.edges:
            break
    # the threshold decides on cosines in double precision, whatever the search used
    every = linked[0]
    for met in linked[1:]:
        every = every.union(met)
    found = connected_components(every)
    across = saturated_links(graph, nodes, found, threshold)
    out = materialize(found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(across), "joined")
    discard(graph, found, *linked)
    return out


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for every vector; recall is the audit's."""
    rows = materialize(keep_columns(vectors, "vec_id", "embedding", "label").withColumn("usable", _usable()), "vectors")
    key = ["label", "embedding"]
    nodes = rows.where("usable").groupBy(*key).agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"))
    nodes = materialize(nodes.withColumn("cell", F.xxhash64("label", F.size("embedding"))), "nodes")
    spark = nodes.sparkSession
    linked, open_nodes, audits = spark.createDataFrame([], "a bigint, b bigint"), nodes, {}
    for attempt in range(ATTEMPTS + 1):
        linked = linked.union(_search(open_nodes, threshold, attempt) if attempt < ATTEMPTS else materialize(all_links(open_nodes, threshold), "pairs"))
        found = connected_components(linked)
        members = materialize(nodes.join(found, "node"), "members")
        links = materialize(component_links(members, nodes, threshold), "links")
        discard(members)
        if attempt == ATTEMPTS:
            audits |= {c: (q, q) for c, (q, complete) in audits.items() if complete < q}
            break
        audits |= {r.cell: (r.queries, r.complete) for r in _audit(open_nodes, links, threshold).collect()}
        missed = [c for c, (queries, complete) in audits.items() if complete < queries]
        if not missed:
            break
        open_nodes = materialize(open_nodes.join(F.broadcast(spark.createDataFrame([(c,) for c in missed], "cell bigint")), "cell", "left_semi"), "open")
    asked = sum(q for q, _ in audits.values())
    recall = sum(c for _, c in audits.values()) / asked if asked else 1.0
    named = nodes.select(*key, "node", "copies").join(found, "node", "left").join(links, "node", "left")
    joined = rows.where("usable").join(named, key).select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("recall"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.98."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
