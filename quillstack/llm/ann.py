"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node of the graph. A few random projection trees deal the nodes into blocks, and the best ``degree`` of
its block start a node's list. Then each round meets neighbours of neighbours: every node brings together at most ``sample`` new
and as many old entries of its list and of the nodes that list it, compares the pairs of which one is new, and what improves a
list is merged into it; it ends when few entries are new. A query starts from its own node's list and expands the best
candidates of its beam that it has not expanded, ``hops`` times. The candidates kept are scored again in double precision on the
original vectors, equal vectors are listed again, and the best ``top`` in order of score, then vec_id, are returned.
The same steps run at every size of the table.

Scale: a node takes part in at most 4 * ``sample`` meetings a round whatever the size of the table, so its vector goes to a bounded
number of blocks of nodes, once each, and at most that many rows of improvements come back. Blocks hold a bounded number of
nodes and of bytes: those above the bound are split by hash, so crowded vectors do not make a large group. Samples of the lists
that name a node are drawn by rank before the shuffle; sampling them is part of the method, and every node keeps its own full
list. A few thousand sampled vectors fit the trees.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, those of another length than most, and
rows without vec_id take no part; of rows with equal vec_id each is a candidate for the others; with at most ``top``
candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import Scratch, ordinals

LISTS = "node long, ids array<long>, sims array<float>, fresh array<boolean>"
SAMPLE = 4096
TREE_DEPTH = 8
#: Bytes of vectors that one block of nodes may need.
BLOCK_BYTES = 256 << 20


def usable_vectors(embeddings: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, vec_id, vec): rows that take part, numbered in order of vec_id. ``vec`` keeps the values as they came."""
    element = getattr(embeddings.schema["embedding"].dataType, "elementType", None)
    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    rows = scratch.keep(rows.withColumn("dim", F.size("vec")), "usable")
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    rows = rows.where(F.col("dim") == (common[0]["dim"] if common else 0)).drop("dim")
    return scratch.keep(ordinals(rows, [F.col("vec_id"), F.xxhash64("vec")], "row"), "rows")


def search_vectors(nodes: DataFrame) -> DataFrame:
    """(node, vec): single-precision vectors to search with, all divided by one power of two so that no product leaves its range."""
    largest = nodes.select(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("m")).first()["m"]
    scale = 2.0 ** math.floor(math.log2(largest)) if largest else 1.0
    return nodes.select("node", F.transform("vec", lambda x: (x.cast("double") / F.lit(scale)).cast("float")).alias("vec"))


class Forest:
    """Random hyperplane trees with medians of a sample, then plain hyperplanes for tables that need more leaves."""

    def __init__(self, sample: np.ndarray, count: int, leaf: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        need = max(0, math.ceil(math.log2(max(count, 1) / leaf)))
        self.depth, dim = min(need, TREE_DEPTH), sample.shape[1]
        self.normals, self.cuts = np.zeros((2**self.depth, dim), np.float32), np.zeros(2**self.depth, np.float32)
        groups = {1: sample}
        for node in range(1, 2**self.depth):
            rows = groups.pop(node)
            normal = rows[rng.integers(len(rows))] - rows[rng.integers(len(rows))] if len(rows) > 1 else np.zeros(dim)
            if not np.any(normal):
                normal = rng.normal(size=dim)
            side = rows @ normal
            self.normals[node], self.cuts[node] = normal, np.median(side) if len(side) else 0
            groups[2 * node], groups[2 * node + 1] = rows[side < self.cuts[node]], rows[side >= self.cuts[node]]
        extra = rng.normal(size=(need - self.depth, dim)).astype(np.float32)
        self.extra, self.extra_cuts = extra, np.median(sample @ extra.T, axis=0) if len(extra) else np.zeros(0)

    def codes(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.normals[node]) >= self.cuts[node])
        for normal, cut in zip(self.extra, self.extra_cuts, strict=True):
            node = 2 * node + (x @ normal >= cut)
        return node


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()), np.asarray(column.value_lengths())


def _list_table(nodes: np.ndarray, owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray, names=("node", "ids", "sims", "fresh")) -> pa.Table:
    """A row for each of ``nodes`` (sorted); ``owner`` gives the place of each entry's node, in order."""
    offsets = pa.array(np.searchsorted(owner, np.arange(len(nodes) + 1)).astype(np.int32))
    columns = [pa.array(nodes), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(sims, pa.float32())), pa.ListArray.from_arrays(offsets, pa.array(fresh, pa.bool_()))]
    return pa.table(columns, names=list(names))


def _best(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray, k: int):
    """At most ``k`` entries for each owner, the best first, equal ones by id; of repeated ids the one that is not fresh."""
    order = np.lexsort((fresh, ids, owner))
    owner, ids, sims, fresh = owner[order], ids[order], sims[order], fresh[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, sims, fresh = owner[first], ids[first], sims[first], fresh[first]
    order = np.lexsort((ids, -sims, owner))
    owner, ids, sims, fresh = owner[order], ids[order], sims[order], fresh[order]
    starts = np.searchsorted(owner, owner)
    near = np.arange(len(owner)) - starts < k
    return owner[near], ids[near], sims[near], fresh[near]


def _start_lists(k: int):
    def run(block: pa.Table) -> pa.Table:
        nodes, x = np.asarray(block["node"]), _matrix(block["vec"])
        order = np.argsort(nodes)
        nodes, x = nodes[order], x[order]
        owner, ids, sims = [], [], []
        for at in range(0, len(nodes), 256):
            near = x[at : at + 256] @ x.T
            own = np.arange(at, min(at + 256, len(nodes)))
            near[own - at, own] = -np.inf
            take = min(k, len(nodes) - 1)
            if take:
                best = np.argpartition(-near, take - 1, axis=1)[:, :take]
                owner.append(np.repeat(own, take))
                ids.append(nodes[best].ravel())
                sims.append(np.take_along_axis(near, best, 1).ravel())
        owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        sims = np.concatenate(sims) if sims else np.empty(0, np.float32)
        return _list_table(nodes, owner, ids, sims, np.ones(len(ids), bool))

    return run


def _merge(k: int):
    def run(group: pa.Table) -> pa.Table:
        nodes, place = np.unique(np.asarray(group["node"]), return_inverse=True)
        ids, lengths = _lists(group["ids"])
        owner = np.repeat(place, lengths)
        best = _best(owner, ids, _lists(group["sims"])[0], _lists(group["fresh"])[0].astype(bool), k)
        return _list_table(nodes, *best)

    return run


def _merged(lists: DataFrame, k: int, count: int, group_nodes: int = 4096) -> DataFrame:
    groups = max(1, -(-count // group_nodes))
    return lists.withColumn("grp", F.pmod(F.xxhash64("node"), F.lit(groups))).groupBy("grp").applyInArrow(_merge(k), LISTS)


def _local_join(k: int):
    """Improvements for the members of the block's meetings: pairs of which one is new, better than a list's last."""

    def run(key, joins: pa.Table, vectors: pa.Table) -> pa.Table:
        nodes = np.asarray(vectors["node"])
        order = np.argsort(nodes)
        nodes, x, worst = nodes[order], _matrix(vectors["vec"])[order] if len(nodes) else np.zeros((0, 1), np.float32), np.asarray(vectors["worst"])[order]
        sides = []
        for name in ("new", "old"):
            members, lengths = _lists(joins[name])
            ends = np.cumsum(lengths)
            sides.append((np.searchsorted(nodes, members), ends - lengths, ends))
        owner, ids, sims, held = [], [], [], 0

        def squeeze() -> None:
            if owner:
                o, i, s, _ = _best(np.concatenate(owner), np.concatenate(ids), np.concatenate(sims), np.ones(sum(map(len, owner)), bool), k)
                owner[:], ids[:], sims[:] = [o], [i], [s]

        def keep(u: np.ndarray, v: np.ndarray, near: np.ndarray) -> None:
            at, to = np.nonzero((near > worst[u][:, None]) & (u[:, None] != v[None, :]))
            owner.append(u[at])
            ids.append(nodes[v[to]])
            sims.append(near[at, to])

        for n in range(joins.num_rows):
            new, old = (np.unique(places[starts[n] : ends[n]]) for places, starts, ends in sides)
            old = np.setdiff1d(old, new, assume_unique=True)
            both = np.concatenate([new, old])
            near = x[new] @ x[both].T
            keep(new, both, near)
            keep(old, new, near[:, len(new) :].T)
            held += len(owner[-1]) + len(owner[-2])
            if held > 2_000_000:
                squeeze()
                held = len(owner[0])
        squeeze()
        if not owner:
            return _list_table(nodes[:0], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, bool))
        touched, place = np.unique(owner[0], return_inverse=True)
        return _list_table(nodes[touched], place, ids[0], sims[0], np.ones(len(place), bool))

    return run


def meetings(graph: DataFrame, sample: int) -> DataFrame:
    """(node, new, old): whom a node brings together, at most ``sample`` of its list and of those that list it, new and old apart."""
    picked = lambda wanted: F.slice(F.transform(F.filter(F.arrays_zip("ids", "fresh"), lambda e: e["fresh"] == F.lit(wanted)), lambda e: e["ids"]), 1, sample)
    own = graph.select("node", picked(True).alias("new"), picked(False).alias("old"))
    marked = F.concat(F.transform("new", lambda i: F.struct(i.alias("id"), F.lit(True).alias("fresh"))), F.transform("old", lambda i: F.struct(i.alias("id"), F.lit(False).alias("fresh"))))
    edges = own.select("node", F.explode(marked).alias("e")).select(F.col("e.id").alias("id"), "node", F.col("e.fresh").alias("fresh"))
    turn = F.row_number().over(Window.partitionBy("id", "fresh").orderBy(F.xxhash64("node", "id")))
    back = edges.withColumn("turn", turn).where(F.col("turn") <= sample).groupBy(F.col("id").alias("b_node"))
    back = back.agg(F.collect_list(F.when(F.col("fresh"), F.col("node"))).alias("b_new"), F.collect_list(F.when(~F.col("fresh"), F.col("node"))).alias("b_old"))
    both = own.join(back, F.col("node") == F.col("b_node"), "left")
    none = F.array().cast("array<bigint>")
    return both.select("node", F.concat("new", F.coalesce("b_new", none)).alias("new"), F.concat("old", F.coalesce("b_old", none)).alias("old"))


def build_graph(vectors: DataFrame, scratch: Scratch, degree: int, rounds: int, sample: int, seed: int, trees: int = 4, leaf: int = 1024, block_nodes: int = 512) -> tuple[DataFrame, DataFrame]:
    """The neighbour lists of (node, vec), best first, and (node, block), the blocks of near nodes."""
    count = vectors.count()
    some = vectors.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(SAMPLE).select("vec").toArrow()
    some = _matrix(some["vec"])
    dim = some.shape[1] if len(some) else 1
    block_nodes = max(16, min(block_nodes, BLOCK_BYTES // (4 * sample * dim * 4)))
    forest = lambda size, turn: Forest(some, count, size, seed + turn) if count else None
    starts = [_dealt(vectors, forest(leaf, tree), 2 * leaf, seed + tree).groupBy("block").applyInArrow(_start_lists(degree), LISTS) for tree in range(trees)]
    graph = scratch.keep(_merged(reduce(DataFrame.unionByName, starts), degree, count), "lists")
    home = scratch.keep(_dealt(vectors, forest(block_nodes, trees), block_nodes, seed).select("node", "block"), "home")
    for _ in range(rounds):
        joins = meetings(graph, sample).join(home.withColumnRenamed("node", "h_node"), F.col("node") == F.col("h_node"))
        joins = scratch.keep(joins.where(F.size("new") > 0).select("block", "node", "new", "old"), "joins")
        worst = F.when(F.size("sims") >= degree, F.element_at("sims", -1)).otherwise(F.lit(float("-inf")).cast("float"))
        carried = vectors.join(graph.select(F.col("node").alias("g_node"), worst.alias("worst")), F.col("node") == F.col("g_node")).select("node", "vec", "worst")
        needed = joins.select(F.col("block").alias("v_block"), F.explode(F.concat("new", "old")).alias("n_node")).distinct()
        sent = needed.join(carried, F.col("n_node") == F.col("node")).select("v_block", "node", "vec", "worst")
        better = scratch.keep(joins.groupBy("block").cogroup(sent.groupBy("v_block")).applyInArrow(_local_join(degree), LISTS), "better")
        # New entries that have met are old now; those beyond the sample keep their turn.
        met = F.aggregate("fresh", F.struct(F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("out")), lambda acc, f: F.struct((acc["n"] + f.cast("int")).alias("n"), F.concat(acc["out"], F.array(f & (acc["n"] >= sample))).alias("out")))["out"]
        new = scratch.keep(_merged(graph.withColumn("fresh", met).unionByName(better), degree, count), "lists")
        scratch.drop(graph, joins, better)
        graph = new
        unmet = graph.select(F.sum(F.size(F.filter("fresh", lambda f: f))).alias("n")).first()["n"] or 0
        if unmet <= 0.002 * count * degree:
            break
    return graph, home


def _dealt(nodes: DataFrame, forest: Forest, bound: int, seed: int) -> DataFrame:
    """Adds ``block``: the forest's leaf, and a part of it by hash where a leaf has more than ``bound`` nodes."""

    def run(batches):
        for batch in batches:
            codes = forest.codes(_matrix(batch.column(1))) if batch.num_rows and forest else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], names=["node", "vec", "code"])

    coded = nodes.select("node", "vec").mapInArrow(run, "node long, vec array<float>, code long")
    sizes = coded.groupBy(F.col("code").alias("c_code")).agg(F.ceil(F.count("*") / F.lit(bound)).alias("parts"))
    return coded.join(sizes, F.col("code") == F.col("c_code")).select("node", "vec", F.xxhash64("code", F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("parts"))).alias("block"))


def _score_candidates(k: int):
    """Merges unseen candidates of each query of a block into its list. ``fresh`` marks entries that are not expanded."""

    def run(key, beams: pa.Table, vectors: pa.Table) -> pa.Table:
        nodes = np.asarray(vectors["node"])
        order = np.argsort(nodes)
        nodes, x = nodes[order], _matrix(vectors["vec"])[order] if len(nodes) else np.zeros((0, 1), np.float32)
        queries = np.asarray(beams["node"])
        q = _matrix(beams["vec"])
        old, sims, fresh, found = (beams[c].combine_chunks() for c in ("ids", "sims", "fresh", "found"))
        parts = []
        for i in range(len(queries)):
            ids = np.asarray(old[i].values)
            new = np.setdiff1d(np.asarray(found[i].values), np.append(ids, queries[i]))
            near = x[np.searchsorted(nodes, new)] @ q[i] if len(new) else np.empty(0, np.float32)
            owner = np.full(len(ids) + len(new), i)
            parts.append(_best(owner, np.concatenate([ids, new]), np.concatenate([np.asarray(sims[i].values), near]), np.concatenate([np.asarray(fresh[i].values).astype(bool), np.ones(len(new), bool)]), k))
        return _list_table(queries, *(np.concatenate(p) for p in zip(*parts, strict=True))) if parts else _list_table(queries, *(np.empty(0, t) for t in (np.int64, np.int64, np.float32, bool)))

    return run


def greedy_search(queries: DataFrame, vectors: DataFrame, graph: DataFrame, home: DataFrame, scratch: Scratch, beam: int, expand: int, fan: int, hops: int, parts: int = 1) -> DataFrame:
    """(node, ids, sims, fresh) for the query nodes: the best ``beam`` found from their own lists on.

    Each hop looks at the first ``fan`` neighbours of the ``expand`` best candidates that were not expanded. Queries near each other
    share a block, so that a vector they need travels once; a block of nodes that holds many queries is searched in ``parts``.
    """
    asked = queries.select(F.col("node").alias("q_node")).join(home, F.col("q_node") == F.col("node"))
    asked = asked.select("q_node", F.xxhash64("block", F.pmod(F.xxhash64("q_node"), F.lit(parts))).alias("block"))
    beams = graph.join(asked.select("q_node"), F.col("node") == F.col("q_node"), "left_semi")
    beams = scratch.keep(beams.withColumn("fresh", F.transform("ids", lambda i: F.lit(True))), "beams")
    for _ in range(hops):
        entries = F.slice(F.filter(F.arrays_zip("ids", "fresh"), lambda e: e["fresh"]), 1, expand)
        front = beams.select("node", F.explode(entries).alias("e")).select("node", F.col("e.ids").alias("f_id"))
        reached = front.join(graph.select(F.col("node").alias("g_node"), F.slice("ids", 1, fan).alias("next")), F.col("f_id") == F.col("g_node"))
        found = reached.groupBy(F.col("node").alias("r_node")).agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("found"))
        # The first unexpanded entries are expanded now: their marks go.
        left = F.aggregate("fresh", F.struct(F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("out")), lambda acc, f: F.struct((acc["n"] + f.cast("int")).alias("n"), F.concat(acc["out"], F.array(f & (acc["n"] >= expand))).alias("out")))["out"]
        state = beams.join(found, F.col("node") == F.col("r_node"), "left").select("node", "ids", "sims", left.alias("fresh"), F.coalesce("found", F.array().cast("array<bigint>")).alias("found"))
        state = state.join(vectors.select(F.col("node").alias("v_node"), "vec"), F.col("node") == F.col("v_node")).drop("v_node")
        state = scratch.keep(state.join(asked, F.col("node") == F.col("q_node")).drop("q_node"), "state")
        needed = state.select(F.col("block").alias("v_block"), F.explode(F.array_except("found", "ids")).alias("n_node")).distinct()
        sent = needed.join(vectors, F.col("n_node") == F.col("node")).select("v_block", "node", "vec")
        new = scratch.keep(state.groupBy("block").cogroup(sent.groupBy("v_block")).applyInArrow(_score_candidates(beam), LISTS), "beams")
        scratch.drop(beams, state)
        beams = new
    return beams


def nearest(embeddings: DataFrame, top: int = 20, every: int = 20, degree: int = 64, rounds: int = 5, sample: int = 24, beam: int = 96, expand: int = 48, fan: int = 48, hops: int = 3, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``, against all rows."""
    scratch = Scratch(embeddings.sparkSession, "ann")
    rows = usable_vectors(embeddings, scratch)
    classes = scratch.keep(rows.groupBy("vec").agg(F.min("row").alias("node")), "classes")
    nodes = classes.select("node", "vec")
    vectors = scratch.keep(search_vectors(nodes), "vectors")
    placed = rows.join(classes.withColumnRenamed("vec", "c_vec"), F.col("vec") == F.col("c_vec")).select("row", "vec_id", "node")
    placed = scratch.keep(placed, "placed")
    asked = scratch.keep(placed.where(F.col("vec_id") % every == 0), "queries")
    query_nodes = scratch.keep(asked.select("node").distinct(), "query-nodes")
    graph, home = build_graph(vectors, scratch, max(degree, top + 10), rounds, sample, seed)
    found = greedy_search(query_nodes, vectors, graph, home, scratch, max(beam, top + 10), expand, fan, hops, parts=-(-16 // every))
    pairs = found.select(F.col("node").alias("q_node"), F.explode(F.slice("ids", 1, top + 10)).alias("c_node"))
    pairs = pairs.unionByName(query_nodes.select(F.col("node").alias("q_node"), F.col("node").alias("c_node")))
    product = F.aggregate(F.zip_with("q_vec", "c_vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(nodes.select(F.col("node").alias("a"), F.col("vec").alias("q_vec")), F.col("q_node") == F.col("a"))
    scored = scored.join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("c_vec")), F.col("c_node") == F.col("b"))
    scored = scratch.keep(scored.select("q_node", "c_node", product.alias("score")), "scored")
    scratch.drop(graph, home, found, vectors, classes, query_nodes)
    # The first rows of each class of equal vectors are all that can be among the top, the query's own row apart.
    first = F.row_number().over(Window.partitionBy("node").orderBy("vec_id", "row"))
    copies = placed.withColumn("at", first).where(F.col("at") <= top + 1).select(F.col("node").alias("p_node"), F.col("row").alias("c_row"), "vec_id")
    each = asked.select(F.col("vec_id").alias("query_id"), F.col("row").alias("q_row"), "node").join(scored, F.col("node") == F.col("q_node"))
    each = each.join(copies, F.col("c_node") == F.col("p_node")).where(F.col("q_row") != F.col("c_row"))
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "c_row"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
