"""Exact cosine neighbours by pivots: vectors lie in cells of their nearest pivot, and bounds tell which cells a query has to visit.

The angle between unit vectors is a metric. A cell keeps the least and the largest angle of its vectors to the pivot, so a query at angle t
finds nothing in it closer than max(t - largest, least - t, 0). Each query first visits the nearest cells that hold ``k`` vectors, which gives the
score that its k-th neighbour has at least, and then those cells alone that may hold a better one.

Scale. Vectors are dealt to pivots by one product with at most ``PIVOTS`` vectors and meet queries by equi-joins on the cell; a crowded cell and
a crowded set of queries are cut into parts of ``PART`` rows, and every part keeps its best ``k`` for each query before anything is shuffled. Where
vectors have no neighbourhood all cells are visited and the work is that of all pairs; ``op6`` style search is the way for such tables.

Defined cases: a null or zero vector, one with a null or non-finite component, or of another length than most take no part; a row is no neighbour
of a query with its own key where both are of one table; scores below 0 count as 0; ties go to the smaller key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..scratch import Scratch

PIVOTS, PART = 512, 4096
#: Scores have five places; a bound is missed only if it is clear beyond half of one.
PLACES, SLACK = 5, 1e-5


def _usable(rows: DataFrame, key: str, vec: str, name: str) -> DataFrame:
    cast = rows.select(F.col(key).alias(name), F.col(vec).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return cast.where(finite & F.exists("v", lambda x: x != 0))


def _matrix(batch: pa.RecordBatch, at: int, dims: int) -> np.ndarray:
    x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _celled(pivots: np.ndarray):
    """(key, cell, angle, v): the nearest pivot of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            like = np.clip(_matrix(batch, 1, pivots.shape[1]) @ pivots.T, -1, 1)
            cell = like.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(np.arccos(like[np.arange(len(cell)), cell])), batch.column(1)], names=["_c", "cell", "angle", "v"])

    return run


def _visits(pivots: np.ndarray, cells: np.ndarray, k: int) -> Callable:
    """(query, cell, first, at_most, v): every cell with the best cosine that it may hold for a query; ``first``: those visited at once."""
    count, least, largest = cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                away = np.arccos(np.clip(_matrix(piece, 1, pivots.shape[1]) @ pivots.T, -1, 1))
                bound = np.maximum(0, np.maximum(away - largest, least - away))
                bound[:, count == 0] = np.inf
                order = np.lexsort((away, bound), axis=1)
                before = np.cumsum(count[order], axis=1) - count[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before <= k, axis=1)  # one more, as the query may lie in a cell itself
                row, cell = np.nonzero(np.isfinite(bound))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(first[row, cell]), pa.array(np.cos(bound[row, cell]))], names=["_q", "cell", "first", "at_most"])

    return run


def _best(k: int, dims: int, same_table: bool):
    """The ``k`` best of a part of a cell for each query of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, held = left.combine_chunks().to_batches(), right.combine_chunks().to_batches()
        out = []
        if asked and held:
            asked, held = asked[0], held[0]
            order = held.column("_c").to_numpy().argsort(kind="stable")
            held = held.take(pa.array(order))
            keys, like = held.column("_c").to_numpy(), _matrix(asked, asked.schema.get_field_index("v"), dims) @ _matrix(held, held.schema.get_field_index("v"), dims).T
            score = np.floor(np.clip(like, 0, 1) * 10**PLACES + 0.5) / 10**PLACES
            queries = asked.column("_q").to_numpy()
            if same_table:
                score[queries[:, None] == keys[None, :]] = -1
            # Stable by score: equal ones stay in order of their keys.
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(queries)), top.shape[1])
            found = score[row, top.ravel()]
            out = [queries[row][found >= 0], keys[top.ravel()][found >= 0], found[found >= 0]]
        out = out or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"_q": out[0], "_c": out[1], "score": out[2]})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, query_key: str, key: str, vec: str, k: int, same_table: bool = True, pivots: int = PIVOTS, seen: list | None = None) -> DataFrame:
    """(query, candidate, score, rnk): the ``k`` rows of largest cosine for each query. Keys are whole numbers.

    ``seen`` gets the number of pairs that were compared and the number of all.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    schema = f"{query_key} long, candidate long, score double, rnk long"
    usable = _usable(vectors, key, vec, "_c").withColumn("_c", F.col("_c").cast("long"))
    size = usable.agg(F.count("*").alias("n"), F.mode(F.size("v")).alias("dims")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    n, dims = size["n"], size["dims"]
    usable = usable.where(F.size("v") == dims)
    drawn = usable.orderBy(F.xxhash64("_c"), "_c").limit(min(pivots, math.isqrt(n) + 1)).collect()  # at most ``pivots`` vectors
    centre = np.array([r["v"] for r in drawn], np.float64)
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    placed = scratch.keep(usable.mapInArrow(_celled(centre), "_c long, cell int, angle double, v array<double>"), "placed")
    cells = np.zeros((3, len(centre)))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect():
        cells[:, r["cell"]] = r["n"], r["lo"] - 1e-9, r["hi"] + 1e-9

    asked = _usable(queries, query_key, vec, "_q").where(F.size("v") == dims).withColumn("_q", F.col("_q").cast("long"))
    asked = scratch.keep(asked, "asked")
    visits = scratch.keep(asked.mapInArrow(_visits(centre, cells, k), "_q long, cell int, first boolean, at_most double"), "visits")
    parts = spark.createDataFrame([(c, int(-(-x // PART))) for c, x in enumerate(cells[0].tolist()) if x], "p_cell int, parts int")  # a row for each pivot

    def visited(some: DataFrame, name: str) -> DataFrame:
        """The best of the cells in ``some`` (query, cell)."""
        some = scratch.keep(some.select("_q", "cell"), name)
        crowd = some.groupBy(F.col("cell").alias("b_cell")).agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks"))
        crowd = scratch.keep(crowd.join(F.broadcast(parts), F.col("b_cell") == F.col("p_cell")).drop("p_cell"), "crowd")  # at most ``pivots`` rows
        left = some.join(F.broadcast(crowd), F.col("cell") == F.col("b_cell")).withColumn("block", F.pmod(F.xxhash64("_q"), F.col("blocks")).cast("int"))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("_q", "cell", "block", "part").join(asked, "_q").select("_q", "v", "cell", "block", "part")
        right = placed.join(F.broadcast(crowd), F.col("cell") == F.col("b_cell")).withColumn("part", F.pmod(F.xxhash64("_c"), F.col("parts")).cast("int"))
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("_c").alias("_c"), F.col("v").alias("v"), F.col("cell").alias("cell"), "block", "part")
        if seen is not None:
            sizes = spark.createDataFrame(list(enumerate(cells[0].astype(int).tolist())), "s_cell int, s long")
            seen.append(some.join(sizes, F.col("cell") == F.col("s_cell")).agg(F.sum("s")).first()[0] or 0)
        found = left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(_best(k, dims, same_table), "_q long, _c long, score double")
        return scratch.keep(found, "found")

    near = visited(visits.where("first"), "first")
    place = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "_c"))
    least = near.withColumn("place", place).where(F.col("place") == k).select(F.col("_q").alias("l_q"), F.col("score").alias("least"))
    open_ = (F.coalesce("least", F.lit(0.0)) <= 0) | (F.col("at_most") >= F.col("least") - SLACK)
    rest = visits.where(~F.col("first")).join(least, F.col("_q") == F.col("l_q"), "left").where(open_)
    both = near.unionByName(visited(rest, "rest"))
    if seen is not None:
        seen[:] = [sum(seen), asked.count() * n]
    ranked = both.select(F.col("_q").alias(query_key), F.col("_c").alias("candidate"), "score")
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), "candidate"))
    return ranked.withColumn("rnk", rank.cast("long")).where(F.col("rnk") <= k)
