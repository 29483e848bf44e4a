"""Connected components by joins and minima only: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b) that is not its component's smallest one.

    Each round hangs neighbours on the smallest vertex that a vertex sees; it ends when all edges lead to a root. The minima
    are combined before the shuffle, so a vertex with very many edges stays cheap; the rounds grow with the logarithm of the
    largest distance. The driver sees a count and a checksum for each round.
    """
    edges = scratch.keep(_tidy(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))), "edges")
    mark = _checksum(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("low")).select(F.col("v").alias("u"), F.least("v", "low").alias("low"))
        # Large star: every larger neighbour of a vertex goes to the smallest vertex that this one sees.
        large = scratch.keep(_tidy(both.join(least, both["v"] == least["u"]).where(F.col("m") > F.col("v")).select(F.col("m").alias("v"), F.col("low").alias("m"))), "large")
        # Small star: a vertex and its smaller neighbours go to the smallest of them.
        least = large.groupBy("v").agg(F.min("m").alias("low")).select(F.col("v").alias("u"), "low")
        joined = large.join(least, large["v"] == least["u"])
        small = joined.select(F.col("m").alias("v"), F.col("low").alias("m")).unionByName(least.select(F.col("u").alias("v"), F.col("low").alias("m")))
        new = scratch.keep(_tidy(small), "small")
        scratch.drop(edges, large)
        edges, last, mark = new, mark, _checksum(new)
        if mark == last:
            break
    return edges.select("v", F.col("m").alias("root"))


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("v") != F.col("m")).distinct()


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def greedy_leaders(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, leader) of every vertex that joins an earlier one when vertices are taken in order and each joins the first leader that it has an edge with.

    edges: a, b, at; a comes before b, at orders the a. The sequential result without a sequence: a vertex with no undecided earlier
    neighbour leads, those it reaches join, and edges of the decided go; the rounds grow with the longest chain of such decisions.
    """
    edges = scratch.keep(edges.distinct(), "order")
    left, joined = edges, None
    while left.limit(1).count():
        first = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        lost = scratch.keep(left.join(first, "a", "left_semi").select(F.col("b").alias("v")).distinct(), "lost")
        joined = lost if joined is None else joined.unionByName(lost)
        last, left = left, scratch.keep(left.join(lost, F.col("a") == F.col("v"), "left_anti").join(lost, F.col("b") == F.col("v"), "left_anti"), "left")
        if last is not edges:
            scratch.drop(last)
    if joined is None:
        return edges.select(F.col("b").alias("v"), F.col("a").alias("leader"))
    led = edges.join(joined, F.col("a") == F.col("v"), "left_anti").groupBy("b").agg(F.min_by("a", "at").alias("leader"))
    return scratch.keep(led.withColumnRenamed("b", "v"), "led")
