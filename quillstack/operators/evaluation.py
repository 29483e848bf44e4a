"""Retrieval quality: recall, nDCG, faithfulness, pass or fail, and the learning of ranking weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(ranked: DataFrame, expected: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, n_expected, recall): 1 for a query that expects nothing. expected: query, item (null: no expectation)."""
    wanted = expected.select(query, item).distinct()
    found = ranked.where(F.col("rnk") <= k).select(query, item).distinct().withColumn("hit", F.lit(1))
    rows = wanted.join(found, [query, item], "left").groupBy(query).agg(F.count(item).alias("n_expected"), F.count("hit").alias("hits"))
    return rows.select(query, "n_expected", F.round(F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("hits") / F.col("n_expected")), 4).alias("recall"))


def ndcg_at_k(ranked: DataFrame, expected: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, ndcg) with binary gains at an item's first rank."""
    wanted = expected.where(F.col(item).isNotNull()).select(query, item).distinct()
    first = ranked.where(F.col("rnk") <= k).groupBy(query, item).agg(F.min("rnk").alias("rnk"))
    gains = wanted.join(first, [query, item], "left").groupBy(query).agg(F.count("*").alias("n"), F.sum(1 / F.log2(F.col("rnk") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    scored = gains.select(query, F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 4).alias("ndcg"))
    return expected.select(query).distinct().join(scored, query, "left").select(query, F.coalesce("ndcg", F.lit(1.0)).alias("ndcg"))


def faithfulness(answers: DataFrame, key: str, cited: str = "cited", served: str = "served") -> DataFrame:
    """(key, faithfulness): share of citation marks that were served; without marks 1 if nothing was served, else 0."""
    marks = F.array_distinct(F.col(cited))
    share = F.size(F.array_intersect(marks, F.col(served))) / F.size(marks)
    return answers.select(key, F.round(F.when(F.size(marks) > 0, share).otherwise(F.when(F.size(served) == 0, 1.0).otherwise(0.0)), 4).alias("faithfulness"))


def replay(scores: DataFrame, least: float = 0.6) -> DataFrame:
    """One row: queries, passed, mean recall, verdict of a golden set."""
    rows = scores.agg(F.count("*").alias("queries"), F.count_if(F.col("recall") >= least).alias("passed"), F.round(F.avg("recall"), 4).alias("mean_recall"))
    return rows.withColumn("verdict", F.when(F.col("mean_recall") >= least, "pass").otherwise("fail"))


def in_sample(key, percent: int):
    """Whether a row is in a stable hash sample."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(100)) < percent


def propose_weights(signals: DataFrame, names: list[str], weights: list[float], step: float = 0.1) -> list[float]:
    """New weights from labelled signals: each moves by the gap of its means, at most ``step``, none below 0, sum 1 as before.

    Only two rows of means come to the driver.
    """
    means = {r["label"]: r for r in signals.groupBy("label").agg(*[F.avg(n).alias(n) for n in names]).collect()}
    if not {0, 1} <= set(means):
        return list(weights)
    moved = [w + max(-step, min(step, step * ((means[1][n] or 0.0) - (means[0][n] or 0.0)))) for n, w in zip(names, weights, strict=True)]
    low = [max(0.0, w - step) for w in weights]
    high = [w + step for w in weights]
    return project(moved, low, high)


def project(values: list[float], low: list[float], high: list[float]) -> list[float]:
    """The values shifted alike, within their bounds, until they sum to 1."""
    a, b = -2.0, 2.0
    for _ in range(80):
        shift = (a + b) / 2
        total = sum(min(h, max(lo, v + shift)) for v, lo, h in zip(values, low, high, strict=True))
        a, b = (shift, b) if total < 1 else (a, shift)
    return [round(min(h, max(lo, v + b)), 6) for v, lo, h in zip(values, low, high, strict=True)]
