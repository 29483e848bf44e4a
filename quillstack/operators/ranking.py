"""Heuristic reranking, trust, freshness, intent, coverage and sufficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights of fused rank, vector similarity, freshness, type and term overlap.
WEIGHTS = (0.55, 0.20, 0.10, 0.10, 0.05)
#: How much a kind of memory counts; chunks and session turns count 0.5.
TYPE_BOOST = {"decision": 0.85, "requirement": 0.8, "constraint": 0.8, "risk": 0.7, "fact": 0.65, "preference": 0.6, "summary": 0.6, "procedure": 0.75, "action": 0.7, "learning": 0.75}
HALF_LIFE_DAYS = 90


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def age_days(date: Column, now: Column) -> Column:
    """Days as a fraction, never negative, null for an unknown date."""
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(date.cast("timestamp"))) / F.lit(86_400_000_000)
    return F.when(date.isNotNull(), F.greatest(F.lit(0.0), seconds))


def decay(date: Column, now: Column) -> Column:
    return F.coalesce(F.pow(F.lit(0.5), age_days(date, now) / HALF_LIFE_DAYS), F.lit(0.5))


def type_boost(candidate_type: Column, kind: Column, status: Column) -> Column:
    by_kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_BOOST.items() for x in pair]), kind), F.lit(0.6))
    memory = F.when((kind == "decision") & (status == "validated"), 1.0).when(status == "proposed", by_kind * 0.9).otherwise(by_kind)
    return F.when(candidate_type.isin("chunk", "session"), 0.5).otherwise(memory)


def heuristic(relevance: Column, dense: Column, fresh: Column, boost: Column, overlap: Column, weights=WEIGHTS) -> Column:
    parts = [w * x for w, x in zip(weights, (relevance, dense, fresh, boost, overlap), strict=True)]
    return clamp01(parts[0] + parts[1] + parts[2] + parts[3] + parts[4])


def trust_factor(trust: Column, penalty: float = 0.15) -> Column:
    return F.when(trust == "low", 1 - penalty).when(trust == "medium", 1 - penalty / 2).otherwise(1.0)


def policy_days(kind: Column, policy: dict[str, int], override: int | None = None) -> Column:
    """Maximum age for a source kind; an override wins, values of 0 and less mean no limit."""
    if override and override > 0:
        return F.lit(override)
    limits = F.create_map(*[F.lit(x) for pair in policy.items() for x in pair]) if policy else F.create_map().cast("map<string,int>")
    days = F.element_at(limits, kind)
    return F.when(days > 0, days)


def infer_intent(texts: DataFrame, key: str, tokens: str, keywords: DataFrame, default: str) -> DataFrame:
    """The intent with most keyword hits; equal counts go to the one listed first (``priority``). No hit: the default."""
    found = texts.select(key, F.explode(tokens).alias("keyword")).join(keywords, "keyword")
    counts = found.groupBy(key, "intent").agg(F.count("*").alias("hits"), F.min("priority").alias("priority"))
    best = counts.groupBy(key).agg(F.max_by(F.struct("intent", "hits"), F.struct(F.col("hits"), -F.col("priority"))).alias("best"))
    return texts.select(key).join(best, key, "left").select(key, F.coalesce("best.intent", F.lit(default)).alias("intent"), F.coalesce("best.hits", F.lit(0)).alias("hits"))


def sufficiency(rows: DataFrame, key: str) -> DataFrame:
    """0.5 topics + 0.25 terms + 0.25 relevance of the best three, and the verdict."""
    score = F.round(0.5 * F.col("topic_coverage") + 0.25 * F.col("term_coverage") + 0.25 * F.col("relevance"), 4)
    verdict = F.when((F.col("score") >= 0.75) & (F.col("missing") == 0), "sufficient").when(F.col("score") >= 0.4, "partial").otherwise("insufficient")
    return rows.withColumn("score", score).select(key, "score", verdict.alias("verdict"))
