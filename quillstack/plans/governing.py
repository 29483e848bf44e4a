"""Registered queries: access rules, verdicts, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as g
from ..operators.analytics import zero_filled_counts
from .common import CANDIDATES, candidates, table

CONTEXT = g.Context(held=("project:*", "user:1", "role:viewer"), clearance=2, now="2024-06-30", requester="1", scopes=("project", "user", "short_term"), source_kinds=("wiki",), min_relevance=0.1, freshness={"wiki": 180, "mail": 90})


def governance_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("doc_id", g.verdict(g.rules(CONTEXT)).alias("reason_code"))


def exclusions_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    codes = [code for code, _ in g.rules(CONTEXT)]
    return zero_filled_counts(governance_verdicts(spark, sf).where("reason_code is not null"), "reason_code", codes)


def inclusions_by_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).withColumn("reason_code", g.verdict(g.rules(CONTEXT))).where("reason_code is null")
    composite = F.concat_ws(":", "candidate_type", F.when(F.col("candidate_type") == "memory", F.col("kind")).otherwise(F.col("source_kind")))
    return rows.groupBy(composite.alias("type_kind")).agg(F.count("*").alias("n"))


def acl_overlap(spark: SparkSession, sf: str) -> DataFrame:
    held = g.principals(F.lit(1), F.lit("editor"))
    return candidates(spark, sf).select("doc_id", g.acl_allows(F.col("acl"), held).alias("allowed"), g.access_scope(F.col("acl")).alias("access_scope"), g.clearance(F.col("level"), F.lit(2)).alias("effective"))


def merge_acl(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).withColumn("grp", F.col("doc_id") % 50).select("grp", F.when(F.col("doc_id") % 3 == 0, F.array_append("acl", F.lit("role:viewer"))).otherwise(F.col("acl")).alias("acl"), "level")
    merged = g.merge_acls(rows, "grp", "acl", "level")
    return merged.select("grp", F.array_join("acl", ",").alias("acl"), F.col("level").cast("long").alias("level"))


def redaction_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).select("doc_id", "level", "kind", "source_kind")
    return g.redact(rows, F.col("level") <= 1, "kind", "source_kind")


def hidden_targets(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("readable"))
    rows = g.hidden_targets(table(spark, sf, "events").select("event_id", "user_id"), users, "user_id")
    return rows.select("event_id", "hidden")


def acl_parsing(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(" user:"), F.col("user_id").cast("string"), F.lit(" ; role:viewer, bad , role:viewer"))
    return table(spark, sf, "events").select("event_id", F.array_join(g.parse_acl(raw), "|").alias("acl"))


_V = """v AS (SELECT c.*, CASE
  WHEN status = 'forgotten' THEN 'EXCLUDED_FORGOTTEN'
  WHEN NOT list_has_any(acl, ['project:*', 'user:1', 'role:viewer']) AND NOT (candidate_type = 'memory' AND scope = 'user' AND len(acl) > 0 AND len(list_filter(acl, lambda p: p <> 'user:' || subject)) = 0) THEN 'EXCLUDED_ACL'
  WHEN level > 2 THEN 'EXCLUDED_CLASSIFICATION'
  WHEN quarantined THEN 'EXCLUDED_QUARANTINE'
  WHEN candidate_type = 'memory' AND (scope NOT IN ('project', 'user', 'short_term') OR (scope = 'user' AND subject <> '1')) OR candidate_type = 'chunk' AND source_kind <> 'wiki' THEN 'EXCLUDED_SCOPE'
  WHEN candidate_type = 'memory' AND scope = 'short_term' AND expires_at <= TIMESTAMP '2024-06-30' THEN 'EXCLUDED_EXPIRED'
  WHEN NOT pinned AND candidate_type = 'memory' AND status NOT IN ('superseded', 'obsolete') AND (valid_to <= TIMESTAMP '2024-06-30'
       OR (NOT (scope IN ('long_term', 'user', 'short_term') OR (status = 'validated' AND kind = 'decision')) AND date_diff('day', date, TIMESTAMP '2024-06-30') > 180)) THEN 'EXCLUDED_STALE'
  WHEN NOT pinned AND candidate_type = 'chunk' AND date_diff('day', date, TIMESTAMP '2024-06-30') > CASE source_kind WHEN 'wiki' THEN 180 ELSE 90 END THEN 'EXCLUDED_STALE'
  WHEN status = 'superseded' OR (candidate_type = 'memory' AND status = 'obsolete') THEN 'EXCLUDED_SUPERSEDED'
  WHEN NOT pinned AND candidate_type <> 'session' AND score < 0.1 THEN 'EXCLUDED_LOW_SCORE' END AS reason_code FROM c)"""
_CODES = ", ".join(f"('{code}')" for code in ("EXCLUDED_FORGOTTEN", "EXCLUDED_ACL", "EXCLUDED_CLASSIFICATION", "EXCLUDED_QUARANTINE", "EXCLUDED_SCOPE", "EXCLUDED_EXPIRED", "EXCLUDED_STALE", "EXCLUDED_SUPERSEDED", "EXCLUDED_LOW_SCORE"))

QUERIES = {f.__name__: f for f in (governance_verdicts, exclusions_by_reason, inclusions_by_type, acl_overlap, merge_acl, redaction_projection, hidden_targets, acl_parsing)}
ORACLES = {
    "governance_verdicts": f"WITH {CANDIDATES}, {_V} SELECT doc_id, reason_code FROM v",
    "exclusions_by_reason": f"WITH {CANDIDATES}, {_V}, k(reason_code) AS (VALUES {_CODES}) SELECT k.reason_code, count(v.doc_id) AS n FROM k LEFT JOIN v USING (reason_code) GROUP BY 1",
    "inclusions_by_type": f"WITH {CANDIDATES}, {_V} SELECT candidate_type || ':' || CASE WHEN candidate_type = 'memory' THEN kind ELSE source_kind END AS type_kind, count(*) AS n FROM v WHERE reason_code IS NULL GROUP BY 1",
    "acl_overlap": f"""WITH {CANDIDATES} SELECT doc_id, list_has_any(acl, ['project:*', 'user:1', 'role:editor', 'role:viewer']) AS allowed,
      CASE WHEN list_contains(acl, 'project:*') THEN 'project' ELSE 'restricted' END AS access_scope, CAST(least(level, 2) AS INTEGER) AS effective FROM c""",
    "merge_acl": f"""WITH {CANDIDATES}, a AS (SELECT doc_id % 50 AS grp, level, CASE WHEN doc_id % 3 = 0 THEN list_append(acl, 'role:viewer') ELSE acl END AS acl FROM c),
      r AS (SELECT grp, list_distinct(acl) AS acl FROM a WHERE len(acl) > 0 AND NOT list_contains(acl, 'project:*')),
      n AS (SELECT grp, max(level) AS level FROM a GROUP BY 1), m AS (SELECT grp, count(*) AS m FROM r GROUP BY 1),
      k AS (SELECT grp, p, count(*) AS c FROM (SELECT grp, unnest(acl) AS p FROM r) GROUP BY 1, 2), s AS (SELECT grp, string_agg(p, ',' ORDER BY p) AS acl FROM k JOIN m USING (grp) WHERE k.c = m.m GROUP BY 1)
      SELECT n.grp, CASE WHEN m.m IS NULL THEN 'project:*' ELSE coalesce(s.acl, '') END AS acl, level FROM n LEFT JOIN m USING (grp) LEFT JOIN s USING (grp)""",
    "redaction_projection": f"WITH {CANDIDATES} SELECT doc_id, CAST(level AS INTEGER) AS level, CASE WHEN level <= 1 THEN kind END AS kind, CASE WHEN level <= 1 THEN source_kind END AS source_kind FROM c",
    "hidden_targets": "SELECT event_id, NOT coalesce(c_acctbal > 0, false) AS hidden FROM events LEFT JOIN customer ON c_custkey = user_id",
    "acl_parsing": "SELECT event_id, 'user:' || user_id || '|role:viewer' AS acl FROM events",
}
