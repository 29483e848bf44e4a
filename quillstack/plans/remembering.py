"""Registered queries: versions, as-of views, diffs, lifecycle, contradictions, entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import STOPWORDS
from ..operators import duplicates
from ..operators import memory as m
from ..scratch import Scratch
from .common import LINEAGES, events, lineages, seconds, table


def _at(day: str) -> F.Column:
    return F.lit(day).cast("timestamp")


def current_version(spark: SparkSession, sf: str) -> DataFrame:
    return m.current_versions(lineages(spark, sf)).select("lineage", "version", "event_id", "status")


def as_of_view(spark: SparkSession, sf: str) -> DataFrame:
    return m.as_of(lineages(spark, sf), _at("2024-01-15")).select("lineage", "version", "event_id", "status")


def as_of_diff(spark: SparkSession, sf: str) -> DataFrame:
    log = lineages(spark, sf)
    return m.as_of_diff(m.as_of(log, _at("2024-01-10")), m.as_of(log, _at("2024-01-20")), m.current_versions(log))


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    old = orders.where(F.col("o_orderkey") % 3 != 0).select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("content_hash"))
    new = orders.where(F.col("o_orderkey") % 5 != 0).select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("edited")).otherwise(F.col("o_orderpriority")).alias("content_hash"))
    return m.snapshot_diff(old, new)


def distinct_on_latest(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return orders.withColumn("n", n).where("n = 1").select("o_custkey", "o_orderkey", "o_totalprice")


def first_event_per_key(spark: SparkSession, sf: str) -> DataFrame:
    first = events(spark, sf).groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))
    return first


def status_fold(spark: SparkSession, sf: str) -> DataFrame:
    names = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "validated").when(F.col("event_type") == "click", "superseded").when(F.col("event_type") == "error", "obsoleted").otherwise("restored")
    log = events(spark, sf).select(F.col("user_id").alias("lineage"), names.alias("event"), F.struct("ts", "event_id").alias("at"))
    return m.status_fold(log)


def confidence_decay(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "customer").select(F.col("c_custkey").alias("lineage"), ((F.col("c_custkey") % 10) / 10).alias("confidence"))
    reinforced = table(spark, sf, "orders").where("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("lineage"))
    return m.decay_confidence(items, reinforced).select("lineage", F.round("confidence", 6).alias("confidence"))


def forget_propagation(spark: SparkSession, sf: str) -> DataFrame:
    provenance = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("lineage"), (F.col("l_suppkey") % 3 == 0).alias("forgotten"))
    return m.propagate_forget(provenance)


def weakened_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as items whose documents, the parts of their lines, are forgotten in part or whole."""
    provenance = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("lineage"), (F.col("l_suppkey") % 3 == 0).alias("forgotten"))
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("lineage"), F.lit("validated").alias("status"), ((F.col("o_orderkey") % 10) / 10).alias("confidence"))
    return m.weaken(own, m.propagate_forget(provenance)).select("lineage", "status", F.round("confidence", 6).alias("confidence"))


def promotion(spark: SparkSession, sf: str) -> DataFrame:
    return m.promote(events(spark, sf).where("event_type = 'view'"), "user_id", "ts", _at("2024-01-31"), 30, 5)


def poisoning_burst(spark: SparkSession, sf: str) -> DataFrame:
    rows = m.bursts(events(spark, sf), "user_id", "ts", 24, 8)
    return rows.select("user_id", seconds(F.col("window_start")).alias("window_start"), "n")


def contradiction_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """All parts of an order are one cluster: each is linked to the smallest of them."""
    parts = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("b")).distinct()
    smallest = parts.groupBy("l_orderkey").agg(F.min("b").alias("a"))
    return m.clusters(parts.join(smallest, "l_orderkey").where("a <> b").select("a", "b").distinct())


def entity_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts, suppliers, nations and regions that may mean one thing."""
    given = (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))
    names = [table(spark, sf, t).select((F.col(k).cast("long") * 10 + n).alias("id"), F.col(c).alias("name")) for n, (t, k, c) in enumerate(given)]
    return m.alias_suggestions(reduce(DataFrame.unionByName, names), "id", "name")


def merged_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Parts merged with the next one within each ten, every third merge taken back."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    merges = parts.where("id % 10 <> 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return m.merge_entities(parts, merges, merges.where("a % 3 = 0"))


def statement_relations(spark: SparkSession, sf: str) -> DataFrame:
    """What one of two near-duplicate documents says against the other, the one of smaller number being the older."""
    scratch = Scratch(spark, "relations")
    texts, keys = duplicates.copies(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    near, classes = duplicates.near_duplicates(texts, "doc_id")
    pairs = scratch.keep(duplicates.near_texts(classes, near, keys, "doc_id"), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    facts = texts.join(named, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), m.facts(F.col("text")).alias("side"))
    # None is a decision, so the relation is the same both ways: texts are compared once, whichever of their documents is the older.
    told = duplicates.compared(pairs, facts, m.related_facts, scratch).where("r.relation IS NOT NULL")
    return duplicates.of_documents(told.select("a", "b", "r.relation", "r.similarity"), keys)


def monthly_reflection(spark: SparkSession, sf: str) -> DataFrame:
    log = events(spark, sf).select(F.col("user_id").alias("lineage"), F.col("event_type").alias("event"), F.when(F.col("event_type").isin("error", "signup"), "lifecycle").otherwise("usage").alias("section"), F.col("ts").alias("at"))
    return m.reflect(log, "2024-01").select("section", "lineage", "event", "n")


_STOP = ", ".join(f"'{x}'" for x in STOPWORDS)
_DIFF = """k1 AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY version DESC) AS r FROM l WHERE created_at <= TIMESTAMP '{day}'),
{name} AS (SELECT * FROM k1 WHERE r = 1 AND status <> 'forgotten' AND valid_from <= TIMESTAMP '{day}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{day}'))"""

QUERIES = {f.__name__: f for f in (current_version, as_of_view, as_of_diff, snapshot_diff, distinct_on_latest, first_event_per_key, status_fold, confidence_decay, forget_propagation, weakened_items, promotion, poisoning_burst, contradiction_clusters, entity_aliases, merged_entities, statement_relations, monthly_reflection)}
ORACLES = {
    "current_version": f"WITH {LINEAGES} SELECT lineage, version, event_id, status FROM (SELECT *, max(version) OVER (PARTITION BY lineage) AS m FROM l) WHERE version = m",
    "as_of_view": f"WITH {LINEAGES}, {_DIFF.format(day='2024-01-15', name='v')} SELECT lineage, version, event_id, status FROM v",
    "as_of_diff": f"""WITH {LINEAGES}, {_DIFF.format(day='2024-01-10', name='a')}, {_DIFF.format(day='2024-01-20', name='b').replace('k1', 'k2')},
      last AS (SELECT lineage, arg_max(status, version) AS status FROM l GROUP BY 1),
      x AS (SELECT coalesce(a.lineage, b.lineage) AS lineage, a.version AS va, b.version AS vb FROM a FULL JOIN b ON a.lineage = b.lineage)
      SELECT lineage, CASE WHEN va IS NULL THEN 'added' WHEN vb IS NULL THEN 'removed' ELSE 'changed' END AS change,
        CASE WHEN vb IS NULL THEN CASE WHEN status IN ('superseded', 'obsolete', 'forgotten') THEN status ELSE 'expired' END END AS why
      FROM x LEFT JOIN last USING (lineage) WHERE va IS NULL OR vb IS NULL OR va <> vb""",
    "snapshot_diff": """WITH a AS (SELECT o_orderkey AS key, o_orderpriority AS h FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'edited' ELSE o_orderpriority END AS h FROM orders WHERE o_orderkey % 5 <> 0)
      SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key""",
    "distinct_on_latest": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    "first_event_per_key": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1, 2",
    "status_fold": """WITH e AS (SELECT user_id AS lineage, ts, event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'validated' WHEN 'click' THEN 'superseded' WHEN 'error' THEN 'obsoleted' ELSE 'restored' END AS event FROM events),
      s AS (SELECT *, CASE event WHEN 'created' THEN 'proposed' WHEN 'validated' THEN 'validated' WHEN 'superseded' THEN 'superseded' WHEN 'obsoleted' THEN 'obsolete' END AS st FROM e),
      o AS (SELECT *, last_value(CASE WHEN st IN ('proposed', 'validated') THEN st END IGNORE NULLS) OVER (PARTITION BY lineage ORDER BY ts, event_id) AS before FROM s)
      SELECT lineage, arg_max(CASE WHEN event = 'restored' THEN coalesce(before, 'proposed') ELSE st END, (ts, event_id)) AS status FROM o GROUP BY 1""",
    "confidence_decay": """WITH r AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= '1998-01-01')
      SELECT c_custkey AS lineage, round(CASE WHEN o_custkey IS NOT NULL THEN (c_custkey % 10) / 10 ELSE least((c_custkey % 10) / 10, greatest(0.2, (c_custkey % 10) / 10 * 0.95)) END, 6) AS confidence FROM customer LEFT JOIN r ON o_custkey = c_custkey""",
    "forget_propagation": """SELECT l_orderkey AS lineage, CASE WHEN bool_and(l_suppkey % 3 = 0) THEN 'forget' ELSE 'weaken' END AS action, CASE WHEN bool_and(l_suppkey % 3 = 0) THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS factor
      FROM lineitem GROUP BY 1 HAVING bool_or(l_suppkey % 3 = 0)""",
    "weakened_items": """WITH f AS (SELECT l_orderkey, bool_and(l_suppkey % 3 = 0) AS everything, bool_or(l_suppkey % 3 = 0) AS something FROM lineitem GROUP BY 1)
      SELECT o_orderkey AS lineage, CASE WHEN everything THEN 'forgotten' ELSE 'validated' END AS status, round(CASE WHEN something AND NOT everything THEN greatest(0.05, (o_orderkey % 10) / 10 * 0.6) ELSE (o_orderkey % 10) / 10 END, 6) AS confidence
      FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""",
    "promotion": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-01' GROUP BY 1 HAVING count(*) >= 5",
    "poisoning_burst": """WITH w AS (SELECT DISTINCT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOURS FOLLOWING) AS n FROM events)
      SELECT user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS window_start, n FROM w WHERE n >= 8""",
    # The smallest label of a vertex and its neighbours, 20 times over: the parts of all orders are near each other.
    "contradiction_clusters": """WITH RECURSIVE p AS (SELECT DISTINCT l_partkey AS b, min(l_partkey) OVER (PARTITION BY l_orderkey) AS a FROM lineitem), e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
      r(id, root, n) AS (SELECT a, least(a, min(b)), 0 FROM e GROUP BY a
        UNION ALL SELECT id, root, n + 1 FROM (SELECT e.a AS id, least(x.root, min(r.root)) AS root, any_value(r.n) AS n FROM e JOIN r ON r.id = e.b JOIN r x ON x.id = e.a GROUP BY e.a, x.root) WHERE n < 20)
      SELECT id, min(root) AS root FROM r GROUP BY 1""",
    "merged_entities": """WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 OR (p_partkey - 1) % 3 = 0 OR NOT EXISTS (SELECT 1 FROM part x WHERE x.p_partkey = part.p_partkey - 1) THEN p_partkey END AS head FROM part)
      SELECT id, max(head) OVER (ORDER BY id) AS entity FROM c""",
    "entity_aliases": f"""WITH n AS (SELECT p_partkey * 10 AS id, p_name AS name FROM part UNION ALL SELECT s_suppkey * 10 + 1, s_name FROM supplier UNION ALL SELECT n_nationkey * 10 + 2, n_name FROM nation UNION ALL SELECT r_regionkey * 10 + 3, r_name FROM region),
      f AS (SELECT id, trim(regexp_replace(replace(strip_accents(lower(name)), 'œ', 'oe'), '\\s+', ' ', 'g')) AS form FROM n), c AS (SELECT form, min(id) AS id FROM f WHERE form <> '' GROUP BY 1),
      w AS (SELECT id, form, replace(form, ' ', '') AS flat, list_filter(regexp_extract_all(form, '[a-z0-9]+'), lambda w: w NOT IN ({_STOP})) AS w FROM c),
      k AS (SELECT id, form, flat, array_to_string(list_transform(w, lambda x: substr(x, 1, 1)), '') AS short, list_distinct(list_transform(list_filter(w, lambda x: length(x) > 1 OR regexp_full_match(x, '[0-9]')),
        lambda x: CASE WHEN length(x) <= 3 OR regexp_full_match(x, '[0-9]+') THEN x ELSE regexp_replace(x, '^(.{{3,}}?)(ements|ement|ations|ation|ees|ee|es|s|x|e)$', '\\1') END)) AS t FROM w),
      p AS (SELECT x.id AS a, y.id AS b, (x.flat = y.short AND len(y.t) > 1) OR (y.flat = x.short AND len(x.t) > 1) AS acr, contains(' ' || x.form || ' ', ' ' || y.form || ' ') OR contains(' ' || y.form || ' ', ' ' || x.form || ' ') AS within,
        round(CASE WHEN len(x.t) = 0 OR len(y.t) = 0 THEN 0 ELSE 2 * len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t)) END, 4) AS dice FROM k x JOIN k y ON x.id < y.id)
      SELECT a, b, CAST(CASE WHEN acr THEN 0.9 WHEN within THEN 0.75 ELSE dice END AS DOUBLE) AS score, CASE WHEN acr THEN 'acronym' WHEN within THEN 'containment' ELSE 'lexical' END AS reason FROM p WHERE acr OR within OR dice >= 0.6
      UNION ALL SELECT c.id, f.id, 1.0, 'form' FROM f JOIN c USING (form) WHERE f.id <> c.id""",
    "monthly_reflection": """WITH x AS (SELECT user_id AS lineage, event_type AS event, CASE WHEN event_type IN ('error', 'signup') THEN 'lifecycle' ELSE 'usage' END AS section, max(ts) AS last_at FROM events WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1, 2, 3)
      SELECT section, lineage, event, n FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY last_at DESC, lineage, event) AS n FROM x) WHERE n <= 25""",
}
