"""Registered queries: the life of memory items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as c
from ..operators import memory as m
from .common import ITEMS, PROVENANCE, items, provenance, seconds, table


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Returned order lines as contradictions between two items."""
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))


_EDGES = "e AS (SELECT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R')"


def kind_families(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).groupBy(c.kind_family(F.col("kind")).alias("family")).agg(F.count("*").alias("n"))


def resolved_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The current version behind every item that an order line names."""
    refs = table(spark, sf, "lineitem").select("l_partkey").distinct()
    return c.resolve_current(items(spark, sf), refs, "l_partkey").select("l_partkey", "current_id", "current_version", "current_status")


def provenance_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = c.provenance_rollup(items(spark, sf), provenance(spark, sf))
    return rows.select("lineage", "trust", F.array_join("kinds", ",").alias("kinds"), "n_chunks")


def provenance_floor(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.concat_ws(":", "l_partkey", "l_linenumber").alias("chunk"), (F.col("l_partkey") % 4).alias("level")).distinct()
    documents = table(spark, sf, "part").select(F.col("p_partkey").alias("document"), F.when(F.col("p_size") > 5, F.col("p_size") % 3).cast("long").alias("level"))
    return c.provenance_floor(provenance(spark, sf), documents, chunks)


def created_items(spark: SparkSession, sf: str) -> DataFrame:
    drafts = items(spark, sf).select(F.col("id").alias("item"), "level", "scope", "created_at", "confidence")
    documents = table(spark, sf, "part").select(F.col("p_partkey").alias("document"), (F.col("p_partkey") % 3).alias("level"))
    rows = c.create_items(drafts, provenance(spark, sf).select("item", "document"), documents)
    return rows.select("item", "level", "status", seconds(F.col("expires_at")).alias("expires_at"))


def supersede_versions(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("document"), F.col("l_linenumber").cast("long").alias("version"), F.col("l_orderkey").alias("chunk"))
    marked, edges = c.supersede_versions(chunks)
    per = marked.groupBy("document").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "superseded").alias("superseded"))
    return per.join(edges.groupBy("document").agg(F.count("*").alias("edges"), F.sum(F.col("newer") - F.col("older")).alias("steps")), "document", "left").fillna(0, ["edges", "steps"])


def obsolete_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed items that only older versions of their documents support: the parts' newest version is 5."""
    own = items(spark, sf).select(F.col("id").alias("item"), "status", F.col("title").alias("statement"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 2).alias("document"), F.col("l_linenumber").cast("long").alias("version"))
    restated = spark.createDataFrame([("1-URGENT",)], "statement string")
    return c.missing_statements(own, lines, restated, 1, 5)


def short_term_expiry(spark: SparkSession, sf: str) -> DataFrame:
    own = items(spark, sf).withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 12 HOURS"))
    rows = c.expire_short_term(own, F.lit("1997-01-01").cast("timestamp"))
    return rows.groupBy("scope", "status").agg(F.count("*").alias("n"), F.count_if("expired").alias("expired"))


def memory_consolidation(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with like names are statements that repeat each other."""
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.lit("fact").alias("kind"), F.col("p_name").alias("statement"), F.col("p_brand").alias("access"), F.lit("validated").alias("status"), F.col("p_size").alias("at"), F.lit(0.5).alias("confidence"))
    return c.consolidate(own)


def purge_copies(spark: SparkSession, sf: str) -> DataFrame:
    copies = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("excerpt"))
    gone = table(spark, sf, "part").where("p_size <= 3").select(F.col("p_partkey").alias("l_partkey"))
    return c.purge_copies(copies, gone, "l_partkey", "excerpt").groupBy("excerpt", "content_hash").agg(F.count("*").alias("n"), F.count_if("purged").alias("purged"))


def conflict_list(spark: SparkSession, sf: str) -> DataFrame:
    return c.conflict_list(_edges(spark, sf), items(spark, sf), F.col("level") <= 2)


def outdated_since_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    own = items(spark, sf)
    return c.outdated_since(own.where("id % 3 = 0").select("id"), own)


def decision_trail(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(seconds(F.col("o_orderdate")).alias("at"), F.lit("created").alias("kind"), F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("item"))
    lines = table(spark, sf, "lineitem").select(seconds(F.col("l_shipdate")).alias("at"), F.lit("shipped").alias("kind"), F.col("l_linestatus").alias("label"), F.col("l_orderkey").alias("item"))
    return c.timeline(orders, lines)


def bulk_triage(spark: SparkSession, sf: str) -> DataFrame:
    own = items(spark, sf).select(F.col("id").alias("item"), "status")
    action = F.when(F.col("l_linenumber") % 3 == 0, "reject").when(F.col("l_linenumber") % 3 == 1, "accept").otherwise("defer")
    turn = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return c.triage(own, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), action.alias("action"), turn.alias("turn")))


def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("alias"))
    words = names.unionByName(table(spark, sf, "region").select((F.col("r_regionkey") + 1000).alias("entity"), F.col("r_name").alias("alias")))
    extra = spark.createDataFrame([(2000, "the"), (2001, "of the"), (2002, "data set"), (2003, "le")], "entity int, alias string")
    return c.mentions(table(spark, sf, "documents"), words.unionByName(extra), "doc_id", "text").select("doc_id", F.col("entity").cast("long").alias("entity"))


def memory_graph(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("entity"))
    nodes, edges = c.graph_of(items(spark, sf), _edges(spark, sf), provenance(spark, sf), named)
    counted = nodes.groupBy(F.concat(F.lit("node "), "type").alias("part")).agg(F.count("*").alias("n"))
    return counted.unionByName(edges.groupBy(F.concat(F.lit("edge "), "type").alias("part")).agg(F.count("*").alias("n")))


def idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("at"))
    return c.idle_sessions(turns, F.lit("2024-01-31").cast("timestamp")).select("session", "n", seconds(F.col("last_at")).alias("last_at"), "state")


def purged_turns(spark: SparkSession, sf: str) -> DataFrame:
    left = c.purge_turns(table(spark, sf, "conversations"), "Example")
    return left.groupBy("conv_id").agg(F.count("*").alias("n"))


def shared_learnings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("project"), (F.col("c_nationkey") % 5).alias("workspace"), F.when(F.col("c_custkey") % 2 == 0, "validated").otherwise("proposed").alias("status"), F.concat(F.col("c_mktsegment"), (F.col("c_custkey") % 10).cast("string")).alias("statement"))
    projects = table(spark, sf, "nation").select(F.col("n_nationkey").alias("project"), (F.col("n_nationkey") % 5).alias("workspace"))
    return c.share(rows, projects)


def version_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two changes for every third lineage, written as its next version."""
    own = items(spark, sf).select("lineage", "version", "title")
    changes = own.select("lineage").distinct().where("lineage % 3 = 0").withColumn("title", F.lit("edited"))
    return m.apply_versions(own, changes).groupBy("lineage").agg(F.max("version").alias("version"), F.max_by("title", "version").alias("title"))


def version_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What every version of an item changed in its fields."""
    return m.version_changes(items(spark, sf), ["kind", "status", "level", "scope", "title"])


def contradiction_report(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "decision").otherwise("fact").alias("kind"), F.when(F.col("p_partkey") % 3 == 0, "proposed").otherwise("validated").alias("status"), F.col("p_size").alias("at"), F.lit(0.5).alias("confidence"))
    edges = table(spark, sf, "part").where("p_partkey % 10 <> 9").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return m.cluster_report(own, edges)


_FUNCTIONS = (kind_families, resolved_versions, provenance_rollup, provenance_floor, created_items, supersede_versions, obsolete_statements, short_term_expiry, memory_consolidation, purge_copies, conflict_list, outdated_since_snapshot, decision_trail, bulk_triage, entity_mentions, memory_graph, idle_sessions, purged_turns, shared_learnings, version_log, version_changes, contradiction_report)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_FORM = "trim(regexp_replace(replace(strip_accents(lower({0})), 'œ', 'oe'), '\\s+', ' ', 'g'))"
_NAMES = "SELECT n_nationkey AS entity, n_name AS alias FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region UNION ALL VALUES (2000, 'the'), (2001, 'of the'), (2002, 'data set'), (2003, 'le')"
ORACLES = {
    "kind_families": f"WITH {ITEMS} SELECT CASE WHEN kind IN ('fact', 'constraint', 'requirement', 'summary') THEN 'statement' ELSE kind END AS family, count(*) AS n FROM i GROUP BY 1",
    "resolved_versions": f"WITH {ITEMS} SELECT l_partkey, cur.id AS current_id, cur.version AS current_version, cur.status AS current_status FROM (SELECT DISTINCT l_partkey FROM lineitem) JOIN i ON i.id = l_partkey JOIN cur ON cur.lineage = i.lineage",
    "provenance_rollup": f"""WITH {ITEMS}, {PROVENANCE}, j AS (SELECT lineage, trust, source_kind, chunk FROM pv JOIN i ON i.id = pv.item)
      SELECT lineage, ['low', 'medium', 'high'][min(CASE trust WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END)] AS trust, string_agg(DISTINCT source_kind, ',' ORDER BY source_kind) AS kinds, count(DISTINCT chunk) AS n_chunks FROM j GROUP BY 1""",
    "provenance_floor": """SELECT l_orderkey AS item, max(CASE WHEN l_linenumber = 1 THEN l_partkey % 4 WHEN p_size > 5 THEN p_size % 3 ELSE 0 END) AS floor FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "created_items": f"""WITH {ITEMS}, f AS (SELECT l_orderkey, max(p_partkey % 3) AS floor, count(DISTINCT p_partkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
      SELECT id AS item, greatest(level, coalesce(floor, 0)) AS level, CASE WHEN coalesce(n, 0) > 1 THEN 'validated' ELSE 'proposed' END AS status, CASE WHEN scope = 'short_term' THEN CAST(floor(epoch(created_at)) AS BIGINT) + 43200 END AS expires_at FROM i LEFT JOIN f ON l_orderkey = id""",
    "supersede_versions": """WITH v AS (SELECT l_partkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_partkey) AS m FROM lineitem),
      d AS (SELECT l_partkey, count(DISTINCT l_linenumber) - 1 AS edges, max(l_linenumber) - min(l_linenumber) AS steps FROM lineitem GROUP BY 1)
      SELECT v.l_partkey AS document, count(*) FILTER (l_linenumber = m) AS active, count(*) FILTER (l_linenumber < m) AS superseded, any_value(edges) AS edges, CAST(any_value(steps) AS BIGINT) AS steps FROM v JOIN d USING (l_partkey) GROUP BY 1""",
    "obsolete_statements": f"""WITH {ITEMS}, l AS (SELECT l_orderkey AS item, l_suppkey % 2 AS d, l_linenumber AS v FROM lineitem)
      SELECT id AS item FROM i WHERE status = 'proposed' AND title <> '1-URGENT' AND id IN (SELECT item FROM l WHERE d = 1 AND v < 5) AND id NOT IN (SELECT item FROM l WHERE d <> 1 OR v >= 5)""",
    "short_term_expiry": f"""WITH {ITEMS}, x AS (SELECT *, scope = 'short_term' AND status IN ('proposed', 'validated') AND created_at + INTERVAL 12 HOURS <= TIMESTAMP '1997-01-01' AS over FROM i)
      SELECT scope, CASE WHEN over THEN 'obsolete' ELSE status END AS status, count(*) AS n, count(*) FILTER (over) AS expired FROM x GROUP BY 1, 2""",
    "purge_copies": """WITH x AS (SELECT CASE WHEN p_partkey IS NOT NULL THEN '[forgotten]' ELSE l_returnflag || ' ' || l_linestatus END AS excerpt, p_partkey IS NOT NULL AS purged FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 3)
      SELECT excerpt, sha256(excerpt) AS content_hash, count(*) AS n, count(*) FILTER (purged) AS purged FROM x GROUP BY 1, 2""",
    "conflict_list": f"""WITH {ITEMS}, {_EDGES}, o AS (SELECT * FROM cur WHERE status IN ('proposed', 'validated') AND level <= 2), r AS (SELECT i.id AS ref, o.id, (CASE WHEN o.status = 'validated' THEN 1 ELSE 0 END, o.created_at, o.confidence, o.id) AS s FROM i JOIN o USING (lineage))
      SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CASE WHEN x.s > y.s THEN x.id ELSE y.id END AS winner FROM e JOIN r x ON x.ref = e.a JOIN r y ON y.ref = e.b WHERE x.id <> y.id""",
    "outdated_since_snapshot": f"""WITH {ITEMS}, x AS (SELECT i.id AS key, CASE WHEN cur.status IN ('forgotten', 'superseded', 'obsolete') THEN cur.status WHEN cur.id <> i.id THEN 'edited' END AS reason FROM i JOIN cur USING (lineage) WHERE i.id % 3 = 0)
      SELECT key, reason FROM x WHERE reason IS NOT NULL""",
    "decision_trail": """WITH x AS (SELECT CAST(floor(epoch(o_orderdate)) AS BIGINT) AS "at", 'created' AS kind, o_orderstatus AS label, o_orderkey AS item FROM orders UNION SELECT CAST(floor(epoch(l_shipdate)) AS BIGINT), 'shipped', l_linestatus, l_orderkey FROM lineitem)
      SELECT "at", kind, label, item, row_number() OVER (PARTITION BY item ORDER BY "at", kind, label) AS place FROM x""",
    "bulk_triage": f"""WITH {ITEMS}, a AS (SELECT l_orderkey AS item, arg_max(CASE l_linenumber % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'accept' ELSE 'defer' END, (l_linenumber, l_partkey, l_suppkey)) AS action FROM lineitem GROUP BY 1)
      SELECT id AS item, CASE WHEN status = 'proposed' AND action = 'accept' THEN 'validated' WHEN status = 'proposed' AND action = 'reject' THEN 'obsolete' ELSE status END AS status,
        CASE WHEN status <> 'proposed' THEN 'skipped' WHEN action = 'defer' THEN 'deferred' ELSE 'applied' END AS outcome FROM i JOIN a ON a.item = i.id""",
    "entity_mentions": f"""WITH n AS (SELECT DISTINCT entity, {_FORM.format('alias')} AS form FROM ({_NAMES}) AS t(entity, alias)),
      w AS (SELECT doc_id, regexp_extract_all(replace(strip_accents(lower(text)), 'œ', 'oe'), '[a-z0-9#]+') AS w FROM documents),
      g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + k - 1], ' ') AS form FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 1, 1) + 1)) AS s FROM w, (VALUES (1), (2), (3)) AS z(k) WHERE len(w) > 0))
      SELECT DISTINCT doc_id, CAST(entity AS BIGINT) AS entity FROM g JOIN n USING (form)""",
    "memory_graph": f"""WITH {ITEMS}, {_EDGES}, {PROVENANCE}, t AS (SELECT i.id AS ref, cur.id AS node FROM i JOIN cur USING (lineage)),
      g AS (SELECT 'm:' || x.node AS src, 'm:' || y.node AS dst, 'relation' AS type FROM e JOIN t x ON x.ref = e.a JOIN t y ON y.ref = e.b WHERE x.node <> y.node
        UNION SELECT 'm:' || t.node, 'd:' || document, 'source' FROM pv JOIN t ON t.ref = pv.item UNION SELECT 'm:' || t.node, 'e:' || o_orderpriority, 'mention' FROM orders JOIN t ON t.ref = o_orderkey)
      SELECT 'node memory' AS part, count(*) AS n FROM cur UNION ALL SELECT 'node document', count(DISTINCT dst) FROM g WHERE type = 'source' UNION ALL SELECT 'node entity', count(DISTINCT dst) FROM g WHERE type = 'mention'
      UNION ALL SELECT 'edge ' || type, count(*) FROM g GROUP BY type""",
    "idle_sessions": """WITH s AS (SELECT user_id AS session, count(*) AS n, max(ts) AS last FROM events GROUP BY 1), h AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last)) / 3600000000 AS h FROM s)
      SELECT session, n, CAST(floor(epoch_us(last) / 1000000) AS BIGINT) AS last_at, CASE WHEN h >= 12 THEN 'expired' WHEN h >= 6 THEN 'closed' ELSE 'open' END AS state FROM h""",
    "purged_turns": f"SELECT conv_id, count(*) AS n FROM conversations WHERE NOT contains({_FORM.format('text')}, 'example') GROUP BY 1",
    "shared_learnings": """WITH l AS (SELECT c_custkey AS item, c_nationkey AS project, c_nationkey % 5 AS ws, c_custkey % 2 = 0 AS ok, lower(c_mktsegment) || (c_custkey % 10) AS form FROM customer),
      g AS (SELECT ws, form, min(item) AS item, arg_min(project, item) AS origin FROM l WHERE ok GROUP BY 1, 2)
      SELECT g.item, CAST(n_nationkey AS INTEGER) AS project, 'proposed' AS status FROM g JOIN nation ON n_nationkey % 5 = g.ws WHERE n_nationkey <> g.origin AND NOT EXISTS (SELECT 1 FROM l x WHERE x.project = n_nationkey AND x.form = g.form)""",
    "version_log": f"WITH {ITEMS} SELECT lineage, CAST(max(version) + CASE WHEN lineage % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS version, CASE WHEN lineage % 3 = 0 THEN 'edited' ELSE arg_max(title, version) END AS title FROM i GROUP BY lineage",
    "version_changes": f"""WITH {ITEMS}, s AS (SELECT lineage, version, unnest([{{'field': 'kind', 'value': kind}}, {{'field': 'status', 'value': status}}, {{'field': 'level', 'value': CAST(level AS VARCHAR)}},
        {{'field': 'scope', 'value': ['project', 'short_term', 'long_term'][(id % 3) + 1]}}, {{'field': 'title', 'value': title}}]) AS f FROM i),
      c AS (SELECT lineage, version, f.field AS field, lag(f.value) OVER (PARTITION BY lineage, f.field ORDER BY version) AS before, f.value AS after FROM s)
      SELECT lineage, version, field, before, after FROM c WHERE before IS DISTINCT FROM after""",
    "contradiction_report": """WITH p AS (SELECT p_partkey AS id, p_partkey - p_partkey % 10 AS root, p_size % 2 = 0 AS firm_kind, p_partkey % 3 <> 0 AS ok, p_size FROM part),
      e AS (SELECT x.id AS a, x.root, x.firm_kind AND x.ok AND y.firm_kind AND y.ok AS critical FROM p x JOIN p y ON y.id = x.id + 1 AND y.root = x.root),
      v AS (SELECT DISTINCT root, id FROM (SELECT root, a AS id FROM e UNION ALL SELECT root, a + 1 FROM e)),
      n AS (SELECT v.root AS r0, min(v.id) AS root, count(*) AS size, arg_max(v.id, (CASE WHEN ok THEN 1 ELSE 0 END, p_size, v.id)) AS keep FROM v JOIN p USING (id) GROUP BY 1)
      SELECT n.root, size, count(*) AS n_edges, CASE WHEN bool_or(critical) THEN 'critical' ELSE 'review' END AS severity, keep FROM n JOIN e ON e.root = n.r0 GROUP BY 1, 2, 5""",
}
