"""Registered queries: from a task to served items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answering as w
from ..operators import governance, search, selection
from .common import CANDIDATES, ITEMS, candidates, items, table
from .retrieval import _BM25, _both, _lists, bm25_topk


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as documents of three fields: the title, the text without tags and the address."""
    body = F.regexp_replace(F.regexp_replace("html", "<title>[^<]*</title>", " "), "<[^>]*>", " ")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), body.alias("text"), F.col("url").alias("context"))


def bm25_fields(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25_fields(_pages(spark, sf), table(spark, sf, "benchmark"), "page_id", "item_id")


def hydrated_hits(spark: SparkSession, sf: str) -> DataFrame:
    source = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 4 == 0, "superseded").otherwise("active").alias("status"))
    return w.hydrate(bm25_topk(spark, sf), source, "doc_id").select("item_id", "doc_id", "rnk", "lang")


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Term lists for every benchmark text and, for those with a vector of their number, the vectors near it as dense lists."""
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("item_id"), "embedding")
    dense = search.knn(asked, v.where(w.where_clauses({"label": {"gte": 0, "lt": 5}})), "item_id", "vec_id", "embedding", 10, same_table=False).withColumnRenamed("candidate", "doc_id")
    return w.hybrid(bm25_topk(spark, sf), dense, "item_id", "doc_id").select("item_id", "doc_id", "rrf", "position", "mode")


def filtered_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours among the vectors of even labels."""
    v = table(spark, sf, "embeddings")
    kept = v.where(w.where_clauses({"label": [0, 2, 4, 6, 8]}))
    return search.knn(v.where("vec_id % 50 = 0"), kept, "vec_id", "vec_id", "embedding", 5)


def merged_sources(spark: SparkSession, sf: str) -> DataFrame:
    return w.merge_sources(_lists(spark, sf), "item_id", "doc_id")


def filter_clauses(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {"o_orderstatus": ["F", "O"], "o_totalprice": {"gte": 1000.0, "lt": 150000.0}, "o_orderpriority": "1-URGENT", "o_custkey": None}
    return table(spark, sf, "orders").where(w.where_clauses(wanted)).select("o_orderkey")


def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).withColumn("project", F.col("doc_id") % 5)
    return rows.where(w.in_scope(2, F.col("doc_id") % 3 == 0, F.col("scope"))).select("doc_id", "scope")


def audit_actions(spark: SparkSession, sf: str) -> DataFrame:
    action = F.concat_ws(".", "event_type", (F.col("event_id") % 3).cast("string"))
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(action).alias("action"))
    return rows.where(w.action_matches(F.col("action"), "purchase") | w.action_matches(F.col("action"), "view.1"))


def viewer_reads(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("role:owner"))).otherwise(F.array(F.lit("project:*")))
    rule = w.can_read(F.col("level"), [F.col("acl"), source], F.col("scope"), F.col("subject"), ["project:*", "user:1", "role:viewer"], 2, "1")
    return candidates(spark, sf).select("doc_id", rule.alias("readable"))


def subtopics(spark: SparkSession, sf: str) -> DataFrame:
    return w.decompose(table(spark, sf, "benchmark"), "item_id").select("item_id", "place", "subtopic")


def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Other names for words of the benchmark texts, from titles of the form Name (SHORT), the equivalents of all projects and some of these texts."""
    titles = table(spark, sf, "nation").select(F.concat(F.lit("Data Set "), F.initcap("n_name"), F.lit(" (DS)")).alias("title"))
    given = spark.createDataFrame([("the", "a"), ("data", "records"), ("of the", "from the"), ("and", "as well as"), ("model", "network")], "gram string, alias string")
    every = w.synonyms(spark).unionByName(w.aliases_of_titles(titles).unionByName(given), allowMissingColumns=True)
    return w.expand(table(spark, sf, "benchmark"), every, "item_id")


def iterative_search(spark: SparkSession, sf: str) -> DataFrame:
    docs, tasks = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    find = lambda asked: search.bm25(docs, asked, "doc_id", "item_id", 3)
    return w.rounds(tasks, w.decompose(tasks, "item_id"), find, docs.select("doc_id", "text"), "item_id", "doc_id")


def follow_up_search(spark: SparkSession, sf: str) -> DataFrame:
    hits = bm25_topk(spark, sf)
    more, withheld = w.follow_up(hits, hits.where("rnk <= 3"), "item_id", "doc_id", F.col("doc_id") % 4 != 0, 3)
    return more.select("item_id", "doc_id", F.col("rnk").alias("place")).join(withheld, "item_id")


def request_gap(spark: SparkSession, sf: str) -> DataFrame:
    found, shares = _both(spark, sf)
    before = found.select("item_id", "doc_id", (F.col("rnk") <= 5).alias("included"))
    after = shares.select("item_id", "doc_id", F.when(F.col("doc_id") % 5 == 0, "INCLUDED_PINNED").otherwise("INCLUDED_RELEVANT").alias("reason_code"))
    return w.newly_served(before, after, "item_id", "doc_id")


def anchor_items(spark: SparkSession, sf: str) -> DataFrame:
    own = items(spark, sf).select((F.col("lineage") % 20).alias("project"), F.col("id").alias("item"), "kind", "status", F.col("created_at").alias("at"))
    hits = table(spark, sf, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") % 20).alias("project"), F.col("o_orderkey").alias("item"), F.round(1 / (60 + F.col("o_orderkey") % 100), 6).alias("rrf"))
    return w.anchors(hits, own, "project", "item")


def candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    return w.newest_pool(items(spark, sf).select("id", "kind", "created_at"), "kind", "created_at", "id", 300).groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("lowest"), F.sum("id").alias("ids"))


def relation_candidates(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("other"))
    by = lambda cond, name: lines.where(cond).select("item", "other", F.lit(name).alias("list_name")).distinct()
    return w.relation_candidates(by("l_orderkey % 2 = 0", "dense"), by("l_orderkey % 3 = 0", "bm25"), by("l_orderkey % 5 = 0", "lexical"))


def pinned_items(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"))
    pins = table(spark, sf, "part").where("p_size = 10").select(F.col("p_partkey").alias("item"), F.lit("stored title").alias("title"))
    found = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("item")).distinct()
    return w.with_pins(found, pins, stored, "item")


def profile_sections(spark: SparkSession, sf: str) -> DataFrame:
    gone = w.outside_profile(F.col("candidate_type"), F.col("kind"), F.col("pinned"), ["decisions", "sources", "constraints"])
    return candidates(spark, sf).select("doc_id", w.section_of(F.col("candidate_type"), F.col("kind")).alias("section"), gone.alias("outside"))


def applicable_skills(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    tasks = F.when(k % 4 == 0, F.array(F.lit("dev"), F.lit("plan"))).when(k % 4 == 1, F.array(F.lit("general"))).otherwise(F.array().cast("array<string>"))
    agents = F.when(k % 3 == 0, F.array(F.lit("design"))).otherwise(F.array().cast("array<string>"))
    fits, why = w.applies(tasks, agents, F.when(k % 5 == 0, F.lit(None)).otherwise(F.lit("risk")), F.lit("product"))
    return table(spark, sf, "part").select("p_partkey", fits.alias("fits"), why.alias("why"))


def rebuilt_package(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item"), F.col("l_shipdate").cast("string").alias("title"), F.col("l_returnflag").alias("excerpt"))
    current = table(spark, sf, "part").where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") == 1, "forgotten").otherwise("active").alias("status"), (F.col("p_partkey") % 4).alias("level"))
    return w.rebuild(stored, current, "item", F.col("level") <= 2).groupBy("state", "excerpt").agg(F.count("*").alias("n"), F.count("title").alias("titles"))


def progressive_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = w.teasers(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.md5("teaser").alias("teaser_md5"), "full_tokens")


def feedback_outcome(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    decisions = lines.select(F.col("l_orderkey").alias("request"), F.concat(F.lit("S"), "l_linenumber").alias("citation"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey")).alias("item"))
    flags = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("request"), F.concat(F.lit("S"), F.col("l_linenumber") + F.when(F.col("l_partkey") % 5 == 0, 3).otherwise(0)).alias("citation"), F.when(F.col("l_partkey") % 2 == 0, "outdated").otherwise("useful").alias("flag"))
    unknown, proposals = w.feedback_outcome(flags, decisions)
    return unknown.select("request", "citation", F.lit("unknown").alias("outcome")).unionByName(proposals.select("request", F.col("item").cast("string").alias("citation"), F.lit("proposal").alias("outcome")))


def profile_suggestion(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date"), (F.col("l_suppkey") % 4).alias("kind"), F.concat(F.lit("section"), F.col("l_linenumber")).alias("section"), F.when((F.col("l_suppkey") + F.col("l_linenumber")) % 3 == 0, "irrelevant").alias("flag"))
    ratings = table(spark, sf, "orders").select((F.col("o_custkey") % 4).alias("kind"), (F.col("o_orderkey") % 5 + 1).alias("rating"))
    return w.suggest_profile(lines, ratings, "kind")


def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    value = F.round((F.col("doc_id") % 17) / 17, 4)
    docs = table(spark, sf, "documents")
    base = docs.where("doc_id % 3 <> 0").select("doc_id", value.alias("recall"))
    target = docs.where("doc_id % 5 <> 0").select("doc_id", F.round((F.col("doc_id") % 13) / 13, 4).alias("recall"))
    return w.compare_runs(base, target, "doc_id", "recall")


def eval_cases(spark: SparkSession, sf: str) -> DataFrame:
    own = items(spark, sf).where("kind = 'decision' and status = 'validated'").select("lineage", "created_at", "title")
    newest = own.groupBy("lineage").agg(F.max("created_at").alias("created_at"), F.max("title").alias("title"))
    covered = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("lineage"))
    return w.new_cases(newest, covered, "lineage", "created_at")


def priority_tiers(spark: SparkSession, sf: str) -> DataFrame:
    tier = selection.priority_tier(F.col("candidate_type"), F.col("kind"), F.col("status"), F.col("pinned"))
    cap = selection.item_cap(F.col("candidate_type"), F.col("doc_id") % 9 * 1000 + 500)
    return candidates(spark, sf).select("doc_id", tier.cast("long").alias("tier"), cap.alias("cap"))


def defeated_sources(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    evidence = lines.select((F.col("l_suppkey") % 10).alias("request"), F.col("l_orderkey").cast("string").alias("key"), F.col("l_partkey").alias("chunk")).distinct()
    losers = lines.where("l_returnflag = 'R'").select((F.col("l_suppkey") % 10).alias("request"), F.col("l_orderkey").cast("string").alias("key"), (F.col("l_orderkey") + 1).cast("string").alias("winner")).distinct()
    return selection.defeat_sources(losers, evidence).groupBy("request").agg(F.count("*").alias("chunks"))


def exclusion_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of exclusions of each source kind as one text of a map."""
    from .governing import CONTEXT

    coded = candidates(spark, sf).select("source_kind", governance.verdict(governance.rules(CONTEXT)).alias("code")).where("code is not null").groupBy("source_kind", "code").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "code", F.col("n").cast("string"))))
    return coded.groupBy("source_kind").agg(F.array_join(pairs, ";").alias("summary"))


_FUNCTIONS = (bm25_fields, hydrated_hits, hybrid_search, filtered_knn, merged_sources, filter_clauses, scope_filter, audit_actions, viewer_reads, subtopics, query_expansion, iterative_search, follow_up_search, request_gap, anchor_items, candidate_pool, relation_candidates, pinned_items, profile_sections, applicable_skills, rebuilt_package, progressive_index, feedback_outcome, profile_suggestion, run_comparison, eval_cases, priority_tiers, defeated_sources, exclusion_summary)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_FOLDED = "replace(strip_accents(lower({0})), 'œ', 'oe')"
_STOP = ", ".join(f"'{x}'" for x in tx.STOPWORDS)
_WORD, _ELISION = tx.ELIDED_WORD.replace("'", "''"), tx.ELISION.replace("'", "''")
_STEM = "substr(CASE WHEN length(w) > 4 AND regexp_matches(w, '[sx]$') THEN substr(w, 1, length(w) - 1) ELSE w END, 1, 6)"


def _analysed(column: str) -> str:
    words = f"list_transform(regexp_extract_all({_FOLDED.format(column)}, '{_WORD}'), lambda w: regexp_replace(w, '{_ELISION}', ''))"
    return f"list_transform(list_filter({words}, lambda w: w <> '' AND w NOT IN ({_STOP})), lambda w: {_STEM})"


def _codes() -> str:
    from .governing import _V

    return f"""WITH {CANDIDATES}, {_V}, n AS (SELECT c.source_kind, reason_code, count(*) AS n FROM v JOIN c USING (doc_id) WHERE reason_code IS NOT NULL GROUP BY 1, 2)
      SELECT source_kind, string_agg(reason_code || '=' || n, ';' ORDER BY reason_code || '=' || n) AS summary FROM n GROUP BY 1"""


_COS = "round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 5)"
ORACLES = {
    "bm25_fields": f"""WITH d AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(regexp_replace(html, '<title>[^<]*</title>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS text, url AS context FROM pages),
      f AS (SELECT page_id, 'title' AS field, {_analysed('title')} AS t FROM d UNION ALL SELECT page_id, 'text', {_analysed('text')} FROM d UNION ALL SELECT page_id, 'context', {_analysed('context')} FROM d),
      st AS (SELECT field, count(*) AS n, avg(len(t)) AS a FROM f GROUP BY 1), p AS (SELECT page_id, field, term, len(t) AS dl, count(*) AS tf FROM (SELECT page_id, field, t, unnest(t) AS term FROM f) GROUP BY 1, 2, 3, 4),
      df AS (SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2), q AS (SELECT DISTINCT item_id, unnest({_analysed('text')}) AS term FROM benchmark),
      s AS (SELECT item_id, page_id, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) * CASE field WHEN 'title' THEN 2.0 WHEN 'text' THEN 1.0 ELSE 0.7 END AS s FROM q JOIN p USING (term) JOIN df USING (field, term) JOIN st USING (field) GROUP BY 1, 2, 3),
      b AS (SELECT item_id, page_id, round(max(s) + 0.3 * (sum(s) - max(s)), 6) AS score FROM s GROUP BY 1, 2)
      SELECT item_id, page_id, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) AS rnk FROM b) WHERE rnk <= 10""",
    "hydrated_hits": f"WITH {_BM25} SELECT item_id, doc_id, rnk, lang FROM bm JOIN documents USING (doc_id) WHERE doc_id % 4 <> 0",
    "hybrid_search": f"""WITH {_BM25}, dense AS (SELECT CAST(a.vec_id // 50 AS BIGINT) AS item_id, b.vec_id AS doc_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 50 = 0 AND b.label >= 0 AND b.label < 5),
      k AS (SELECT item_id, doc_id, rnk FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk FROM dense) WHERE rnk <= 10),
      l AS (SELECT item_id, doc_id, rnk, 'lexical' AS l FROM bm UNION ALL SELECT item_id, doc_id, rnk, 'dense' FROM k), m AS (SELECT item_id, CASE WHEN count(DISTINCT l) > 1 THEN 'hybrid' ELSE max(l) END AS mode FROM l GROUP BY 1),
      g AS (SELECT item_id, doc_id, round(sum(1 / (60 + rnk)), 8) AS rrf, min(rnk) AS best FROM l GROUP BY 1, 2)
      SELECT item_id, doc_id, rrf, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, best, doc_id) AS position, mode FROM g JOIN m USING (item_id)""",
    "filtered_knn": f"""WITH s AS (SELECT a.vec_id, b.vec_id AS candidate, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND b.label IN (0, 2, 4, 6, 8))
      SELECT * FROM (SELECT vec_id, candidate, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, candidate) AS rnk FROM s) WHERE rnk <= 5""",
    "merged_sources": f"WITH {_BM25} SELECT item_id, doc_id, max(score) AS score, string_agg(DISTINCT list_name, '+' ORDER BY list_name) AS signals FROM ls GROUP BY 1, 2",
    "filter_clauses": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_totalprice < 150000 AND o_orderpriority = '1-URGENT'",
    "scope_filter": f"WITH {CANDIDATES} SELECT doc_id, scope FROM c WHERE doc_id % 5 = 2 OR (doc_id % 3 = 0 AND scope = 'long_term')",
    "audit_actions": """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_type ELSE event_type || '.' || (event_id % 3) END AS action FROM events)
      SELECT event_id, action FROM e WHERE action = 'purchase' OR action LIKE 'purchase.%' OR action = 'view.1' OR action LIKE 'view.1.%'""",
    "viewer_reads": f"""WITH {CANDIDATES}, x AS (SELECT doc_id, level, scope, subject, acl, CASE WHEN doc_id % 6 = 0 THEN ['role:owner'] ELSE ['project:*'] END AS src FROM c)
      SELECT doc_id, level <= 2 AND (scope <> 'user' OR subject = '1') AND (list_has_any(acl, ['project:*', 'user:1', 'role:viewer']) OR (scope = 'user' AND len(acl) > 0 AND len(list_filter(acl, lambda p: p <> 'user:' || subject)) = 0))
        AND list_has_any(src, ['project:*', 'user:1', 'role:viewer']) AS readable FROM x""",
    "follow_up_search": f"""WITH {_BM25}, f AS (SELECT * FROM bm WHERE rnk > 3), o AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM f WHERE doc_id % 4 <> 0),
      h AS (SELECT item_id, count(*) FILTER (doc_id % 4 = 0) AS withheld FROM f GROUP BY 1) SELECT item_id, doc_id, place, withheld FROM o JOIN h USING (item_id) WHERE place <= 3""",
    "request_gap": f"WITH {_BM25} SELECT item_id, doc_id FROM ov WHERE doc_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM bm WHERE bm.item_id = ov.item_id AND bm.doc_id = ov.doc_id AND bm.rnk <= 5)",
    "anchor_items": f"""WITH {ITEMS}, h AS (SELECT o_custkey % 20 AS project, o_orderkey AS item, round(1 / (60 + o_orderkey % 100), 6) AS rrf FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT project, min(rrf) AS rrf FROM h GROUP BY 1),
      n AS (SELECT lineage % 20 AS project, id AS item, kind, row_number() OVER (PARTITION BY lineage % 20, kind ORDER BY created_at DESC, id) AS n FROM i WHERE (kind = 'decision' AND status IN ('validated', 'superseded')) OR (kind = 'preference' AND status = 'validated'))
      SELECT n.project, n.item, coalesce(t.rrf, 0) AS rrf FROM n LEFT JOIN t USING (project) WHERE n <= CASE kind WHEN 'decision' THEN 20 ELSE 10 END AND n.item NOT IN (SELECT item FROM h)""",
    "candidate_pool": f"WITH {ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, id DESC) AS n FROM i) SELECT kind, count(*) AS n, min(id) AS lowest, CAST(sum(id) AS BIGINT) AS ids FROM n WHERE n <= 300 GROUP BY 1",
    "relation_candidates": """WITH l AS (SELECT l_partkey AS item, l_suppkey AS other, 'dense' AS n FROM lineitem WHERE l_orderkey % 2 = 0 UNION SELECT l_partkey, l_suppkey, 'bm25' FROM lineitem WHERE l_orderkey % 3 = 0 UNION SELECT l_partkey, l_suppkey, 'lexical' FROM lineitem WHERE l_orderkey % 5 = 0)
      SELECT item, other, string_agg(n, '+' ORDER BY n) AS found_by FROM l WHERE item <> other GROUP BY 1, 2""",
    "pinned_items": """WITH p AS (SELECT p_partkey AS item FROM part WHERE p_size = 10), s AS (SELECT p_partkey AS item, p_name AS title FROM part WHERE p_partkey % 7 <> 0)
      SELECT p.item, coalesce(s.title, 'stored title') AS title, CASE WHEN s.item IS NULL THEN 'ghost' ELSE 'pinned' END AS state FROM p LEFT JOIN s USING (item)
      UNION ALL SELECT s.item, s.title, 'found' FROM s WHERE s.item IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AND s.item NOT IN (SELECT item FROM p)""",
    "profile_sections": f"""WITH {CANDIDATES}, s AS (SELECT doc_id, pinned, CASE WHEN candidate_type = 'chunk' THEN 'sources' WHEN candidate_type = 'session' THEN 'session' WHEN kind = 'decision' THEN 'decisions' WHEN kind = 'risk' THEN 'constraints' ELSE 'facts' END AS section FROM c)
      SELECT doc_id, section, section NOT IN ('decisions', 'sources', 'constraints') AND NOT pinned AS outside FROM s""",
    "applicable_skills": """WITH x AS (SELECT p_partkey, p_partkey % 4 = 0 AND p_partkey % 5 <> 0 AS t, p_partkey % 3 = 0 AS a FROM part) SELECT p_partkey, NOT t AND NOT a AS fits, CASE WHEN t THEN 'task' WHEN a THEN 'agent' END AS why FROM x""",
    "rebuilt_package": """WITH x AS (SELECT l_returnflag, CASE WHEN p_partkey IS NULL OR p_size = 1 THEN 'forgotten' WHEN p_partkey % 4 > 2 THEN 'restricted' ELSE 'full' END AS state FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 9 <> 0)
      SELECT state, CASE WHEN state = 'full' THEN l_returnflag END AS excerpt, count(*) AS n, count(*) FILTER (state = 'full') AS titles FROM x GROUP BY 1, 2""",
    "progressive_index": """WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, substr(t, 1, 152) AS head FROM t), b AS (SELECT *, strpos(reverse(head), ' ') AS s, length(head) - strpos(reverse(head), ' ') AS blank FROM h)
      SELECT doc_id, md5(CASE WHEN length(t) <= 152 THEN t ELSE rtrim(CASE WHEN s > 0 AND blank >= 0.8 * 152 THEN substr(head, 1, blank) ELSE head END) || '…' END) AS teaser_md5, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 3.8) AS BIGINT)) END AS full_tokens FROM b""",
    "feedback_outcome": """WITH d AS (SELECT l_orderkey AS r, 'S' || l_linenumber AS c, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey END AS item FROM lineitem),
      f AS (SELECT l_orderkey AS r, 'S' || (l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 3 ELSE 0 END) AS c, l_partkey % 2 = 0 AS old FROM lineitem WHERE l_returnflag = 'R')
      SELECT r AS request, c AS citation, 'unknown' AS outcome FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.r = f.r AND d.c = f.c)
      UNION ALL SELECT DISTINCT f.r, CAST(item AS VARCHAR), 'proposal' FROM f JOIN d ON d.r = f.r AND d.c = f.c WHERE old AND item IS NOT NULL""",
    "profile_suggestion": """WITH p AS (SELECT l_suppkey % 4 AS kind, 'section' || l_linenumber AS section, count(*) AS served, count(*) FILTER ((l_suppkey + l_linenumber) % 3 = 0) AS bad FROM lineitem GROUP BY 1, 2),
      s AS (SELECT kind, sum(bad) / sum(served) AS r, string_agg(CASE WHEN bad >= 3 AND bad / served >= 0.5 THEN section END, ',' ORDER BY section) AS d FROM p GROUP BY 1),
      r AS (SELECT o_custkey % 4 AS kind, count(*) AS n, round(avg(o_orderkey % 5 + 1), 2) AS a FROM orders GROUP BY 1)
      SELECT kind, n AS n_feedback, a AS avg_rating, round(r, 4) AS irrelevant_ratio, CASE WHEN n >= 3 AND r > 0.3 THEN CAST(0.35 AS DOUBLE) END AS min_relevance, CASE WHEN n >= 3 THEN d END AS drop_sections FROM r LEFT JOIN s USING (kind)""",
    "run_comparison": """WITH a AS (SELECT doc_id, round((doc_id % 17) / 17, 4) AS v FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, round((doc_id % 13) / 13, 4) AS v FROM documents WHERE doc_id % 5 <> 0)
      SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.v AS base, b.v AS target, round(b.v - a.v, 4) AS delta FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "eval_cases": f"""WITH {ITEMS}, n AS (SELECT lineage, max(created_at) AS at_, max(title) AS title FROM i WHERE kind = 'decision' AND status = 'validated' GROUP BY 1)
      SELECT lineage, 'What was decided about “' || title || '”?' AS question FROM n WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = lineage AND c_custkey % 2 = 0) ORDER BY at_ DESC, lineage LIMIT 10""",
    "priority_tiers": f"""WITH {CANDIDATES} SELECT doc_id, CAST(CASE WHEN pinned THEN 0 WHEN candidate_type = 'chunk' THEN 6 WHEN candidate_type = 'session' THEN 7 WHEN kind = 'decision' THEN CASE WHEN status = 'validated' THEN 1 ELSE 2 END WHEN kind = 'risk' THEN 3 WHEN kind IN ('fact', 'summary') THEN 4 ELSE 5 END AS BIGINT) AS tier,
      CAST(CASE candidate_type WHEN 'chunk' THEN greatest(100, least(350, floor((doc_id % 9 * 1000 + 500) * 0.06))) WHEN 'session' THEN greatest(50, least(150, floor((doc_id % 9 * 1000 + 500) * 0.03))) ELSE greatest(60, least(200, floor((doc_id % 9 * 1000 + 500) * 0.04))) END AS BIGINT) AS cap FROM c""",
    "defeated_sources": """WITH p AS (SELECT DISTINCT l_suppkey % 10 AS r, l_orderkey AS k, l_partkey AS c FROM lineitem), o AS (SELECT DISTINCT l_suppkey % 10 AS r, l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
      SELECT r AS request, count(DISTINCT c) AS chunks FROM o JOIN p USING (r, k) WHERE NOT EXISTS (SELECT 1 FROM p x WHERE x.r = o.r AND x.k = o.k + 1 AND x.c = p.c) GROUP BY 1""",
    "exclusion_summary": _codes(),
}
