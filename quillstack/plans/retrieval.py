"""Registered queries: search, fusion, reranking, evaluation, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..functions.vectors import feature_hash
from ..operators import evaluation, ranking, search, selection
from ..scratch import Scratch
from .common import table

NOW = "2024-06-30"


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id")


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return search.knn(v.where("vec_id % 50 = 0"), v, "vec_id", "vec_id", "embedding", 10)


def term_overlap_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.term_overlap_rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id", 10)


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return search.lexical_lists(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id")


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    best, shares = _both(spark, sf)
    return best.withColumn("list_name", F.lit("bm25")).unionByName(shares.withColumn("list_name", F.lit("terms")))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuse(_lists(spark, sf), "item_id", "doc_id")


def multi_query_discount(spark: SparkSession, sf: str) -> DataFrame:
    return search.best_of_queries(_lists(spark, sf), "item_id", "doc_id", {"terms": 0.9})


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    fused = rrf_fusion(spark, sf)
    date = F.lit(NOW).cast("timestamp") - F.make_interval(days=(d % 400).cast("int"))
    kind = F.when(d % 3 == 0, "decision").when(d % 3 == 1, "fact").otherwise("preference")
    status = F.when(d % 2 == 0, "validated").otherwise("proposed")
    boost = ranking.type_boost(F.when(d % 5 == 0, "chunk").otherwise("memory"), kind, status)
    raw = ranking.heuristic(F.col("rrf_norm"), (d % 10) / 10, ranking.decay(date, F.lit(NOW)), boost, (d % 4) / 4)
    trusted = ranking.clamp01(raw * ranking.trust_factor(F.when(d % 3 == 0, "low").when(d % 3 == 1, "medium").otherwise("high")))
    return fused.select("item_id", "doc_id", F.round(raw, 6).alias("heuristic"), F.round(trusted, 6).alias("final"))


def heuristic_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("final"), "doc_id"))
    return _scored(spark, sf).withColumn("rnk", rank.cast("long"))


KEYWORDS = [("dev", 1, "of"), ("dev", 1, "in"), ("plan", 2, "the"), ("plan", 2, "and"), ("risk", 3, "de"), ("risk", 3, "la"), ("legal", 4, "der"), ("legal", 4, "und")]


def intent_inference(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), tx.words(F.col("text")).alias("tokens"))
    keywords = spark.createDataFrame(KEYWORDS, "intent string, priority int, keyword string")
    return ranking.infer_intent(turns, "turn_id", "tokens", keywords, "general").withColumn("hits", F.col("hits").cast("long"))


def _best_texts(spark: SparkSession, sf: str, found: DataFrame) -> DataFrame:
    best = found.where("rnk <= 3").join(table(spark, sf, "documents").select("doc_id", tx.long_words(F.col("text")).alias("dw")), "doc_id")
    asked = table(spark, sf, "benchmark").select("item_id", F.array_distinct(tx.long_words(F.col("text"))).alias("qw"))
    return best.join(asked, "item_id")


def _coverage(spark: SparkSession, sf: str, found: DataFrame) -> DataFrame:
    share = F.round(tx.overlap(F.col("qw"), F.col("dw")), 4)
    return _best_texts(spark, sf, found).select("item_id", "doc_id", share.alias("coverage"), (share >= 0.5).alias("covered"))


def query_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _coverage(spark, sf, bm25_topk(spark, sf))


def sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    found = bm25_topk(spark, sf)
    per_doc = _coverage(spark, sf, found).join(found.select("item_id", "doc_id", "score"), ["item_id", "doc_id"])
    rows = per_doc.groupBy("item_id").agg(F.max("coverage").alias("term_coverage"), F.avg(F.col("covered").cast("double")).alias("topic_coverage"), F.least(F.lit(1.0), F.avg("score") / 100).alias("relevance"), F.count_if(~F.col("covered")).alias("missing"))
    return ranking.sufficiency(rows, "item_id")


def freshness_decay(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    now = F.lit("2024-02-01").cast("timestamp")
    return table(spark, sf, "events").select("event_id", F.round(ranking.decay(ts, now), 6).alias("freshness"), F.floor(ranking.age_days(ts, now)).alias("age"))


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What BM25 found, and what is expected: the three documents with most of the query's terms."""
    found, shares = _both(spark, sf)
    return found, shares.where("rnk <= 3").select("item_id", "doc_id")


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.recall_at_k(*_judged(spark, sf), "item_id", "doc_id", 5)


def ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.ndcg_at_k(*_judged(spark, sf), "item_id", "doc_id", 5)


def golden_replay(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.replay(recall_at_k(spark, sf))


def citation_faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    answer = F.concat(F.lit("see [S"), (d % 5).cast("string"), F.lit("] and [S"), (d % 7).cast("string"), F.lit("]"))
    answers = table(spark, sf, "documents").select("doc_id", F.when(d % 9 == 0, F.array().cast("array<string>")).otherwise(tx.citations(answer)).alias("cited"), F.when(d % 2 == 0, F.array(F.lit("S1"), F.lit("S2"), F.lit("S3"))).otherwise(F.array().cast("array<string>")).alias("served"))
    return evaluation.faithfulness(answers, "doc_id")


def judge_sample(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(evaluation.in_sample(F.col("doc_id"), 20)).select("doc_id")


def _request_candidates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = bm25_topk(spark, sf).join(docs, "doc_id")
    top = F.max("score").over(Window.partitionBy("item_id"))
    return rows.select(F.col("item_id").alias("request"), F.col("doc_id").cast("string").alias("key"), (F.col("score") / top).alias("score"), (F.col("doc_id") % 19 == 0).alias("pinned"), F.col("doc_id").alias("at"), F.col("text"), F.col("rnk"))


def _repeats(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("shingles", tx.shingles(tx.words(F.col("text")))).withColumn("embedding", feature_hash(F.col("text"))).withColumn("candidate_type", F.lit("chunk"))
    return selection.near_duplicates(rows.select("request", "key", "pinned", "score", "at", "shingles", "embedding", "candidate_type"))


def near_duplicate_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _repeats(_request_candidates(spark, sf))


def mmr_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = _request_candidates(spark, sf).withColumn("embedding", feature_hash(F.col("text")))
    return selection.mmr(rows.select("request", "key", "score", "embedding"))


def budget_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = _request_candidates(spark, sf).select("request", "key", F.col("rnk").alias("position"), tx.estimate_tokens(F.col("text")).alias("tokens"), F.lit(350).cast("long").alias("cap"), F.lit(20).alias("overhead"), F.when(F.col("pinned"), "pinned").otherwise("sources").alias("section"), F.lit(6).alias("section_overhead"), F.lit(1500).alias("budget"))
    return selection.fill_budget(rows)


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    """Stored contradictions: parts that follow each other in an order, one line returned and the other not, are documents at odds."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    after = line.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"))
    both = line.join(after, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("n")) & ((F.col("l_returnflag") == "R") != (F.col("f") == "R")))
    name = lambda c: F.concat(F.lit("document:"), F.col(c).cast("string"))
    return both.select(name("l_partkey").alias("src"), name("p").alias("dst"))


def _conflicts(rows: DataFrame, relations: DataFrame) -> DataFrame:
    nodes = F.array(F.concat(F.lit("chunk:"), F.col("key")), F.concat(F.lit("document:"), F.col("key")))
    pairs = selection.contradictions_between(rows.select("request", "key", nodes.alias("nodes")), relations)
    judged = rows.select("request", "key", (F.col("at") % 3).cast("int").alias("authority"), F.col("at").cast("double").alias("at"), F.lit(0.5).alias("confidence"), "score")
    return selection.conflict_losers(judged, pairs)


def package_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of a request that a stored relation sets against each other."""
    rows = bm25_topk(spark, sf).select(F.col("item_id").alias("request"), F.col("doc_id").cast("string").alias("key"))
    return selection.contradictions_between(rows.withColumn("nodes", F.array(F.concat(F.lit("document:"), F.col("key")))), _relations(spark, sf))


def conflict_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return _conflicts(_request_candidates(spark, sf), _relations(spark, sf))


def context_package(spark: SparkSession, sf: str) -> DataFrame:
    """The whole answer to every benchmark text: search, conflicts, duplicates, diversity, tiers, budget, excerpts, citations, Markdown."""
    rows = Scratch(spark, "package").keep(_request_candidates(spark, sf), "candidates")
    rows = rows.join(_conflicts(rows, _relations(spark, sf)).select("request", "key"), ["request", "key"], "left_anti")
    gone = _repeats(rows).select("request", "key")
    left = rows.join(gone, ["request", "key"], "left_anti")
    ordered = selection.mmr(left.withColumn("embedding", feature_hash(F.col("text"))).select("request", "key", "score", "embedding"))
    # Pinned documents come first, the others in order of diversity.
    tier = selection.priority_tier(F.lit("chunk"), F.lit(None).cast("string"), F.lit("active"), F.col("pinned"))
    place = F.row_number().over(Window.partitionBy("request").orderBy(tier, "position", "key")).cast("long")
    placed = left.join(ordered, ["request", "key"]).withColumn("position", place)
    budget = placed.select("request", "key", "position", tx.estimate_tokens(F.col("text")).alias("tokens"), selection.item_cap(F.lit("chunk"), F.lit(1500)).alias("cap"), F.lit(20).alias("overhead"), F.lit("sources").alias("section"), F.lit(6).alias("section_overhead"), F.lit(1500).alias("budget"))
    filled = selection.fill_budget(budget).where("included")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("request"), tx.terms(F.col("text")).alias("asked"))
    items = placed.join(filled.select("request", "key", "allowance"), ["request", "key"]).join(asked, "request")
    parts = items.withColumn("sentences", tx.sentences(F.col("text"))).withColumn("overlaps", F.transform("sentences", lambda s: tx.overlap(F.col("asked"), tx.terms(s))))
    shaped = parts.select(F.concat_ws(":", "request", "key").alias("key"), "allowance", "text", "sentences", "overlaps")
    excerpts = selection.compress(shaped).withColumnRenamed("key", "full_key")
    served = items.select("request", "key", "position", F.concat_ws(":", "request", "key").alias("full_key")).join(excerpts, "full_key", "left")
    cited = selection.assign_citations(served.select("request", "key", "position", "excerpt", F.lit("Sources").alias("section"), F.lit(1).alias("section_rank"), F.concat(F.lit("Document "), F.col("key")).alias("title")))
    return selection.render(cited)


TOK = "list_filter(regexp_extract_all(replace(strip_accents(lower(text)), 'œ', 'oe'), '[a-z0-9]+'), lambda w: length(w) >= 3)"
_BM25 = f"""d AS (SELECT doc_id, {TOK} AS t FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({TOK}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.t) / avgdl))), 6) AS score
      FROM q JOIN p USING (term) JOIN dfs USING (term) JOIN d USING (doc_id) CROSS JOIN st GROUP BY 1, 2),
bm AS (SELECT item_id, doc_id, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk FROM s) WHERE rnk <= 10),
qn AS (SELECT item_id, count(*) AS nt FROM q GROUP BY 1),
os AS (SELECT item_id, doc_id, round(count(*) / any_value(nt), 6) AS score FROM q JOIN p USING (term) JOIN qn USING (item_id) GROUP BY 1, 2),
ov AS (SELECT item_id, doc_id, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk FROM os) WHERE rnk <= 10),
ls AS (SELECT *, 'bm25' AS list_name FROM bm UNION ALL SELECT *, 'terms' AS list_name FROM ov),
fr AS (SELECT item_id, doc_id, round(sum(1 / (60 + rnk)), 8) AS rrf, min(rnk) AS best_rank FROM ls GROUP BY 1, 2),
fu AS (SELECT item_id, doc_id, rrf, best_rank, round(rrf / max(rrf) OVER (PARTITION BY item_id), 6) AS rrf_norm,
       row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, best_rank, doc_id) AS position FROM fr)"""
_HEUR = """h0 AS (SELECT item_id, doc_id, greatest(0, least(1, 0.55 * rrf_norm + 0.20 * ((doc_id % 10) / 10) + 0.10 * pow(0.5, (doc_id % 400) / 90) + 0.10 *
  CASE WHEN doc_id % 5 = 0 THEN 0.5 WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 1.0 ELSE (CASE doc_id % 3 WHEN 0 THEN 0.85 WHEN 1 THEN 0.65 ELSE 0.6 END) * (CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.9 END) END
  + 0.05 * ((doc_id % 4) / 4))) AS raw FROM fu),
h AS (SELECT item_id, doc_id, round(raw, 6) AS heuristic, round(greatest(0, least(1, raw * CASE doc_id % 3 WHEN 0 THEN 0.85 WHEN 1 THEN 0.925 ELSE 1.0 END)), 6) AS final FROM h0)"""
_COV = """qd AS (SELECT item_id, list(term) AS qw FROM q GROUP BY 1),
cv AS (SELECT bm.item_id, bm.doc_id, bm.score, round(len(list_intersect(qd.qw, list_distinct(d.t))) / len(qd.qw), 4) AS coverage FROM bm JOIN qd USING (item_id) JOIN d USING (doc_id) WHERE rnk <= 3)"""

QUERIES = {f.__name__: f for f in (bm25_topk, knn_topk, term_overlap_topk, rrf_fusion, multi_query_discount, heuristic_rerank, intent_inference, query_coverage, sufficiency, freshness_decay, recall_at_k, ndcg_at_k, golden_replay, citation_faithfulness, judge_sample, near_duplicate_selection, mmr_selection, budget_fill, package_contradictions, conflict_resolution, context_package)}

ORACLES = {
    "bm25_topk": f"WITH {_BM25} SELECT item_id, doc_id, score, rnk FROM bm",
    "knn_topk": """WITH s AS (SELECT a.vec_id, b.vec_id AS candidate, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 5) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
      SELECT * FROM (SELECT vec_id, candidate, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, candidate) AS rnk FROM s) WHERE rnk <= 10""",
    "term_overlap_topk": f"WITH {_BM25} SELECT item_id, doc_id, score, rnk FROM ov",
    "rrf_fusion": f"WITH {_BM25} SELECT item_id, doc_id, rrf, best_rank, rrf_norm, position FROM fu",
    "multi_query_discount": f"WITH {_BM25} SELECT item_id, doc_id, max(round(score * CASE list_name WHEN 'terms' THEN 0.9 ELSE 1.0 END, 6)) AS score FROM ls GROUP BY 1, 2",
    "heuristic_rerank": f"WITH {_BM25}, {_HEUR} SELECT item_id, doc_id, heuristic, final, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS rnk FROM h",
    "intent_inference": f"""WITH k(intent, priority, keyword) AS (VALUES {', '.join(map(str, KEYWORDS))}),
      t AS (SELECT conv_id * 1000 + turn AS turn_id, regexp_extract_all(replace(strip_accents(lower(text)), 'œ', 'oe'), '[a-z0-9]+') AS w FROM conversations WHERE role = 'user'),
      c AS (SELECT turn_id, intent, count(*) AS hits, min(priority) AS priority FROM (SELECT turn_id, unnest(w) AS keyword FROM t) JOIN k USING (keyword) GROUP BY 1, 2),
      b AS (SELECT turn_id, intent, hits FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY hits DESC, priority) AS r FROM c) WHERE r = 1)
      SELECT t.turn_id, coalesce(intent, 'general') AS intent, coalesce(hits, 0) AS hits FROM t LEFT JOIN b USING (turn_id)""",
    "query_coverage": f"WITH {_BM25}, {_COV} SELECT item_id, doc_id, coverage, coverage >= 0.5 AS covered FROM cv",
    "sufficiency": f"""WITH {_BM25}, {_COV}, sa AS (SELECT item_id, max(coverage) AS tc, avg(CASE WHEN coverage >= 0.5 THEN 1.0 ELSE 0.0 END) AS pc, least(1, avg(score) / 100) AS r, count(*) FILTER (coverage < 0.5) AS missing FROM cv GROUP BY 1),
      sc AS (SELECT item_id, missing, round(0.5 * pc + 0.25 * tc + 0.25 * r, 4) AS score FROM sa)
      SELECT item_id, score, CASE WHEN score >= 0.75 AND missing = 0 THEN 'sufficient' WHEN score >= 0.4 THEN 'partial' ELSE 'insufficient' END AS verdict FROM sc""",
    "freshness_decay": """SELECT event_id, round(pow(0.5, greatest(0, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000 / 90), 6) AS freshness,
      CAST(floor(greatest(0, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000) AS BIGINT) AS age FROM events""",
    # One candidate after the other: what is left of the budget and which sections are open go from each to the next.
    "budget_fill": f"""WITH RECURSIVE {_BM25}, x AS (SELECT item_id AS request, CAST(doc_id AS VARCHAR) AS key, rnk, doc_id % 19 = 0 AS pin, least(greatest(CASE WHEN length(text) = 0 THEN 0 ELSE CAST(ceil(length(text) / 3.8) AS BIGINT) END, 1), 350) AS want FROM bm JOIN documents USING (doc_id)),
      r(request, key, rnk, lft, op, os, allowance) AS (SELECT DISTINCT request, '', CAST(0 AS BIGINT), CAST(1500 AS BIGINT), false, false, CAST(0 AS BIGINT) FROM x
        UNION ALL SELECT request, key, rnk, lft - CASE WHEN got > 0 THEN cost + got ELSE 0 END, op OR (pin AND got > 0), os OR (NOT pin AND got > 0), got FROM (
          SELECT *, CASE WHEN lft - cost > 0 AND lft - cost >= least(want, 30) THEN least(want, lft - cost) ELSE 0 END AS got FROM (
            SELECT x.request, x.key, x.rnk, x.pin, x.want, r.lft, r.op, r.os, 20 + CASE WHEN (x.pin AND r.op) OR (NOT x.pin AND r.os) THEN 0 ELSE 6 END AS cost FROM x JOIN r ON r.request = x.request AND x.rnk = r.rnk + 1)))
      SELECT request, key, allowance > 0 AS included, allowance FROM r WHERE rnk > 0""",
    "package_contradictions": f"""WITH {_BM25}, x AS (SELECT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE (a.l_returnflag = 'R') <> (b.l_returnflag = 'R'))
      SELECT DISTINCT p.item_id AS request, least(CAST(p.doc_id AS VARCHAR), CAST(q.doc_id AS VARCHAR)) AS a, greatest(CAST(p.doc_id AS VARCHAR), CAST(q.doc_id AS VARCHAR)) AS b
      FROM x JOIN bm p ON p.doc_id = s JOIN bm q ON q.doc_id = t AND q.item_id = p.item_id WHERE p.doc_id <> q.doc_id""",
    "recall_at_k": f"""WITH {_BM25}, e AS (SELECT item_id, doc_id FROM ov WHERE rnk <= 3), f AS (SELECT e.item_id, count(*) AS n_expected, count(bm.doc_id) AS hits FROM e LEFT JOIN bm ON bm.item_id = e.item_id AND bm.doc_id = e.doc_id AND bm.rnk <= 5 GROUP BY 1)
      SELECT item_id, n_expected, round(hits / n_expected, 4) AS recall FROM f""",
    "ndcg_at_k": f"""WITH {_BM25}, e AS (SELECT item_id, doc_id FROM ov WHERE rnk <= 3), f AS (SELECT e.item_id, count(*) AS n, coalesce(sum(1 / log2(bm.rnk + 1)), 0) AS dcg FROM e LEFT JOIN bm ON bm.item_id = e.item_id AND bm.doc_id = e.doc_id AND bm.rnk <= 5 GROUP BY 1)
      SELECT item_id, round(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda r: 1 / log2(r + 1))), 4) AS ndcg FROM f""",
    "golden_replay": f"""WITH {_BM25}, e AS (SELECT item_id, doc_id FROM ov WHERE rnk <= 3), f AS (SELECT e.item_id, round(count(bm.doc_id) / count(*), 4) AS recall FROM e LEFT JOIN bm ON bm.item_id = e.item_id AND bm.doc_id = e.doc_id AND bm.rnk <= 5 GROUP BY 1)
      SELECT count(*) AS queries, count(*) FILTER (recall >= 0.6) AS passed, round(avg(recall), 4) AS mean_recall, CASE WHEN round(avg(recall), 4) >= 0.6 THEN 'pass' ELSE 'fail' END AS verdict FROM f""",
    "citation_faithfulness": """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN [] ELSE list_distinct(['S' || (doc_id % 5), 'S' || (doc_id % 7)]) END AS c, CASE WHEN doc_id % 2 = 0 THEN ['S1', 'S2', 'S3'] ELSE [] END AS s FROM documents)
      SELECT doc_id, round(CASE WHEN len(c) > 0 THEN len(list_intersect(c, s)) / len(c) WHEN len(s) = 0 THEN 1.0 ELSE 0.0 END, 4) AS faithfulness FROM a""",
}
