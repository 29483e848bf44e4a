"""Registered queries: ingestion upkeep, index tables, reports, text functions, extension points and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..functions.vectors import embed_with, embedding_input
from ..operators import answering, documents as d, evaluation, lifecycle, search, selection
from ..sources import readers
from ..streaming import windows
from .common import CANDIDATES, candidates, events, table
from .retrieval import _BM25, bm25_topk
from .streams import in_deliveries


def document_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the number of their active chunks."""
    chunks = table(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("chunks"))
    return table(spark, sf, "part").select("p_partkey", "p_brand").join(chunks, "p_partkey", "left").fillna(0, ["chunks"])


def ingestion_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds from order to shipment as the duration of jobs, by status; jobs that end before they start count as 0."""
    jobs = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    micros = F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return jobs.groupBy("o_orderstatus").agg(F.count("*").alias("jobs"), F.round(F.avg(F.greatest(F.lit(0), micros) / 1_000_000), 3).alias("avg_seconds"))


def average_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with the average of their ratings, null without any."""
    ratings = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.round(F.avg(F.col("l_linenumber").cast("double")), 4).alias("rating"))
    return table(spark, sf, "orders").select("o_orderkey").join(ratings, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "rating")


def judge_window(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements of the last seven days by kind: number, average and whether it is low enough for an alert."""
    recent = events(spark, sf).where(F.col("ts") >= F.lit("2024-01-24").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("score"))
    return recent.withColumn("alert", (F.col("n") >= 5) & (F.col("score") < 10.0))


def compliance_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report row for each nation as project: members, items, levels and forgotten documents."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("members"), F.count_if(F.col("c_acctbal") < 0).alias("blocked"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), F.col("o_custkey") == F.col("c_custkey"))
    o = o.groupBy("k").agg(F.count("*").alias("items"), F.max(F.col("o_orderkey") % 4).alias("top_level"), F.count_if(F.col("o_orderkey") % 5 == 4).alias("forgotten"))
    return n.join(c, "k", "left").join(o, "k", "left").select("n_name", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("members", "blocked", "items", "top_level", "forgotten")])


def sorted_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Places in a listing by date with unknown dates last, then by number."""
    when = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate"))
    order = Window.partitionBy("o_orderpriority").orderBy(F.desc_nulls_last("when"), F.asc("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", when.alias("when")).withColumn("place", F.row_number().over(order).cast("long")).select("o_orderkey", "place")


def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of the documents after some of them changed or went, counted by language."""
    docs = table(spark, sf, "documents")
    index = docs.select("doc_id", "lang", F.size(tx.long_words(F.col("text"))).cast("long").alias("dl"))
    changes = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("xx").alias("lang"), F.lit(1).cast("long").alias("dl"), (F.col("doc_id") % 2 == 0).alias("deleted"))
    return readers.upsert_index(index, changes, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("dl").alias("words"))


def index_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed documents of every source there could be, and how many of a list of ids are among them."""
    wanted = spark.range(0, 1000, 7).select(F.col("id").alias("doc_id"))
    docs = table(spark, sf, "documents").where("lang <> 'es'")
    counted = docs.groupBy("source").agg(F.count("*").alias("n"))
    asked = docs.join(wanted, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("asked"))
    every = table(spark, sf, "documents").select("source").distinct()
    return every.join(counted, "source", "left").join(asked, "source", "left").fillna(0, ["n", "asked"])


def regular_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text functions of ingestion: regular text, joined lines, neutral markers and slugs, as digests."""
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.neutralise_markers(text)).alias("neutral_md5"), F.md5(tx.truncate_to_tokens(text, 60)).alias("cut_md5"), tx.slug(F.concat_ws(" ", "lang", "source", "doc_id")).alias("slug"), F.size(tx.logical_lines(text)).cast("long").alias("lines"))


def embedding_inputs(spark: SparkSession, sf: str) -> DataFrame:
    joined = embedding_input(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.lit("about")), F.lit(None).cast("string"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(joined).alias("input_md5"))


def given_embedder(spark: SparkSession, sf: str) -> DataFrame:
    """An embedder from outside: here the lengths of a text and of its longest word."""
    measure = lambda texts: [[float(len(t)), float(max(map(len, t.split()), default=0))] for t in texts]
    return table(spark, sf, "documents").select("doc_id", embed_with(F.col("text"), measure).alias("v")).select("doc_id", F.col("v")[0].alias("size"), F.col("v")[1].alias("longest"))


def meeting_records(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", d.is_meeting(F.col("role"), F.col("text")).alias("meeting"))


def ingest_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.ingest(table(spark, sf, "documents"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("level").alias("level"), F.count_if("quarantined").alias("quarantined"))


def reindex_plan(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("project"), F.when(F.col("l_partkey") % 3 == 0, F.lit("x")).alias("preamble"))
    jobs = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("project"), F.when(F.col("s_suppkey") % 4 == 0, "pending").otherwise("done").alias("status"))
    return d.reindex_plan(chunks, jobs)


def forgotten_documents(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("document"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"), F.lit("active").alias("status"))
    left, stones = d.forget_documents(chunks, table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("document")))
    kept = left.groupBy("status").agg(F.count("*").alias("chunks"), F.count("text").alias("texts"))
    return kept.select(F.col("status").alias("what"), "chunks", "texts").unionByName(stones.select(F.concat(F.lit("stone "), "document").alias("what"), "chunks", F.lit(0).cast("long").alias("texts")))


def salient_names(spark: SparkSession, sf: str) -> DataFrame:
    return d.salient(table(spark, sf, "documents"), "doc_id")


def alias_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks with the other names of the entities they mention."""
    names = spark.createDataFrame([(1, "data"), (1, "dataset"), (2, "the"), (2, "this"), (3, "model"), (3, "of")], "entity long, alias string")
    tasks = table(spark, sf, "benchmark")
    found = lifecycle.mentions(tasks, names, "item_id", "text").join(names, "entity")
    texts = tasks.select("item_id", tx.fold(F.col("text")).alias("low"))
    return found.join(texts, "item_id").where(~F.col("low").contains(F.col("alias"))).select("item_id", "alias").distinct()


def weight_update(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking weights after the labelled documents: two signals of a document move them within their bounds."""
    signals = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("label"), (F.length("text") / 40_000).alias("size"), (F.size(tx.words(F.col("text"))) / (1 + F.length("text"))).alias("density"))
    weights = evaluation.propose_weights(signals, ["size", "density"], [0.6, 0.4])
    return spark.createDataFrame(list(zip(["size", "density"], weights, strict=True)), "signal string, weight double")


def learned_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """Excerpts of the best documents of every benchmark text, for 120 tokens."""
    asked = table(spark, sf, "benchmark").select("item_id", tx.terms(F.col("text")).alias("asked"))
    rows = bm25_topk(spark, sf).where("rnk <= 2").join(table(spark, sf, "documents").select("doc_id", "text", tx.sentences(F.col("text")).alias("sentences")), "doc_id").join(asked, "item_id")
    shaped = rows.select(F.concat_ws(":", "item_id", "doc_id").alias("key"), F.lit(120).alias("allowance"), "text", "sentences", F.transform("sentences", lambda s: tx.overlap(F.col("asked"), tx.terms(s))).alias("overlaps"))
    return selection.compress_learned(shaped).select("key", F.md5("excerpt").alias("excerpt_md5"), F.length("excerpt").cast("long").alias("length"))


def held_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Packages held to their budget after rendering, with the hash of their stable part."""
    rows = bm25_topk(spark, sf).select(F.col("item_id").alias("request"), F.col("rnk").alias("position"), (F.col("doc_id") % 19 == 0).alias("pinned"), (F.col("doc_id") % 90 + 10).alias("tokens"), F.col("doc_id").cast("string").alias("key"), F.lit("x").alias("excerpt"), (F.col("doc_id") % 2 == 0).alias("stable"))
    left = selection.enforce_budget(rows, 200)
    return left.groupBy("request").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens")).join(selection.cache_prefix(left), "request")


def key_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(answering.key_terms(F.col("text")), " ").alias("key_terms"))


def mail_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as mail threads in Markdown."""
    mails = table(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("mail_id"), F.col("role").alias("sender"), F.timestamp_seconds(F.col("turn") * 60).alias("at"), F.col("text").alias("body"))
    return readers.thread_markdown(mails).select("thread_id", F.md5("markdown").alias("markdown_md5"))


def stream_once_per_version(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of every (item, version), also where its repetitions come in later deliveries."""
    marked = lambda stream: windows.once_per_version(stream.select(F.col("user_id").alias("item"), F.col("event_type").alias("version"), "ts"), ["item", "version"])
    return in_deliveries(events(spark, sf), "ts", marked, late="60 days").select("item", "version")


def stream_visible(spark: SparkSession, sf: str) -> DataFrame:
    acl = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("user:1"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("user:2")))
    return in_deliveries(events(spark, sf), "ts", lambda stream: windows.replay_after(windows.visible_to(stream.withColumn("acl", acl), ["user:1"]), 500).select("event_id"))


def stream_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Events for subscribers of a project: by named types, or all types but the opt-in ones."""
    subscriptions = spark.createDataFrame([("a", 0, ["view", "error"]), ("b", 0, []), ("c", 1, ["click"]), ("d", 2, [])], "subscriber string, project long, types array<string>")
    given = lambda stream: windows.fan_out(stream.withColumn("project", F.col("user_id") % 3), subscriptions, ["view"]).select("subscriber", "event_id")
    return in_deliveries(events(spark, sf), "ts", given).groupBy("subscriber").agg(F.count("*").alias("n"))


def stream_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows of a day that hold eight and more events of a user, closed by the watermark."""
    rows = in_deliveries(events(spark, sf), "ts", lambda stream: windows.sliding_bursts(stream, "user_id", "ts"), late="0 seconds")
    return rows.select("user_id", F.unix_seconds("window_start").alias("window_start"), "n")


def change_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A table after a batch of changes: the latest change of a key wins."""
    current = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    batch = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 3 == 0, "delete").otherwise("upsert").alias("op"))
    return windows.upsert(batch, current, "c_custkey", "at")


_FUNCTIONS = (document_summaries, ingestion_durations, average_ratings, judge_window, compliance_report, sorted_listing, index_upsert, index_counts, regular_text, embedding_inputs, given_embedder, meeting_records, ingest_pipeline, reindex_plan, forgotten_documents, salient_names, alias_expansion, weight_update, learned_excerpts, held_budget, key_terms, mail_threads, stream_once_per_version, stream_visible, stream_fan_out, stream_bursts, change_upsert)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_LONG = "regexp_extract_all(replace(strip_accents(lower(text)), 'œ', 'oe'), '[a-z0-9]{3,}')"
_TERMS = "list_transform(list_filter(list_transform(regexp_extract_all(replace(strip_accents(lower(text)), 'œ', 'oe'), '{0}'), lambda w: regexp_replace(w, '{1}', '')), lambda w: (length(w) >= 3 OR regexp_full_match(w, '[0-9]+')) AND w NOT IN ({2})), lambda w: substr(CASE WHEN length(w) > 4 AND regexp_matches(w, '[sx]$') THEN substr(w, 1, length(w) - 1) ELSE w END, 1, 6))".format(tx.ELIDED_WORD.replace("'", "''"), tx.ELISION.replace("'", "''"), ", ".join(f"'{w}'" for w in tx.STOPWORDS))
ORACLES = {
    "document_summaries": "SELECT p_partkey, p_brand, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_linestatus = 'O') AS chunks FROM part",
    "ingestion_durations": "SELECT o_orderstatus, count(*) AS jobs, round(avg(greatest(0, epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000), 3) AS avg_seconds FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "average_ratings": "SELECT o_orderkey, (SELECT round(avg(l_linenumber), 4) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N') AS rating FROM orders",
    "judge_window": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS score, count(*) >= 5 AND round(avg(value), 4) < 10 AS alert FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1",
    "compliance_report": """WITH c AS (SELECT c_nationkey AS k, count(*) AS members, count(*) FILTER (c_acctbal < 0) AS blocked FROM customer GROUP BY 1),
      o AS (SELECT c_nationkey AS k, count(*) AS items, max(o_orderkey % 4) AS top_level, count(*) FILTER (o_orderkey % 5 = 4) AS forgotten FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
      SELECT n_name, coalesce(members, 0) AS members, coalesce(blocked, 0) AS blocked, coalesce(items, 0) AS items, coalesce(top_level, 0) AS top_level, coalesce(forgotten, 0) AS forgotten FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN o ON o.k = n_nationkey""",
    "sorted_listing": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS place FROM orders",
    "index_upsert": f"""WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE len({_LONG}) END AS dl FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0))
      SELECT lang, count(*) AS n, CAST(sum(dl) AS BIGINT) AS words FROM x GROUP BY 1""",
    "index_counts": "SELECT source, count(*) FILTER (lang <> 'es') AS n, count(*) FILTER (lang <> 'es' AND doc_id % 7 = 0 AND doc_id < 1000) AS asked FROM documents GROUP BY 1",
    "embedding_inputs": "SELECT doc_id, md5(array_to_string(list_filter(['Doc ' || doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'about' END, nullif(trim(text), '')], lambda x: x IS NOT NULL), chr(10))) AS input_md5 FROM documents",
    "meeting_records": f"SELECT conv_id, turn, regexp_matches(replace(strip_accents(lower(role || chr(10) || text)), 'œ', 'oe'), '{d.MEETING}') OR regexp_matches(role || chr(10) || text, '{d.MEETING_MARK}') AS meeting FROM conversations",
    "reindex_plan": """SELECT l_suppkey % 50 AS project, count(*) AS missing FROM lineitem WHERE l_partkey % 3 <> 0 AND l_suppkey % 50 NOT IN (SELECT s_suppkey % 50 FROM supplier WHERE s_suppkey % 4 = 0) GROUP BY 1""",
    "forgotten_documents": """WITH x AS (SELECT l_partkey, p_partkey IS NOT NULL AS gone FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size = 7)
      SELECT CASE WHEN gone THEN 'forgotten' ELSE 'active' END AS what, count(*) AS chunks, count(*) FILTER (NOT gone) AS texts FROM x GROUP BY 1 UNION ALL SELECT 'stone ' || l_partkey, count(*), 0 FROM x WHERE gone GROUP BY 1""",
    "alias_expansion": f"""WITH n(entity, alias) AS (VALUES (1, 'data'), (1, 'dataset'), (2, 'the'), (2, 'this'), (3, 'model'), (3, 'of')),
      t AS (SELECT item_id, replace(strip_accents(lower(text)), 'œ', 'oe') AS low FROM benchmark), w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(low, '[a-z0-9#]+')) AS word FROM t),
      m AS (SELECT DISTINCT item_id, entity FROM w JOIN n ON word = alias) SELECT DISTINCT item_id, alias FROM m JOIN n USING (entity) JOIN t USING (item_id) WHERE NOT contains(low, alias)""",
    "given_embedder": r"SELECT doc_id, CAST(length(text) AS DOUBLE) AS size, CAST(coalesce(list_max(list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w))), 0) AS DOUBLE) AS longest FROM documents",
    "mail_threads": r"""WITH b AS (SELECT conv_id, turn, role, regexp_replace(text, '(?s)\n(On .{0,120} wrote:|Le .{0,120} a écrit\s?:|-{2,}\s?(Original Message|Message d''origine)).*\z', '') AS t FROM conversations),
      c AS (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(t, '(?m)^>.*\n?', '', 'g'), '(?s)\n-- \n.*\z', '')) AS t FROM b)
      SELECT conv_id AS thread_id, md5(string_agg('### ' || role || ' — ' || strftime(TIMESTAMP '1970-01-01' + to_seconds(turn * 60), '%Y-%m-%d %H:%M') || chr(10) || t, chr(10) || chr(10) ORDER BY turn)) AS markdown_md5 FROM c GROUP BY 1""",
    "key_terms": f"""WITH t AS (SELECT item_id, {_TERMS} AS t FROM benchmark), e AS (SELECT item_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS at_ FROM t), g AS (SELECT item_id, term, count(*) AS n, min(at_) AS first FROM e GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first) AS place FROM g) SELECT item_id, string_agg(term, ' ' ORDER BY place) AS key_terms FROM r WHERE place <= 24 GROUP BY 1""",
    "held_budget": f"""WITH {_BM25}, x AS (SELECT item_id AS request, rnk, doc_id, doc_id % 19 = 0 AS pinned, doc_id % 90 + 10 AS tokens FROM bm),
      u AS (SELECT *, sum(tokens) OVER (PARTITION BY request ORDER BY CASE WHEN pinned THEN 0 ELSE 1 END, rnk ROWS UNBOUNDED PRECEDING) AS upto FROM x), k AS (SELECT * FROM u WHERE upto <= 200 OR pinned)
      SELECT request, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens, sha256(coalesce(string_agg(CASE WHEN doc_id % 2 = 0 THEN doc_id || chr(31) || 'x' END, chr(30) ORDER BY doc_id || chr(31) || 'x'), '')) AS prefix_hash FROM k GROUP BY 1""",
    "stream_once_per_version": "SELECT DISTINCT user_id AS item, event_type AS version FROM events",
    "stream_visible": "SELECT event_id FROM events WHERE event_id % 3 <> 1 AND event_id > 500",
    "stream_fan_out": """WITH s(subscriber, project, types) AS (VALUES ('a', 0, ['view', 'error']), ('b', 0, []), ('c', 1, ['click']), ('d', 2, []))
      SELECT subscriber, count(*) AS n FROM events JOIN s ON project = user_id % 3 WHERE list_contains(types, event_type) OR (len(types) = 0 AND event_type <> 'view') GROUP BY 1""",
    "stream_bursts": """WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(h AS INTEGER)) AS s FROM events, range(24) AS r(h))
      SELECT user_id, CAST(epoch(s) AS BIGINT) AS window_start, count(*) AS n FROM w WHERE s + INTERVAL 24 HOURS <= (SELECT max(ts) FROM events) GROUP BY 1, 2 HAVING count(*) >= 8""",
    "change_upsert": """WITH l AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p, arg_max(o_orderkey % 3 = 0, (o_orderdate, o_orderkey)) AS gone FROM orders GROUP BY 1)
      SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM l) UNION ALL SELECT o_custkey, p FROM l WHERE NOT gone""",
}
