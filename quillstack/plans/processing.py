"""Registered queries: duplicates, personal data, sensitivity, injection, chunks, pages, imports, summaries, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as d
from ..operators import duplicates
from ..sources import readers
from ..streaming import windows
from .common import events, seconds, table
from .streams import in_deliveries


def exact_dup(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.exact_duplicates(table(spark, sf, "documents"), "doc_id")


def near_dup_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.jaccard_pairs(table(spark, sf, "documents"), "doc_id")


def near_dup_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The membership that ``near_dup_jaccard`` needs: which documents each id of its pairs stands for."""
    return duplicates.shingle_classes(table(spark, sf, "documents"), "doc_id")


def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.regexp_count(text, F.lit(d.EMAIL)).cast("long").alias("emails"), F.regexp_count(text, F.lit(d.IPV4)).cast("long").alias("addresses"), F.md5(d.redact_simple(text)).alias("redacted_md5"))


def pii_luhn(spark: SparkSession, sf: str) -> DataFrame:
    cards = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(d.CARD), F.lit(0)))).alias("card"))
    return cards.select("doc_id", "card", d.luhn(F.col("card")).alias("valid"))


def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.explode(d.pii_spans(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.type", "s.start", "s.end")


def classify_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    level = d.classify(text, (F.col("doc_id") % 3).cast("int"), F.lit(1), d.has_sensitive(text))
    return table(spark, sf, "documents").select("doc_id", level.cast("int").alias("level"))


def injection_score(spark: SparkSession, sf: str) -> DataFrame:
    invisible, styled, comments = d.hidden_counts(F.col("html"))
    score = d.injection_score(F.col("html"), (invisible + styled + comments) > 0)
    return table(spark, sf, "pages").select("page_id", score.alias("score"), (score >= d.QUARANTINE).alias("quarantined"))


def hidden_text(spark: SparkSession, sf: str) -> DataFrame:
    invisible, styled, comments = d.hidden_counts(F.col("html"))
    return table(spark, sf, "pages").select("page_id", invisible.alias("invisible"), styled.alias("styled"), comments.alias("comments"))


def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return readers.extract_html(table(spark, sf, "pages"), "page_id")


def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return d.chunk(table(spark, sf, "documents"), "doc_id").select("doc_id", "ordinal", "char_start", "char_end", "section", "token_count")


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"), F.size(tx.words(F.col("text"))).cast("long").alias("words"), F.md5(tx.fold(F.col("text"))).alias("folded"))


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "documents").select("lang", F.explode(tx.terms(F.col("text"))).alias("term"))
    return terms.groupBy("lang", "term").agg(F.count("*").alias("n")).where("n >= 50")


def statement_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Documents come from wikis and, every third, from traces of low trust, which are less sure."""
    rows = table(spark, sf, "documents").withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "agent_trace").otherwise("wiki"))
    delta = d.source_delta(F.col("kind"), F.when(F.col("doc_id") % 3 == 0, "low").otherwise("high"))
    return d.statements(rows, "doc_id", delta=delta).select("doc_id", "i", "kind", "confidence")


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return d.session_summary(table(spark, sf, "conversations"))


def ingest_actions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    old = docs.where("doc_id % 4 <> 0").select("doc_id", F.md5("text").alias("content_hash"), F.lit(1).alias("version"), (F.col("doc_id") % 10 == 1).alias("forgotten"))
    new = docs.select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return d.ingest_actions(new, old, "doc_id")


def _sync_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer")
    new = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("external_id"), F.when(F.col("c_custkey") % 5 == 0, F.lit("new")).otherwise(F.col("c_mktsegment")).alias("content_hash"))
    old = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("external_id"), F.col("c_mktsegment").alias("content_hash"))
    return new, old


def sync_actions(spark: SparkSession, sf: str) -> DataFrame:
    return readers.sync_actions(*_sync_sides(spark, sf))


def sync_applied(spark: SparkSession, sf: str) -> DataFrame:
    return readers.apply_sync(*_sync_sides(spark, sf))


def import_mapping(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("Key"), F.col("o_orderpriority").alias("Subject"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Updated_at"), F.concat(F.col("o_orderstatus"), F.lit("; urgent; "), F.col("o_orderstatus")).alias("labels"), F.when(F.col("o_orderkey") % 2 == 0, "Confidentiel").otherwise("public").alias("Niveau"))
    rows = readers.map_records(orders)
    return rows.select("id", "title", seconds(F.col("date")).alias("date"), F.array_join("tags", "|").alias("tags"), F.col("classification").cast("int").alias("classification"))


def trace_export(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), "o_orderstatus")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request_id"), "l_linenumber", "l_partkey")
    flags = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("request_id"), "l_returnflag")
    rows = readers.trace_records(orders, lines, flags)
    return rows.select("request_id", F.coalesce(F.size("decisions"), F.lit(0)).cast("long").alias("decisions"), F.coalesce(F.size("feedback"), F.lit(0)).cast("long").alias("feedback"), F.coalesce(F.aggregate("decisions", F.lit(0).cast("long"), lambda s, x: s + x["l_partkey"]), F.lit(0).cast("long")).alias("parts"))


def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Event-time days that the watermark has closed; the last day may still grow and stays in the state."""
    rows = in_deliveries(events(spark, sf), "ts", lambda stream: windows.daily(stream, "ts", "value"), late="0 seconds")
    return rows.select("day", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of events less than two hours apart that the watermark has closed; what may still grow stays in the state."""
    made = lambda stream: windows.coalesce_served(stream.withColumn("level", F.lit(1)), ["user_id"], "ts", "2 hours")
    return in_deliveries(events(spark, sf), "ts", made, late="0 seconds").select("user_id", F.unix_micros("started").alias("started"), "n")


_FUNCTIONS = (exact_dup, near_dup_jaccard, near_dup_classes, pii_counts, pii_luhn, pii_spans, classify_sensitivity, injection_score, hidden_text, html_extract, html_title, chunk_documents, token_estimate, term_stats, statement_extraction, session_summary, ingest_actions, sync_actions, sync_applied, import_mapping, trace_export, stream_daily, stream_sessions)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_FOLD = "replace(strip_accents(lower(text)), 'œ', 'oe')"
_EMAIL = d.EMAIL
_IP = d.IPV4
ORACLES = {
    "exact_dup": f"""WITH h AS (SELECT doc_id, trim(regexp_replace({_FOLD}, '\\s+', ' ', 'g')) AS t FROM documents), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS kept FROM h) SELECT doc_id, kept FROM f WHERE doc_id <> kept""",
    "near_dup_jaccard": f"""WITH w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[a-z0-9]+') AS w FROM documents),
      s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS s FROM w WHERE len(w) > 0),
      u AS (SELECT min(doc_id) AS id, s FROM s GROUP BY s), f AS (SELECT id, len(s) AS n, unnest(s) AS g FROM u),
      p AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM f x JOIN f y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
      SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM p WHERE c * 100 >= (na + nb - c) * 80""",
    "near_dup_classes": f"""WITH w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[a-z0-9]+') AS w FROM documents),
      s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS s FROM w WHERE len(w) > 0)
      SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM s""",
    "pii_counts": f"""SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}')) AS emails, len(regexp_extract_all(text, '{_IP}')) AS addresses,
      md5(regexp_replace(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'), '{_IP}', '[IP]', 'g')) AS redacted_md5 FROM documents""",
    "pii_luhn": f"""WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{d.CARD}'))) AS card FROM documents), r AS (SELECT doc_id, card, reverse(regexp_replace(card, '[^0-9]', '', 'g')) AS n FROM c)
      SELECT doc_id, card, list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(n[i] AS INTEGER) WHEN CAST(n[i] AS INTEGER) > 4 THEN CAST(n[i] AS INTEGER) * 2 - 9 ELSE CAST(n[i] AS INTEGER) * 2 END)) % 10 = 0 AS valid FROM r""",
    "hidden_text": r"""SELECT page_id, len(regexp_extract_all(html, '[\x{200B}-\x{200F}\x{2060}\x{FEFF}]')) AS invisible, len(regexp_extract_all(html, '(?i)<[a-z0-9]+[^>]*(display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*.?true)[^>]*>')) AS styled,
      len(list_filter(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1), lambda c: length(trim(c)) >= 12)) AS comments FROM pages""",
    "html_title": "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages",
    "token_estimate": f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 3.8) AS BIGINT)) END AS tokens, len(regexp_extract_all({_FOLD}, '[a-z0-9]+')) AS words, md5({_FOLD}) AS folded FROM documents",
    "term_stats": f"""WITH w AS (SELECT lang, regexp_replace(unnest(regexp_extract_all({_FOLD}, '{tx.ELIDED_WORD.replace("'", "''")}')), '{tx.ELISION.replace("'", "''")}', '') AS w FROM documents),
      k AS (SELECT lang, w FROM w WHERE (length(w) >= 3 OR regexp_full_match(w, '[0-9]+')) AND w NOT IN ({', '.join(f"'{x}'" for x in tx.STOPWORDS)}))
      SELECT lang, substr(CASE WHEN length(w) > 4 AND regexp_matches(w, '[sx]$') THEN substr(w, 1, length(w) - 1) ELSE w END, 1, 6) AS term, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) >= 50""",
    "ingest_actions": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'create' WHEN doc_id % 10 = 1 THEN 'refused' WHEN doc_id % 3 <> 0 THEN 'metadata_only' ELSE 'new_version' END AS action,
      CAST(CASE WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 10 = 1 THEN 1 WHEN doc_id % 3 <> 0 THEN 1 ELSE 2 END AS BIGINT) AS version FROM documents""",
    "sync_actions": """SELECT c_custkey AS external_id, CASE WHEN c_custkey % 4 = 0 THEN 'insert' WHEN c_custkey % 3 = 0 THEN 'delete' WHEN c_custkey % 5 = 0 THEN 'update' ELSE 'keep' END AS action FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 <> 0""",
    "sync_applied": """SELECT c_custkey AS external_id, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS content_hash, CASE WHEN c_custkey % 3 = 0 THEN 'forgotten' ELSE 'active' END AS status FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 <> 0""",
    "import_mapping": """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS date, o_orderstatus || '|urgent' AS tags, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS classification FROM orders""",
    "trace_export": """WITH d AS (SELECT l_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
      SELECT o_orderkey AS request_id, coalesce(n, 0) AS decisions, coalesce(r, 0) AS feedback, coalesce(parts, 0) AS parts FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""",
    "stream_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 7200000000 THEN 0 ELSE 1 END AS b FROM e),
      g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM s), x AS (SELECT user_id, min(t) AS started, max(t) AS ended, count(*) AS n FROM g GROUP BY user_id, k)
      SELECT user_id, started, n FROM x WHERE ended + 7200000000 <= (SELECT max(t) FROM e)""",
    "classify_sensitivity": f"""WITH t AS (SELECT doc_id, {_FOLD} AS low, list_filter(regexp_extract_all(text, '{d.CARD}'), lambda c: list_sum(list_transform(range(1, length(regexp_replace(c, '[^0-9]', '', 'g')) + 1), lambda i: CASE
        WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[i] AS INTEGER) WHEN CAST(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[i] AS INTEGER) > 4 THEN CAST(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[i] AS INTEGER) * 2 - 9 ELSE CAST(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[i] AS INTEGER) * 2 END)) % 10 = 0) AS cards FROM documents)
      SELECT doc_id, CAST(greatest(doc_id % 3, 1, CASE WHEN regexp_matches(low, '{d.MARKED_SECRET}') THEN 3 WHEN regexp_matches(low, '{d.MARKED_CONFIDENTIAL}') THEN 2 ELSE 0 END,
        CASE WHEN {' + '.join(f"CASE WHEN regexp_matches(low, '{p}') THEN {w} ELSE 0 END" for p, w in d.TOPICS)} >= 3 THEN 2 ELSE 0 END, CASE WHEN len(cards) > 0 THEN 2 ELSE 0 END) AS INTEGER) AS level FROM t""",
    "injection_score": f"""WITH t AS (SELECT page_id, {_FOLD.replace('text', 'html')} AS low, len(regexp_extract_all(html, '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]')) + len(regexp_extract_all(html, '(?i)<[a-z0-9]+[^>]*(display\\s*:\\s*none|visibility\\s*:\\s*hidden|aria-hidden\\s*=\\s*.?true)[^>]*>'))
        + len(list_filter(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1), lambda c: length(trim(c)) >= 12)) AS hidden FROM pages),
      s AS (SELECT page_id, round(1 - {' * '.join(f"CASE WHEN regexp_matches(low, '{p}') THEN {1 - w} ELSE 1.0 END" for _, p, w in d.INJECTION)} * CASE WHEN hidden > 0 THEN 0.6 ELSE 1.0 END, 4) AS score FROM t) SELECT page_id, CAST(score AS DOUBLE) AS score, score >= 0.6 AS quarantined FROM s""",
    "stream_daily": """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1)
      SELECT * FROM d WHERE day < (SELECT max(day) FROM d)""",
}
