"""Registered queries: usage analytics, breakdowns, alerts, windows over event time, pages of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import analytics as a
from .common import events, seconds, table

TYPES = ["click", "error", "purchase", "signup", "view", "refund"]


def daily_series(spark: SparkSession, sf: str) -> DataFrame:
    return a.daily_series(events(spark, sf), "ts", "value", F.col("value") > 100)


def totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.min("l_quantity").alias("min_qty"), F.max("l_quantity").alias("max_qty"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return rows.withColumn("returned_share", a.ratio(F.col("returned"), F.col("n")))


def cache_filter_agg(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(k % 2 == 0).alias("hits"), F.round(F.sum(F.when(k % 2 == 0, F.col("value")).otherwise(0.0)), 4).alias("hit_value"), F.round(F.avg(F.when(k > 50, F.col("value"))), 4).alias("avg_high"))


def stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Averages over JSON objects of several stages, in the order they run; the total comes last."""
    timings = F.to_json(F.struct(F.col("l_tax").alias("total"), F.col("l_quantity").alias("retrieve"), F.when(F.col("l_linenumber") > 2, F.col("l_discount")).alias("rerank"), F.col("l_linenumber").alias("other")))
    return a.map_averages(table(spark, sf, "lineitem").select(timings.alias("timings")), "timings", ("understand", "retrieve", "rerank")).select("stage", "n", "avg_value", "place")


def overview_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    one = e.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 4).alias("avg_value"))
    slow = a.percentiles(e.withColumn("all", F.lit(1)), ["all"], "value", {"p95": 0.95}).select(F.round("p95", 4).alias("p95"))
    one = one.withColumn("p95", slow.scalar())
    return one.withColumn("error_rate", a.ratio(F.col("errors"), F.col("events")))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("high_error_rate", "critical", F.col("error_rate") > 0.05), ("slow_p95", "warning", F.col("p95") > 10), ("no_users", "critical", F.col("users") == 0), ("active", "info", F.col("events") > 0)]
    return a.alerts(overview_counts(spark, sf), rules)


def zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return a.zero_filled_counts(table(spark, sf, "events"), "event_type", TYPES)


def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    visible = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return a.top_groups(table(spark, sf, "lineitem"), "l_suppkey", 10, visible)


def by_agent(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"), F.count_distinct("c_custkey").alias("customers"))


def project_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    o = table(spark, sf, "orders").join(who, "o_custkey").groupBy("k").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    counts = [F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "suppliers", "orders", "open")]
    return n.join(c, "k", "left").join(s, "k", "left").join(o, "k", "left").select("n_name", *counts)


def failed_not_retried(spark: SparkSession, sf: str) -> DataFrame:
    return a.not_retried(events(spark, sf), "user_id", "ts", F.col("event_type") == "error").select("event_id", "user_id")


def open_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of which neither end is closed in any of the tables it may name; here numbers of parts and suppliers overlap."""
    edges = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    closed = table(spark, sf, "part").where("p_size <= 5").select(F.col("p_partkey").alias("id"))
    resolved = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"))
    return a.open_edges(edges, "edge", ["src", "dst"], closed.unionByName(resolved)).groupBy("dst").agg(F.count("*").alias("n"))


def impact_counts(spark: SparkSession, sf: str) -> DataFrame:
    impact = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))
    return table(spark, sf, "part").join(impact, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def knowledge_gap_trend(spark: SparkSession, sf: str) -> DataFrame:
    topics = events(spark, sf).where("event_type = 'error'").select((F.col("user_id") % 40).cast("string").alias("key"), F.col("ts").alias("at"), (F.col("user_id") % 7).alias("asker"), F.col("value").alias("score"))
    rows = a.gap_report(topics, F.lit("2024-01-31").cast("timestamp"), 30)
    return rows.select("key", "requests", "askers", seconds(F.col("first_seen")).alias("first_seen"), seconds(F.col("last_seen")).alias("last_seen"), "avg_score", "trend", "severity")


def regression_alert(spark: SparkSession, sf: str) -> DataFrame:
    runs = events(spark, sf).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 4).alias("score"))
    return a.regressions(runs, "event_type", "day", "score", 5.0, 10.0).select("event_type", "day", "score", "reason")


def session_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.sessions(events(spark, sf), "user_id", "ts", "30 minutes")
    return rows.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


def tumbling_day(spark: SparkSession, sf: str) -> DataFrame:
    w = events(spark, sf).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.to_date("w.start").alias("day"), "n", "total")


def sliding_window(spark: SparkSession, sf: str) -> DataFrame:
    w = events(spark, sf).groupBy(F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select(seconds(F.col("w.start")).alias("window_start"), "n")


def turn_recency(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    place = F.row_number().over(w.orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(0.5 + 0.5 * place / F.count("*").over(w), 6).alias("recency"))


def last_n_turns(spark: SparkSession, sf: str) -> DataFrame:
    return a.latest_per_group(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", [F.desc("turn")], 3)


def digest(spark: SparkSession, sf: str) -> DataFrame:
    latest = a.latest_per_group(events(spark, sf).select("event_type", "event_id", "ts"), "event_type", [F.desc("ts"), F.desc("event_id")], 10)
    counts = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return latest.join(counts, "event_type").select("event_type", "event_id", "place", "n")


def page_offset(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a listing with the number of all its rows."""
    orders = table(spark, sf, "orders")
    page = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10).select("o_orderkey", "o_totalprice")
    return page.withColumn("total", orders.agg(F.count("*")).scalar())


def page_keyset(spark: SparkSession, sf: str) -> DataFrame:
    after = F.struct(F.lit("1996-01-01").cast("timestamp_ntz").alias("d"), F.lit(100).cast("long").alias("k"))
    rows = table(spark, sf, "orders").where(F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k")) > after)
    return rows.orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey")


def filtered_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Substring search, a semi-join on a dimension and a range."""
    rich = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    rows = table(spark, sf, "customer").where(F.col("c_name").ilike("%1%") & F.col("c_acctbal").between(0, 5000)).join(rich, "c_nationkey", "left_semi")
    return rows.select("c_custkey", "c_name", "c_mktsegment")


def cost_by_agent(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.sum(F.col("l_quantity").cast("long"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(tokens.alias("tokens")).select("l_returnflag", "tokens", a.cost_estimate(F.col("tokens"), 0.002).cast("string").alias("cost"))


def key_inventory(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    status = a.key_status(k % 5 == 0, F.when(k % 3 == 0, F.lit("2023-01-01").cast("timestamp")), k % 11 == 0, F.lit("2024-01-01").cast("timestamp"))
    made = F.lit("2023-06-01").cast("timestamp") + F.make_interval(hours=(k % 1000 * 7).cast("int"))
    age = a.whole_days(made, F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf, "customer").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min(age).alias("youngest"), F.max(age).alias("oldest"))


def feedback_labels(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels")  # noqa: E741
    ratings = l.select("doc_id", (F.col("doc_id") % 5 + 1).alias("rating"))
    flags = l.where("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "useful").otherwise("outdated").alias("flag"))
    return a.feedback_labels(ratings, flags, l.where("doc_id % 10 = 0"), "doc_id")


def rollup_extension(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: subtotals by rollup."""
    rows = table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows


_FUNCTIONS = (daily_series, totals, cache_filter_agg, stage_latency, overview_counts, alerts, zero_fill, top_sources, by_agent, project_stats, failed_not_retried, open_conflicts, impact_counts, knowledge_gap_trend, regression_alert, session_coalesce, tumbling_day, sliding_window, turn_recency, last_n_turns, digest, page_offset, page_keyset, filtered_listing, cost_by_agent, key_inventory, feedback_labels, rollup_extension)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_OVER = "o AS (SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 4) AS avg_value, round(quantile_cont(value, 0.95), 4) AS p95 FROM events)"
ORACLES = {
    "daily_series": """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(sum(value), 4) AS total, count(*) FILTER (value > 100) AS n_slow FROM events GROUP BY 1),
      c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day)
      SELECT day, coalesce(n, 0) AS n, p50, p95, coalesce(total, 0) AS total, coalesce(n_slow, 0) AS n_slow FROM c LEFT JOIN d USING (day)""",
    "totals": "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS revenue, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, round(avg(l_discount), 6) AS avg_discount, count(*) FILTER (l_returnflag = 'R') AS returned, round(count(*) FILTER (l_returnflag = 'R') / count(*), 4) AS returned_share FROM lineitem",
    "cache_filter_agg": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
      SELECT event_type, count(*) AS n, count(*) FILTER (k % 2 = 0) AS hits, round(sum(CASE WHEN k % 2 = 0 THEN value ELSE 0 END), 4) AS hit_value, round(avg(value) FILTER (k > 50), 4) AS avg_high FROM e GROUP BY 1""",
    "stage_latency": """SELECT 'retrieve' AS stage, count(*) AS n, round(avg(l_quantity), 4) AS avg_value, CAST(1 AS BIGINT) AS place FROM lineitem UNION ALL SELECT 'rerank', count(*), round(avg(l_discount), 4), 2 FROM lineitem WHERE l_linenumber > 2
      UNION ALL SELECT 'other', count(*), round(avg(l_linenumber), 4), 3 FROM lineitem UNION ALL SELECT 'total', count(*), round(avg(l_tax), 4), 4 FROM lineitem""",
    "overview_counts": f"WITH {_OVER} SELECT events, users, errors, avg_value, p95, round(errors / events, 4) AS error_rate FROM o",
    "alerts": f"""WITH {_OVER}, x AS (SELECT *, round(errors / events, 4) AS rate FROM o)
      SELECT 'high_error_rate' AS alert, 'critical' AS severity, CAST(0 AS BIGINT) AS place FROM x WHERE rate > 0.05 UNION ALL SELECT 'slow_p95', 'warning', 1 FROM x WHERE p95 > 10
      UNION ALL SELECT 'no_users', 'critical', 0 FROM x WHERE users = 0 UNION ALL SELECT 'active', 'info', 2 FROM x WHERE events > 0""",
    "zero_fill": "WITH t(event_type) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund')) SELECT event_type, count(event_id) AS n FROM t LEFT JOIN events USING (event_type) GROUP BY 1",
    "top_sources": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10",
    "by_agent": "SELECT n_name, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price, count(DISTINCT c_custkey) AS customers FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "project_stats": "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) AS orders, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = 'O') AS open FROM nation",
    "failed_not_retried": "SELECT event_id, user_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.ts > e.ts)",
    "open_conflicts": "SELECT l_suppkey AS dst, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey IN (l_partkey, l_suppkey) AND p_size <= 5) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey IN (l_partkey, l_suppkey) AND s_acctbal < 0) GROUP BY 1",
    "impact_counts": "SELECT p_partkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
    "knowledge_gap_trend": """WITH t AS (SELECT CAST(user_id % 40 AS VARCHAR) AS key, ts, user_id % 7 AS asker, value FROM events WHERE event_type = 'error'),
      g AS (SELECT key, count(*) AS requests, count(DISTINCT asker) AS askers, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_seen, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen, round(avg(value), 2) AS avg_score, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS r FROM t GROUP BY 1)
      SELECT key, requests, askers, first_seen, last_seen, avg_score, CASE WHEN r >= 2 AND r >= 2 * greatest(requests - r, 1) THEN 'rising' WHEN requests - r >= 2 AND requests - r >= 2 * greatest(r, 1) THEN 'fading' ELSE 'steady' END AS trend,
        CASE WHEN requests >= 5 OR askers >= 3 THEN 'critical' WHEN requests >= 2 THEN 'recurring' ELSE 'isolated' END AS severity FROM g""",
    "regression_alert": """WITH r AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 4) AS score FROM events GROUP BY 1, 2), b AS (SELECT *, lag(score) OVER (PARTITION BY event_type ORDER BY day) AS before FROM r)
      SELECT event_type, day, score, CASE WHEN score < 10 THEN 'floor' ELSE 'drop' END AS reason FROM b WHERE score < 10 OR before - score >= 5""",
    "session_coalesce": """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS b FROM e),
      g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(t) AS started, max(t) AS ended, count(*) AS n FROM g GROUP BY user_id, k""",
    "tumbling_day": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_window": """WITH w AS (SELECT unnest([time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOURS]) AS s FROM events)
      SELECT CAST(epoch(s) AS BIGINT) AS window_start, count(*) AS n FROM w GROUP BY 1""",
    "turn_recency": "SELECT conv_id, turn, round(0.5 + 0.5 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) / count(*) OVER (PARTITION BY conv_id), 6) AS recency FROM conversations",
    "last_n_turns": "SELECT conv_id, turn, role, place FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 3",
    "digest": "SELECT event_type, event_id, place, n FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE place <= 10",
    "page_offset": "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20",
    "page_keyset": "SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-01-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "filtered_listing": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%1%' AND c_acctbal BETWEEN 0 AND 5000 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "cost_by_agent": "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, CAST(CAST(sum(CAST(l_quantity AS BIGINT)) * 0.000002 AS DECIMAL(18, 6)) AS VARCHAR) AS cost FROM lineitem GROUP BY 1",
    "key_inventory": "SELECT CASE WHEN c_custkey % 11 = 0 THEN 'misplaced' WHEN c_custkey % 5 = 0 THEN 'revoked' WHEN c_custkey % 3 = 0 THEN 'expired' ELSE 'active' END AS status, count(*) AS n, min(CAST(floor((214 * 24 - c_custkey % 1000 * 7) / 24) AS BIGINT)) AS youngest, max(CAST(floor((214 * 24 - c_custkey % 1000 * 7) / 24) AS BIGINT)) AS oldest FROM customer GROUP BY 1",
    "feedback_labels": """SELECT doc_id, CAST(coalesce(CASE WHEN doc_id % 10 = 0 THEN 1 END, CASE WHEN doc_id % 8 = 0 THEN 1 WHEN doc_id % 4 = 0 THEN 0 END, CASE WHEN doc_id % 5 + 1 >= 4 THEN 1 WHEN doc_id % 5 + 1 <= 2 THEN 0 END) AS INTEGER) AS label FROM labels
      WHERE doc_id % 10 = 0 OR doc_id % 4 = 0 OR doc_id % 5 + 1 <> 3""",
    "rollup_extension": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
