"""Inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


#: Tables of texts, which cost far more to work on than to move.
TEXTS = ("documents", "pages")
#: A table of more splits is never moved to deal it out, however many cores there are.
FEW_SPLITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies; texts in a handful of splits, as one row group is, are dealt row by row to the cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS and rows.rdd.getNumPartitions() < min(FEW_SPLITS, spark.sparkContext.defaultParallelism):
        return rows.repartition(spark.sparkContext.defaultParallelism)
    return rows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def seconds(column) -> F.Column:
    return F.unix_seconds(column.cast("timestamp"))


def lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a versioned log: a user's events are the versions of one item."""
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    status = F.when(F.col("event_type") == "error", "forgotten").when(F.col("event_type") == "view", "proposed").when(F.col("event_type") == "click", "superseded").otherwise("validated")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("lineage"),
        version.cast("long").alias("version"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("valid_from"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("valid_to"),
        status.alias("status"),
        "value",
        "event_id",
    )


LINEAGES = """l AS (SELECT user_id AS lineage, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, ts AS created_at, ts AS valid_from,
  CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 5 DAY END AS valid_to,
  CASE event_type WHEN 'error' THEN 'forgotten' WHEN 'view' THEN 'proposed' WHEN 'click' THEN 'superseded' ELSE 'validated' END AS status, value, event_id FROM events)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as governed candidates, with rights, status and dates derived from their numbers."""
    d = F.col("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(d, F.lit(n)) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 5 < 3, "chunk").when(d % 5 == 3, "memory").otherwise("session").alias("candidate_type"),
        pick(7, "active", "active", "validated", "proposed", "superseded", "obsolete", "forgotten").alias("status"),
        F.when(d % 4 == 0, F.array(F.lit("project:*"))).when(d % 4 == 1, F.array(F.lit("role:owner"))).when(d % 4 == 2, F.array(F.lit("user:1"), F.lit("role:viewer"))).otherwise(F.array().cast("array<string>")).alias("acl"),
        (d % 4).cast("int").alias("level"),
        (d % 11 == 0).alias("quarantined"),
        pick(4, "project", "long_term", "user", "short_term").alias("scope"),
        pick(3, "1", "2", "1").alias("subject"),
        F.when(d % 2 == 0, "wiki").otherwise("mail").alias("source_kind"),
        pick(3, "decision", "fact", "risk").alias("kind"),
        (F.lit("2024-06-30").cast("timestamp") - F.make_interval(days=(d % 400).cast("int"))).alias("date"),
        F.when(d % 13 == 0, F.lit("2024-06-01").cast("timestamp")).alias("valid_to"),
        F.when(d % 17 == 0, F.lit("2024-06-15").cast("timestamp")).alias("expires_at"),
        F.when(d % 2 == 0, F.array(F.lit("wiki"))).otherwise(F.array(F.lit("wiki"), F.lit("mail"))).alias("provenance_kinds"),
        (d % 19 == 0).alias("pinned"),
        ((d % 100) / 100).alias("score"),
    )


CANDIDATES = """c AS (SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 'chunk' WHEN doc_id % 5 = 3 THEN 'memory' ELSE 'session' END AS candidate_type,
  ['active', 'active', 'validated', 'proposed', 'superseded', 'obsolete', 'forgotten'][(doc_id % 7) + 1] AS status,
  CASE doc_id % 4 WHEN 0 THEN ['project:*'] WHEN 1 THEN ['role:owner'] WHEN 2 THEN ['user:1', 'role:viewer'] ELSE [] END AS acl,
  doc_id % 4 AS level, doc_id % 11 = 0 AS quarantined, ['project', 'long_term', 'user', 'short_term'][(doc_id % 4) + 1] AS scope,
  ['1', '2', '1'][(doc_id % 3) + 1] AS subject, CASE WHEN doc_id % 2 = 0 THEN 'wiki' ELSE 'mail' END AS source_kind,
  ['decision', 'fact', 'risk'][(doc_id % 3) + 1] AS kind, TIMESTAMP '2024-06-30' - to_days(CAST(doc_id % 400 AS INTEGER)) AS date,
  CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-06-01' END AS valid_to, CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-06-15' END AS expires_at,
  doc_id % 19 = 0 AS pinned, (doc_id % 100) / 100 AS score FROM documents)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as memory items: a customer's orders are the versions of one lineage."""
    k = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.col("o_custkey").alias("lineage"),
        version.cast("long").alias("version"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        pick(7, "decision", "fact", "constraint", "risk", "preference", "requirement", "summary").alias("kind"),
        pick(5, "validated", "proposed", "superseded", "validated", "obsolete").alias("status"),
        F.pmod(k, F.lit(4)).alias("level"),
        (F.pmod(k, F.lit(10)) / 10).alias("confidence"),
        pick(3, "project", "short_term", "long_term").alias("scope"),
        F.col("o_orderpriority").alias("title"),
    )


ITEMS = """i AS (SELECT o_orderkey AS id, o_custkey AS lineage, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderdate AS created_at,
  ['decision', 'fact', 'constraint', 'risk', 'preference', 'requirement', 'summary'][(o_orderkey % 7) + 1] AS kind, ['validated', 'proposed', 'superseded', 'validated', 'obsolete'][(o_orderkey % 5) + 1] AS status,
  o_orderkey % 4 AS level, (o_orderkey % 10) / 10 AS confidence, ['project', 'short_term', 'long_term'][(o_orderkey % 3) + 1] AS scope, o_orderpriority AS title FROM orders),
cur AS (SELECT * FROM (SELECT *, max(version) OVER (PARTITION BY lineage) AS newest FROM i) WHERE version = newest)"""


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as evidence of items: the part is the document, the supplier its source."""
    trust = F.when(F.col("l_suppkey") % 3 == 0, "low").when(F.col("l_suppkey") % 3 == 1, "medium").otherwise("high")
    kind = F.when(F.col("l_suppkey") % 2 == 0, "wiki").otherwise("mail")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("document"), F.concat_ws(":", "l_partkey", "l_linenumber").alias("chunk"), kind.alias("source_kind"), trust.alias("trust"))


PROVENANCE = """pv AS (SELECT l_orderkey AS item, l_partkey AS document, l_partkey || ':' || l_linenumber AS chunk, CASE WHEN l_suppkey % 2 = 0 THEN 'wiki' ELSE 'mail' END AS source_kind,
  ['low', 'medium', 'high'][(l_suppkey % 3) + 1] AS trust FROM lineitem)"""
