"""Registered queries on streams of several batches: each delivery is written, taken up by the stream where it stopped, and the results are tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete_path, shared_root
from ..streaming import sessions, windows
from ..streaming.sync import SyncedTable
from .common import table

DELIVERIES = 4


def _delivery(rows: DataFrame, at: str, deliveries: int) -> Column:
    """The delivery of a row: equal stretches of the time that the rows span."""
    low, high = rows.agg(F.min(F.unix_millis(at)), F.max(F.unix_millis(at))).first()
    step = ((high or 0) - (low or 0)) // deliveries + 1
    return F.least(F.floor((F.unix_millis(at) - F.lit(low or 0)) / step), F.lit(deliveries - 1))


def in_deliveries(rows: DataFrame, at: str, run: Callable[[DataFrame], DataFrame], late: str = "1 second", deliveries: int = DELIVERIES) -> DataFrame:
    """What a stream makes of ``rows`` when they come in so many deliveries in order of time, with a restart from the checkpoint after each."""
    spark = rows.sparkSession
    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    number = _delivery(rows, at, deliveries)
    with sessions.rocks_state(spark):  # as all streams here, whether they need lists and timers or not
        for n in range(deliveries):
            rows.where(number == n).write.mode("append").parquet(f"{base}/in")
            made = run(windows.event_stream(spark, f"{base}/in", rows.schema, at, late=late))
            query = made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    out = spark.read.schema(made.schema).parquet(f"{base}/out")
    delete_path(spark, f"{base}/in")
    return out


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as turns of thirteen sessions, of which some rest for longer than twelve hours."""
    minutes = F.col("conv_id") * 56 + F.col("turn") * 2
    return table(spark, sf, "conversations").select((F.col("conv_id") % 13).cast("string").alias("session"), "role", "text", F.timestamp_seconds(1_700_000_000 + minutes * 60).alias("at"))


def session_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that ended by expiry and the last list of each, with their last turn."""
    rows = in_deliveries(_turns(spark, sf), "at", sessions.session_buffers)
    told = F.struct("updated_at", (F.col("state") == "expired").alias("gone"), "n", "expires_at", F.element_at("turns", -1)["text"].alias("text"))
    # A list is told open after each delivery that adds to it and once more when it expires.
    lists = rows.groupBy("session", F.element_at("turns", 1)["at"].alias("started")).agg(F.max(told).alias("t"))
    return lists.select("session", (F.col("started") / 1000).cast("long").alias("started"), F.when(F.col("t.gone"), "expired").otherwise("open").alias("state"), F.col("t.n").alias("n"), (F.col("t.updated_at") / 1000).cast("long").alias("updated_at"), (F.col("t.expires_at") / 1000).cast("long").alias("expires_at"), F.md5("t.text").alias("last_md5"))


def _live(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select((F.col("user_id") % 3).cast("string").alias("project"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    return in_deliveries(events, "at", sessions.live_log)


def live_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The number of every event in its project and the first number that the short log holds after it."""
    return _live(spark, sf).select("project", F.col("event").cast("long").alias("event_id"), "id", "floor")


def live_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Two askers a project, six minutes after an event of each hour's start: what is replayed and whether something is missing."""
    log = _live(spark, sf)
    hours = log.groupBy("project", F.floor(F.col("at") / 3_600_000).alias("hour")).agg(F.min(F.struct("at", "id")).alias("e"))
    asks = hours.select(F.explode(F.array(F.lit(3), F.lit(250))).alias("back"), "project", "hour", "e").select(F.concat_ws(":", "hour", "back").alias("asker"), "project", F.greatest(F.lit(0), F.col("e.id") - F.col("back")).alias("after"), (F.col("e.at") + 360_000).alias("at"))
    wanted, gaps = sessions.replay(log, asks)
    counts = wanted.groupBy("asker", "project").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    return gaps.join(counts, ["asker", "project"], "left").select("asker", "project", "gap", F.coalesce("n", F.lit(0)).alias("n"), "first", "last")


def stream_scrubbed(spark: SparkSession, sf: str) -> DataFrame:
    """Events that wait six hours; an error of their user in that time takes their wording."""
    given = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))

    def scrub(stream: DataFrame) -> DataFrame:
        tombstones = stream.where("event_type = 'error'").select("user_id", F.col("at").alias("forgotten_at"))
        return windows.scrubbed(stream.where("event_type <> 'error'"), tombstones, ["event_id"], "user_id", "at")

    rows = in_deliveries(given, "at", scrub)
    return rows.select("event_id", "forgotten", F.when(F.col("forgotten"), "").otherwise(F.col("event_type")).alias("wording"))


def stream_synced(spark: SparkSession, sf: str) -> DataFrame:
    """A table that follows the events as changes of a day's sync: errors delete, signups are skipped, clicks of little value fail."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "skip").when((F.col("event_type") == "click") & (F.col("value") < 5), "error").otherwise("upsert")
    rows = table(spark, sf, "events").select(
        F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86_400).alias("sync"),
        F.concat_ws("-", "user_id", F.weekday("ts")).alias("external_id"),
        F.col("ts").cast("timestamp").alias("at"),
        op.alias("op"),
        F.col("event_type").alias("content_hash"),
        F.when(op == "error", "unreadable").alias("error"),
    )
    base = f"{shared_root(spark)}/synced-{uuid.uuid4().hex}"
    kept, number = SyncedTable(f"{base}/table", compact_after=3), _delivery(rows, "at", DELIVERIES)
    for n in range(DELIVERIES):
        delivery = rows.where(number == n)
        delivery.write.mode("append").parquet(f"{base}/in")
        kept.follow(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/state")
        kept.apply(delivery, n)  # once more, which changes nothing
    return kept.rows(spark)


QUERIES = {f.__name__: f for f in (session_buffer, live_numbers, live_replay, stream_scrubbed, stream_synced)}
_NUMBERS = """e AS (SELECT CAST(user_id % 3 AS VARCHAR) AS project, event_id, epoch_ms(ts) AS ms FROM events),
g AS (SELECT *, ms - lag(ms) OVER w AS idle FROM e WINDOW w AS (PARTITION BY project ORDER BY ms, event_id)),
r AS (SELECT *, sum(CASE WHEN idle >= 86400000 THEN 1 ELSE 0 END) OVER w AS run, sum(CASE WHEN idle >= 900000 THEN 1 ELSE 0 END) OVER w AS stretch FROM g WINDOW w AS (PARTITION BY project ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, row_number() OVER (PARTITION BY project, run ORDER BY ms, event_id) AS id FROM r),
l AS (SELECT *, greatest(min(id) OVER (PARTITION BY project, run, stretch), id - 199) AS floor FROM n)"""
ORACLES: dict[str, str] = {
    "session_buffer": """WITH t AS (SELECT CAST(conv_id % 13 AS VARCHAR) AS session, coalesce(text, '') AS text, coalesce(role, '') AS role, 1700000000 + (conv_id * 56 + turn * 2) * 60 AS ms FROM conversations),
      g AS (SELECT *, sum(CASE WHEN ms - before >= 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ms, role, text ROWS UNBOUNDED PRECEDING) AS list FROM (SELECT *, lag(ms) OVER (PARTITION BY session ORDER BY ms, role, text) AS before FROM t)),
      k AS (SELECT *, row_number() OVER (PARTITION BY session, list ORDER BY ms DESC, role DESC, text DESC) AS back FROM g),
      s AS (SELECT session, list, min(ms) AS started, max(ms) AS updated_at, count(*) AS n, max(CASE WHEN back = 1 THEN md5(text) END) AS last_md5 FROM k WHERE back <= 500 GROUP BY 1, 2)
      SELECT session, started, CASE WHEN updated_at + 43200 <= (SELECT max(ms) FROM t) - 1 OR list < max(list) OVER (PARTITION BY session) THEN 'expired' ELSE 'open' END AS state, n, updated_at, updated_at + 43200 AS expires_at, last_md5 FROM s""",
    "live_numbers": f"WITH {_NUMBERS} SELECT project, event_id, id, floor FROM l",
    "live_replay": f"""WITH {_NUMBERS}, h AS (SELECT project, CAST(floor(ms / 3600000) AS BIGINT) AS hour, min({{'ms': ms, 'id': id}}) AS e FROM l GROUP BY 1, 2),
      a AS (SELECT hour || ':' || back AS asker, project, greatest(0, e.id - back) AS after, e.ms + 360000 AS ms FROM h, (VALUES (3), (250)) AS b(back)),
      x AS (SELECT asker, project, after, a.ms, max({{'ms': l.ms, 'id': l.id, 'floor': l.floor}}) AS l FROM a JOIN l USING (project) WHERE l.ms <= a.ms GROUP BY 1, 2, 3, 4),
      y AS (SELECT asker, project, after + 1 < l.floor AS gap, greatest(l.floor, after + 1) AS first, l.id AS last FROM x WHERE ms - l.ms < 900000)
      SELECT asker, project, gap, greatest(0, last - first + 1) AS n, CASE WHEN first <= last THEN first END AS first, CASE WHEN first <= last THEN last END AS last FROM y""",
    "stream_scrubbed": """WITH e AS (SELECT * FROM events WHERE event_type <> 'error'), t AS (SELECT * FROM events WHERE event_type = 'error'),
      m AS (SELECT max(ts) - INTERVAL 1 SECOND AS mark FROM events),
      x AS (SELECT event_id, event_type, ts, EXISTS (SELECT 1 FROM t WHERE t.user_id = e.user_id AND t.ts >= e.ts AND t.ts <= e.ts + INTERVAL 6 HOUR) AS forgotten FROM e)
      SELECT event_id, forgotten, CASE WHEN forgotten THEN '' ELSE event_type END AS wording FROM x, m WHERE forgotten OR ts + INTERVAL 6 HOUR < mark""",
    "stream_synced": """WITH c AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS sync, user_id || '-' || (isodow(ts) - 1) AS external_id, ts, event_type AS hash,
        CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'skip' WHEN event_type = 'click' AND value < 5 THEN 'error' ELSE 'upsert' END AS op FROM events),
      w AS (SELECT external_id, sync, max({'at': ts, 'op': op, 'hash': hash}) AS w FROM c WHERE op IN ('upsert', 'delete') GROUP BY 1, 2),
      k AS (SELECT *, w.op AS op, sum(CASE WHEN w.op = 'upsert' THEN 1 ELSE 0 END) OVER (PARTITION BY external_id ORDER BY sync) AS known FROM w),
      l AS (SELECT *, lag(op) OVER (PARTITION BY external_id ORDER BY sync) AS before FROM k WHERE known > 0),
      g AS (SELECT *, min(CASE WHEN op = 'delete' AND before = 'delete' THEN sync END) OVER (PARTITION BY external_id) AS gone FROM l)
      SELECT external_id, CASE WHEN max(gone) IS NOT NULL THEN 'forgotten' WHEN arg_max(op, sync) = 'delete' THEN 'doubted' ELSE 'active' END AS status,
        max({'sync': sync, 'hash': w.hash}) FILTER (op = 'upsert' AND (gone IS NULL OR sync < gone)).hash AS content_hash, max(sync) AS sync FROM g GROUP BY 1""",
}
