"""A table that a stream of changes keeps up to date: one commit a batch, repeated batches without effect, deletions confirmed by a second sync.

Every change tells the sync it comes from. In a sync the last word on a key counts: an ``upsert`` makes it active, a ``delete`` puts an active row in
doubt, and the ``delete`` of a later sync, with no upsert between, forgets it for good. What is forgotten never comes back under the same key. ``error`` and
``skip`` change nothing and are counted. The table depends on the changes and not on how they fall into batches, as long as no sync overtakes an older
one: a row keeps the state from before its last sync, from which that sync is decided anew if more of it comes.

A batch writes the rows it changes as a folder of its own, then a commit that names all folders in force, the last batch of each source and the cursor.
Readers follow the newest commit, so a batch that dies in between leaves nothing visible and is written again under the same name. After
``compact_after`` folders they become one; the folders it replaces go with the next one. One writer at a time, as a stream is.

Defined cases: changes without key, sync or time are errors; words of an older sync than the row's are stale and skipped; a delete of an unknown key
leaves no row that readers see and no count, but a state without status, so that it also takes back what an earlier batch brought of its sync; of equal times in a sync the upsert, then the larger hash counts; an empty batch is committed and changes no row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete_path, names_in, put_text

#: Fixed value: errors of a batch that are told one by one.
ERROR_SAMPLES = 20
_STATE = "struct<status: string, content_hash: string>"
ROW = f"external_id string, sync long, at timestamp, now {_STATE}, prior {_STATE}, outcomes array<string>, version long"
OUTCOMES = ("created", "updated", "unchanged", "doubted", "forgotten", "skipped")


def _decide(before: Column, word: Column) -> Column:
    """struct<now, outcome> of one sync's word on a row."""
    status, upsert = before["status"], word["op"] == "upsert"
    gone = F.coalesce(status == "forgotten", F.lit(False))
    new = F.when(gone, status).when(upsert, "active").when(status == "doubted", "forgotten").when(status == "active", "doubted")
    content = F.when(~gone & upsert, word["content_hash"]).otherwise(before["content_hash"])
    outcome = (
        F.when(gone, "skipped")
        .when(~upsert, F.when(status.isNull(), "skipped").otherwise(new))
        .when(status.isNull(), "created")
        .when(before["content_hash"].eqNullSafe(word["content_hash"]), "unchanged")
        .otherwise("updated")
    )
    return F.struct(F.struct(new.alias("status"), content.alias("content_hash")).alias("now"), outcome.alias("outcome"))


def _folded(words: Column) -> Column:
    """The row after its words in the order of syncs, from its stored state."""
    none = F.lit(None).cast(_STATE)
    start = F.struct(F.col("sync"), F.col("at"), F.coalesce("now", none).alias("now"), F.coalesce("prior", none).alias("prior"), F.array().cast("array<string>").alias("outcomes"))

    def step(acc: Column, word: Column) -> Column:
        same = F.coalesce(word["sync"] == acc["sync"], F.lit(False))
        stale = F.coalesce((word["sync"] < acc["sync"]) | (same & (word["at"] < acc["at"])), F.lit(False))
        before = F.when(same, acc["prior"]).otherwise(acc["now"])
        made = _decide(before, word)
        taken = F.struct(word["sync"].alias("sync"), word["at"].alias("at"), made["now"].alias("now"), before.alias("prior"), F.concat(acc["outcomes"], F.array(made["outcome"])).alias("outcomes"))
        passed = F.struct(acc["sync"].alias("sync"), acc["at"].alias("at"), acc["now"].alias("now"), acc["prior"].alias("prior"), F.concat(acc["outcomes"], F.array(F.lit("skipped"))).alias("outcomes"))
        return F.when(stale, passed).otherwise(taken)

    return F.aggregate(words, start, step)


class SyncedTable:
    """The table under ``path``; ``apply`` is for foreachBatch, ``rows`` and ``log`` for readers."""

    def __init__(self, path: str, compact_after: int = 16):
        self.path, self.compact_after = path.rstrip("/"), compact_after

    def commit(self, spark: SparkSession) -> dict:
        """The newest commit; before the first one, that of an empty table."""
        names = [n for n in names_in(spark, f"{self.path}/commits") if n.endswith(".json")]
        if not names:
            return {"version": 0, "batches": {}, "cursor": {}, "folders": [], "replaced": []}
        return json.loads(spark.read.text(f"{self.path}/commits/{names[-1]}", wholetext=True).first()[0])

    def _states(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], ROW)
        every = spark.read.schema(ROW).parquet(*[f"{self.path}/{f}" for f in folders])
        # One folder holds a key once.
        return every if len(folders) == 1 else every.groupBy("external_id").agg(F.max_by(F.struct("sync", "at", "now", "prior", "outcomes", "version"), "version").alias("s")).select("external_id", "s.*")

    def rows(self, spark: SparkSession) -> DataFrame:
        """(external_id, status, content_hash, sync) as of the newest commit."""
        return self._states(spark, self.commit(spark)["folders"]).where(F.col("now.status").isNotNull()).select("external_id", "now.status", "now.content_hash", "sync")

    def log(self, spark: SparkSession) -> DataFrame:
        """(version, source, batch, counts, errors, samples) of all commits."""
        counts = ", ".join(f"{o}: long" for o in OUTCOMES)
        schema = f"version long, source string, batch long, fetched long, errors long, counts struct<{counts}>, samples array<struct<external_id: string, error: string>>"
        return spark.read.schema(schema).json(f"{self.path}/commits/*.json")

    def apply(self, changes: DataFrame, batch: int, source: str = "stream") -> bool:
        """Takes a batch of changes (sync, external_id, at, op, content_hash, error) in; False if its source has brought it before."""
        spark = changes.sparkSession
        last = self.commit(spark)
        if last["batches"].get(source, -1) >= batch:
            return False
        version = last["version"] + 1
        whole = F.coalesce(F.col("external_id").isNotNull() & F.col("sync").isNotNull() & F.col("at").isNotNull() & F.col("op").isin("upsert", "delete", "skip"), F.lit(False))
        words = changes.where(whole & (F.col("op") != "skip")).groupBy("external_id", "sync").agg(F.max(F.struct("at", "op", "content_hash")).alias("w"))
        # A list has one entry for each sync of the batch, however many changes a key has.
        said = words.groupBy("external_id").agg(F.array_sort(F.collect_list(F.struct("sync", "w.at", "w.op", "w.content_hash"))).alias("words"))
        held = self._states(spark, last["folders"]).select("external_id", "sync", "at", "now", "prior")
        decided = said.join(held, "external_id", "left").select("external_id", _folded(F.col("words")).alias("s"))
        folder = f"deltas/{version:09d}"
        decided.select("external_id", "s.*", F.lit(version).cast("long").alias("version")).write.mode("overwrite").parquet(f"{self.path}/{folder}")

        facts = changes.agg(F.count("*").alias("fetched"), F.count_if(~whole).alias("errors"), F.count_if(whole & (F.col("op") == "skip")).alias("skips"), F.max("at").cast("string").alias("cursor")).first()
        bad = changes.where(~whole).select(F.col("external_id").cast("string").alias("external_id"), F.coalesce("error", F.lit("incomplete change")).alias("error"))
        samples = [r.asDict() for r in bad.orderBy("external_id", "error").limit(ERROR_SAMPLES).collect()] if facts["errors"] else []
        written = spark.read.schema(ROW).parquet(f"{self.path}/{folder}").where(F.col("now.status").isNotNull()).select(F.explode("outcomes").alias("outcome")).groupBy("outcome").count().collect()
        counts = {o: 0 for o in OUTCOMES} | {r["outcome"]: r["count"] for r in written}
        counts["skipped"] += facts["skips"]

        folders, replaced, drop = [*last["folders"], folder], last["replaced"], []
        if len(folders) > self.compact_after:
            base = f"bases/{version:09d}"
            self._states(spark, folders).write.mode("overwrite").parquet(f"{self.path}/{base}")
            folders, replaced, drop = [base], folders, replaced
        cursor = last["cursor"] | ({source: facts["cursor"]} if facts["cursor"] else {})
        done = {"version": version, "source": source, "batch": batch, "batches": last["batches"] | {source: batch}, "cursor": cursor, "folders": folders, "replaced": replaced}
        put_text(spark, f"{self.path}/commits/{version:09d}.json", json.dumps(done | {"fetched": facts["fetched"], "errors": facts["errors"], "counts": counts, "samples": samples}))
        for name in drop:
            delete_path(spark, f"{self.path}/{name}")
        return True

    def follow(self, stream: DataFrame, checkpoint: str, source: str = "stream") -> None:
        """Takes in all that a stream of changes has to offer now; called again, it goes on where it was."""
        writer = stream.writeStream.foreachBatch(lambda rows, n: self.apply(rows, n, source) and None)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
