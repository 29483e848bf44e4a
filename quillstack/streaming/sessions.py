"""Keyed state with event-time timers: session buffers and the live log of a project.

Both are processors for ``transformWithStateInPandas``: a key's state is a list in the state store, changed by each batch and given up by timers,
so a stream that is stopped goes on where it was. Rows of a key are taken in event time within a batch; what is late is dropped by the
watermark. The result depends on event time alone, not on how the rows fall into batches, as long as batches do not overtake each other.

Defined cases: rows without key or time are left out; null role and text become empty; an empty batch gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Turns that a session keeps, entries and seconds of a live log, seconds after which an idle sequence starts anew.
TURNS_KEPT, LOG_SIZE, LOG_SECONDS, SEQUENCE_SECONDS = 500, 200, 900, 86_400
TURN = "role string, text string, at long"
SESSION = "session string, state string, n long, updated_at long, expires_at long, turns array<struct<role: string, text: string, at: long>>"
ENTRY = "project string, id long, event string, kind string, at long, floor long"


class SessionBuffer(StatefulProcessor):
    """A session's last turns. Each turn puts its expiry off; a row ``open`` tells the list after a batch, a row ``expired`` the list that went."""

    def __init__(self, limit: int, ttl_ms: int):
        self.limit, self.ttl = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.turns = handle, handle.getListState("turns", TURN)

    def _row(self, key, state: str, turns: list[tuple]) -> pd.DataFrame:
        last = turns[-1][2]
        listed = [{"role": r, "text": x, "at": t} for r, x, t in turns]
        return pd.DataFrame({"session": [key[0]], "state": [state], "n": [len(turns)], "updated_at": [last], "expires_at": [last + self.ttl], "turns": [listed]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()]
        came = [t for batch in rows for t in zip(batch["role"], batch["text"], (int(x) for x in batch["at_ms"]), strict=True)]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for turn in sorted(came, key=lambda t: (t[2], t[0], t[1])):
            if held and turn[2] >= held[-1][2] + self.ttl:
                yield self._row(key, "expired", held)
                held = []
            held = sorted([*held, turn], key=lambda t: t[2])[-self.limit :]
        if held:
            self.turns.put(held)
            self.handle.registerTimer(held[-1][2] + self.ttl)
            yield self._row(key, "open", held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()]
        if held and expiredTimerInfo.getExpiryTimeInMs() >= held[-1][2] + self.ttl:
            self.turns.clear()
            yield self._row(key, "expired", held)

    def close(self) -> None:
        pass


class LiveLog(StatefulProcessor):
    """Gapless numbers for a project's events and the first number that its short log still holds after each."""

    def __init__(self, size: int, seconds: int, idle: int):
        self.size, self.seconds, self.idle = size, seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "id long, floor long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, floor, at = self.last.get() if self.last.exists() else (0, 1, None)
        out = []
        came = [e for batch in rows for e in zip((int(x) for x in batch["at_ms"]), batch["event"], batch["kind"], strict=True)]
        for time, event, kind in sorted(came):
            if at is not None and time - at >= self.idle * 1000:
                number, floor = 0, 1
            elif at is not None and time - at >= self.seconds * 1000:
                floor = number + 1
            number, at = number + 1, time
            floor = max(floor, number - self.size + 1)
            out.append((key[0], number, event, kind, time, floor))
        if out:
            self.last.update((number, floor, at))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at + self.idle * 1000)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRY.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # An idle sequence is given up, so that projects that went silent hold no state.
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def session_buffers(turns: DataFrame, session: str = "session", at: str = "at", limit: int = TURNS_KEPT, ttl_hours: float = 12) -> DataFrame:
    """``SESSION`` rows of a stream of turns (session, role, text, at) with a watermark on ``at``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.where(F.col(session).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.col(session).cast("string").alias("session"), text("role"), text("text"), F.unix_millis(at).alias("at_ms"), at)
    return rows.groupBy("session").transformWithStateInPandas(SessionBuffer(limit, int(ttl_hours * 3_600_000)), SESSION, "Append", "EventTime")


def live_log(events: DataFrame, project: str = "project", event: str = "event", kind: str = "kind", at: str = "at", size: int = LOG_SIZE, seconds: int = LOG_SECONDS, idle: int = SEQUENCE_SECONDS) -> DataFrame:
    """``ENTRY`` rows of a stream of events with a watermark on ``at``."""
    rows = events.where(F.col(project).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.col(project).cast("string").alias("project"), F.col(event).cast("string").alias("event"), F.col(kind).cast("string").alias("kind"), F.unix_millis(at).alias("at_ms"), at)
    return rows.groupBy("project").transformWithStateInPandas(LiveLog(size, seconds, idle), ENTRY, "Append", "EventTime")


def replay(log: DataFrame, asks: DataFrame, seconds: int = LOG_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(asker, project, id) of the entries after the last one that an asker has, and (asker, project, gap): whether some are no longer held.

    log: ``ENTRY`` rows. asks: asker, project, after, at (milliseconds). The log is gone ``seconds`` after its last entry.
    """
    # Of a sequence that started anew the latest run counts: the last entry before the ask names it. It lies in the ask's own stretch of
    # ``seconds``, where one walk in order of time finds it, or is the last one of the stretch before: no ask meets the whole log.
    stretch = lambda at: F.floor(F.col(at) / (seconds * 1000))
    entries = log.select("project", stretch("at").alias("stretch"), F.struct(F.col("at").alias("e_at"), "id", "floor").alias("e"))
    asked = asks.select("asker", "project", "after", "at").distinct().withColumn("stretch", stretch("at"))
    both = entries.select("project", "stretch", "e", F.col("e.e_at").alias("at")).unionByName(asked.withColumn("ask", F.lit(True)), allowMissingColumns=True)
    walk = Window.partitionBy("project", "stretch").orderBy("at", F.col("ask").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("own", F.max("e").over(walk)).where("ask").select("asker", "project", "after", "at", "stretch", "own")
    before = entries.groupBy("project", (F.col("stretch") + 1).alias("stretch")).agg(F.max("e").alias("before"))
    last = own.join(before, ["project", "stretch"], "left").select("asker", "project", "after", "at", F.coalesce("own", "before").alias("l"))
    last = last.where(F.col("at") - F.col("l.e_at") < seconds * 1000)
    first = F.greatest(F.col("l.floor"), F.col("after") + 1)
    gaps = last.select("asker", "project", (F.col("after") + 1 < F.col("l.floor")).alias("gap"))
    wanted = last.where(first <= F.col("l.id")).select("asker", "project", F.explode(F.sequence(first, F.col("l.id"))).alias("id"))  # at most the log's size
    return wanted, gaps


@contextmanager
def rocks_state(spark: SparkSession):
    """Lists and timers need the store on disk; what the session had set is set again afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
