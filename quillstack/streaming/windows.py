"""Structured Streaming operators. Each takes a streaming frame with event time; run them with any sink and a checkpoint."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

#: Keys of sliding windows share this many states, of which each is a list of panes: key (a place in keys), number, events.
KEY_GROUPS = 16_384
PANES = "keys array<string>, key array<long>, pane array<long>, n array<long>, closed long"
#: Targets of scrubbed events share this many states: the events that wait (and those told, as long as they may be repeated) and the tombstones.
TARGET_GROUPS = 4_096
WAITING = "row array<string>, key array<string>, target array<string>, at array<long>, told array<boolean>, gone array<string>, gone_at array<long>"


def event_stream(spark: SparkSession, path: str, schema: T.StructType, at: str, late: str = "1 hour", files: int | None = None) -> DataFrame:
    """Parquet files as a stream, with the time column as a zoned timestamp and a watermark."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def coalesce_served(events: DataFrame, keys: list[str], at: str, gap: str = "30 seconds") -> DataFrame:
    """One row for events of a group that follow each other within the gap: count, last level and times."""
    w = F.session_window(F.col(at), gap)
    grouped = events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.max("level").alias("level"))
    return grouped.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("closed"), "n", "level")


def daily(events: DataFrame, at: str, value: str) -> DataFrame:
    grouped = events.groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.to_date("w.start").alias("day"), "n", "total")


def sliding_bursts(events: DataFrame, key: str, at: str, size: str = "24 hours", slide: str = "1 hour", least: int = 8, groups: int = KEY_GROUPS) -> DataFrame:
    """Sliding windows that hold ``least`` and more events of a key, once the watermark has passed their end.

    An event is kept once, in the count of a pane of its key (an hour, if windows of whole hours slide by an hour); windows are summed from the
    panes when they close, and a pane is given up with its last window. A late event counts in those of its windows that are still open. Keys
    share a call and its state by hash: a call takes two milliseconds, however few its rows.
    """
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # nulls are a key too
    timed = events.where(F.col(at).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("bucket"), text.alias("key"), F.unix_micros(at).alias("at"), F.session_window(at, size).alias("w"))
    # No window of an event ends later than ``size`` after it; what comes later still goes no further than here.
    timed = timed.select("bucket", "key", "at", F.window_time("w").alias("until"))
    step = _pane_counts(*(pd.Timedelta(t) // pd.Timedelta(microseconds=1) for t in (size, slide)), least)
    bursts = timed.groupBy("bucket").applyInPandasWithState(step, "key string, start long, n long", PANES, "append", "EventTimeTimeout")
    value = F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(events.schema[key].dataType)
    return bursts.select(value.alias(key), F.timestamp_micros("start").alias("window_start"), "n")


def _pane_counts(size: int, slide: int, least: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of ``sliding_bursts`` for the keys of a bucket. Times are numbers of panes, of which windows are whole multiples."""
    width = math.gcd(size, slide)
    size, slide = size // width, slide // width

    def full_windows(key: np.ndarray, pane: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, start, n) of the windows that are large enough; the panes are in order of key and time."""
        if not len(pane):
            return key, pane, n
        shift = key * (pane.max() - pane.min() + 3 * (size + slide)) - pane.min()  # all keys on one line, further apart than windows reach
        line, upto = pane + shift, np.concatenate(([0], np.cumsum(n)))
        first = upto[np.searchsorted(line, line + size)] - upto[:-1] >= least  # no other pane can be the first one of such a window
        starts = (pane[first, None] - size) // slide * slide + slide * np.arange(1, 1 - (-size // slide))
        lined, which = np.unique(starts + shift[first, None], return_index=True)
        total = upto[np.searchsorted(line, lined + size)] - upto[np.searchsorted(line, lined)]
        return tuple(x[total >= least] for x in (np.repeat(key[first], starts.shape[1])[which], starts.ravel()[which], total))

    def step(bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000 // width
        keys, key, pane, n, closed = state.get if state.exists else ([], [], [], [], mark)
        keys, (key, pane, n) = np.array(keys, dtype=object), (np.array(x, dtype=np.int64) for x in (key, pane, n))
        if mark > closed:
            whose, start, total = full_windows(key, pane, n)
            told = (start + size > closed) & (start + size <= mark)
            yield pd.DataFrame({"key": keys[whose[told]], "start": start[told] * width, "n": total[told]})
        if not state.hasTimedOut:
            for some in rows:
                codes, keys = pd.factorize(np.concatenate((keys[key], some["key"].to_numpy(dtype=object))))
                came = some["at"].to_numpy() // width
                pane = np.concatenate((pane, came))
                low, span = pane.min(), pane.max() - pane.min() + 1
                lined, place = np.unique(codes * span + pane - low, return_inverse=True)
                n = np.bincount(place, np.concatenate((n, np.ones_like(came)))).astype(np.int64)
                key, pane = lined // span, lined % span + low
        ends = pane // slide * slide + size  # of the last window of each pane
        key, pane, n, ends = (x[ends > mark] for x in (key, pane, n, ends))
        if not len(pane):
            state.remove()
            return
        held, key = np.unique(key, return_inverse=True)
        state.update((keys[held].tolist(), key.tolist(), pane.tolist(), n.tolist(), mark))
        ripe = full_windows(key, pane, n)[1] + size
        state.setTimeoutTimestamp(-(-int(ripe[ripe > mark].min(initial=ends.max())) * width // 1000) - 1)

    return step


def once_per_version(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of every (item, version) within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def visible_to(events: DataFrame, held: list[str]) -> DataFrame:
    """Events for one subscriber; on the live stream a missing list means that everybody may see it."""
    return events.where(F.col("acl").isNull() | F.arrays_overlap("acl", F.array(*[F.lit(p) for p in held])))


def fan_out(events: DataFrame, subscriptions: DataFrame, opt_in: list[str]) -> DataFrame:
    """(subscriber, event): a listed type, or any but the opt-in types for an empty list. Stream joined with a static table."""
    matched = events.join(subscriptions, "project")
    wanted = F.array_contains("types", F.col("event_type")) | ((F.size("types") == 0) & ~F.col("event_type").isin(*opt_in))
    return matched.where(wanted)


def scrubbed(events: DataFrame, tombstones: DataFrame, keys: list[str], target: str, at: str, bound: str = "6 hours", groups: int = TARGET_GROUPS) -> DataFrame:
    """Events after a wait of ``bound``, with ``forgotten``: whether a tombstone of their target came from their time on within the wait.

    A forgotten event goes on at once, once for all its tombstones, others when nothing more can come for them. Events without a target are
    never forgotten, those without a time never go on. keys: what tells events apart. tombstones: target, time (``forgotten_at``). Events and
    tombstones meet in one keyed state; targets share a call and its state by hash, as a call costs much the same for one row and for hundreds.
    """
    fields = events.schema.fields
    text = lambda names: F.to_json(F.array(*[_as_text(F.col(f.name), f.dataType) for f in fields if f.name in names]))
    bucket = F.pmod(F.xxhash64(target), F.lit(groups)).alias("bucket")
    whose = F.col(target).cast("string").alias("target")
    waits = events.select(F.col(at).alias("time"), bucket, whose, F.unix_micros(at).alias("at"), text(keys).alias("key"), text(events.columns).alias("row"))
    gone = tombstones.where(F.col(target).isNotNull()).select(F.col("forgotten_at").alias("time"), bucket, whose, F.unix_micros("forgotten_at").alias("at"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("row"))
    both = waits.union(gone).where(F.col("at").isNotNull())
    step = _scrubbing(pd.Timedelta(bound) // pd.Timedelta(microseconds=1))
    told = both.groupBy("bucket").applyInPandasWithState(step, "row string, forgotten boolean", WAITING, "append", "EventTimeTimeout")
    told = told.select(F.from_json("row", "array<string>").alias("row"), "forgotten")
    return told.select(*[_from_text(F.get("row", F.lit(i)), f.dataType).alias(f.name) for i, f in enumerate(fields)], "forgotten")


_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _as_text(value: Column, kind: T.DataType) -> Column:
    """A value as text from which ``_from_text`` makes the same value again."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(value.alias("v")), _MICROS)
    return value.cast("string")


def _from_text(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    if isinstance(kind, T.BinaryType):
        return F.unbase64(text)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, T.StructType([T.StructField("v", kind)]), _MICROS)["v"]
    return text.cast(kind)


def _scrubbing(bound: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of ``scrubbed`` for the targets of a bucket. Times are microseconds."""

    def step(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        row, key, target, at, told, gone, gone_at = state.get if state.exists else ([], [], [], [], [], [], [])
        row, key, target, gone = (np.array(x, dtype=object) for x in (row, key, target, gone))
        at, told, gone_at = np.array(at, dtype=np.int64), np.array(told, dtype=bool), np.array(gone_at, dtype=np.int64)
        came = [] if state.hasTimedOut else list(frames)
        if came:
            new = pd.concat(came).sort_values("at", kind="stable")
            dead, live = new[new["row"].isna()], new[new["row"].notna()]
            gone, gone_at = np.r_[gone, dead["target"].to_numpy(dtype=object)], np.r_[gone_at, dead["at"].to_numpy()]
            row, key, target = (np.r_[x, live[c].to_numpy(dtype=object)] for x, c in ((row, "row"), (key, "key"), (target, "target")))
            at, told = np.r_[at, live["at"].to_numpy()], np.r_[told, np.zeros(len(live), dtype=bool)]
            once = ~pd.Series(key).duplicated().to_numpy()
            row, key, target, at, told = (x[once] for x in (row, key, target, at, told))
        # Each event meets the next tombstone of its target: all are put in order of target and time, events before tombstones.
        codes, n = pd.factorize(np.r_[target, gone])[0], len(row)
        times, dead = np.r_[at, gone_at], np.arange(len(codes)) >= n
        order = np.lexsort((dead, times, codes))
        following = np.minimum.accumulate(np.where(dead[order], np.arange(len(order)), len(order))[::-1])[::-1]
        met = following < len(order)
        here, there = order[met], order[following[met]]
        hit = np.zeros(len(order), dtype=bool)
        hit[here] = (codes[here] == codes[there]) & (codes[here] >= 0) & (times[there] - times[here] <= bound)
        hit = hit[:n] & ~told
        ripe = ~hit & ~told & (at + bound < mark)
        out = hit | ripe
        if out.any():
            yield pd.DataFrame({"row": row[out], "forgotten": hit[out]})
        told = told | hit
        # What is told is kept as long as it may come again, a tombstone as long as an event before it may come.
        left, still = ~ripe & (~told | (at >= mark)), gone_at >= mark
        row, key, target, at, told, gone, gone_at = *(x[left] for x in (row, key, target, at, told)), *(x[still] for x in (gone, gone_at))
        if not len(row) + len(gone):
            state.remove()
            return
        state.update(tuple(x.tolist() for x in (row, key, target, at, told, gone, gone_at)))
        until = int((at[~told] + bound).min()) if (~told).any() else int(np.r_[at, gone_at].max())
        state.setTimeoutTimestamp(until // 1000)

    return step


def replay_after(events: DataFrame, last_id: int) -> DataFrame:
    return events.where(F.col("event_id") > last_id)


def upsert(batch: DataFrame, current: DataFrame, key: str, at: str) -> DataFrame:
    """The table after a batch of changes (op: upsert or delete): the latest change of a key wins. For use in foreachBatch."""
    last = batch.groupBy(key).agg(F.max_by(F.struct("*"), F.col(at)).alias("c")).select("c.*")
    kept = current.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col("op") != "delete").select(*current.columns))
