"""Sliding windows of a stream over deliveries with restarts, against plain counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstack.streaming import sessions, windows

MINUTE = 60_000_000
SCHEMA = "who string, at timestamp"


def deliver(spark, base, deliveries, schema, *args, **options):
    """(rows told, progress of all batches) of ``sliding_bursts`` over deliveries of (who, microseconds)."""
    progress = []
    with sessions.rocks_state(spark):
        for events in deliveries:
            rows = spark.createDataFrame(events, schema.replace("timestamp", "long"))
            rows.withColumn("at", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(f"{base}/in")
            stream = windows.event_stream(spark, f"{base}/in", spark.createDataFrame([], schema).schema, "at", late="0 seconds")
            made = windows.sliding_bursts(stream, "who", "at", *args, **options)
            query = made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            progress += query.recentProgress
    told = spark.read.schema(made.schema).parquet(f"{base}/out")
    return sorted(map(tuple, told.select("who", F.unix_micros("window_start"), "n").collect()), key=str), progress


def counted(deliveries, size, slide, least):
    told, n, mark = [], Counter(), 0
    for events in deliveries:
        for who, at in events:
            for start in range((at - size) // slide * slide + slide, at + 1, slide):
                if start + size > mark:
                    n[who, start] += 1
        before, mark = mark, max([mark, *(at // 1000 * 1000 for _, at in events if at is not None)])
        told += [(who, start, k) for (who, start), k in n.items() if k >= least and before < start + size <= mark]
    return sorted(told, key=str)


@pytest.mark.parametrize("size, slide", [(180, 60), (90, 60)])
def test_windows_are_told_once_and_late_events_count_where_windows_are_open(spark, tmp_path, size, slide):
    rng = random.Random(size)
    deliveries = []
    for n in range(4):
        day = 20_000_000 * MINUTE + n * 600 * MINUTE
        # Whole hours and ends of windows, a key without a value, one that looks like none, and events from up to five hours before.
        events = [(rng.choice(["a", "a", "b", "", None, "é"]), day + rng.choice([rng.randrange(600 * MINUTE), rng.randrange(20) * 30 * MINUTE])) for _ in range(150)]
        events += [(rng.choice(["a", "b", None]), day - rng.randrange(300 * MINUTE)) for _ in range(40)]
        deliveries.append([*events, ("a", day + 600 * MINUTE - 1)])
    wanted = counted(deliveries, size * MINUTE, slide * MINUTE, 5)
    got, _ = deliver(spark, tmp_path, deliveries, SCHEMA, f"{size} minutes", f"{slide} minutes", 5)
    assert got == wanted and {who for who, _, _ in wanted} == {"a", "b", "", None, "é"}


def test_keys_share_a_state_and_keep_their_values(spark, tmp_path):
    big = 2**53
    deliveries = [[(big + k, (k % 3 + 1) * 60 * MINUTE + k) for k in range(7) for _ in range(k)] + [(None, 60 * MINUTE)] * 8, [(0, 9_000 * MINUTE)]]
    got, _ = deliver(spark, tmp_path, deliveries, "who long, at timestamp", "2 hours", "1 hour", 4, groups=2)
    assert got == counted(deliveries, 120 * MINUTE, 60 * MINUTE, 4) and len({who for who, _, _ in got}) == 4


def test_an_event_is_kept_once_and_given_up_with_its_windows(spark, tmp_path):
    day = 1_440 * MINUTE
    deliveries = [[(f"k{k}", day + (k * 37 + i * 211) % 1_440 * MINUTE) for k in range(20) for i in range(10)], [("end", 9 * day)]]
    got, progress = deliver(spark, tmp_path, deliveries, SCHEMA)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert got == counted(deliveries, day, 60 * MINUTE, 8) and got
    assert max(held) <= 200 and held[-1] == 1  # not 24 rows for each of 200 events
