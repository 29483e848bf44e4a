"""Session buffers and live logs over several deliveries with restarts, against plain lists."""

import random

from pyspark.sql import functions as F

from quillstack.plans.streams import in_deliveries
from quillstack.streaming import sessions


def test_sessions_keep_their_last_turns_and_expire(spark):
    hour = 3600
    given = [("a", "user", f"t{i}", 1_000_000 + i * 60) for i in range(5)] + [("a", None, None, 1_000_000 + 13 * hour), ("b", "user", "x", 1_000_000 + 20 * hour), ("c", "user", "late", 1_000_000 + 40 * hour), (None, "user", "nobody", 1_000_000)]
    rows = spark.createDataFrame(given, "session string, role string, text string, s long").select("session", "role", "text", F.timestamp_seconds("s").alias("at"))
    out = in_deliveries(rows, "at", lambda s: sessions.session_buffers(s, limit=3), deliveries=3).collect()
    told = {(r["session"], r["state"], (r["updated_at"] - 1_000_000_000) // 1000, tuple(t["text"] for t in r["turns"])) for r in out}
    assert told == {
        ("a", "expired", 240, ("t2", "t3", "t4")),  # thirteen hours later, in the same delivery, a new list begins
        ("a", "open", 13 * hour, ("",)),
        ("b", "open", 20 * hour, ("x",)),
        ("a", "expired", 13 * hour, ("",)),  # by their timers, when the watermark has passed them
        ("b", "expired", 20 * hour, ("x",)),
        ("c", "open", 40 * hour, ("late",)),
    }
    assert all(r["expires_at"] == r["updated_at"] + 12 * 3_600_000 and r["n"] == len(r["turns"]) for r in out)


def test_live_log_numbers_and_replay(spark):
    times = [0, 10, 20, 20, 2000, 2010, 2020, 2030, 200_000, 200_010]
    rows = spark.createDataFrame([("p", f"e{i:02}", "k", 1_000_000 + t) for i, t in enumerate(times)] + [("q", "only", "k", 1_000_500)], "project string, event string, kind string, s long")
    rows = rows.select("project", "event", "kind", F.timestamp_seconds("s").alias("at"))
    log = in_deliveries(rows, "at", lambda s: sessions.live_log(s, size=3), deliveries=3)
    got = {(r["event"], r["id"], r["floor"]) for r in log.where("project = 'p'").collect()}
    # After a pause the log is empty but the numbers go on; after a day they start anew.
    assert got == {("e00", 1, 1), ("e01", 2, 1), ("e02", 3, 1), ("e03", 4, 2), ("e04", 5, 5), ("e05", 6, 5), ("e06", 7, 5), ("e07", 8, 6), ("e08", 1, 1), ("e09", 2, 1)}
    asks = spark.createDataFrame([("held", "p", 6, 2040), ("moved on", "p", 2, 2040), ("nothing new", "p", 8, 2040), ("too late", "p", 6, 3000), ("anew", "p", 0, 200_020)], "asker string, project string, after long, s long")
    wanted, gaps = sessions.replay(log, asks.select("asker", "project", "after", ((F.col("s") + 1_000_000) * 1000).alias("at")))
    assert sorted((r["asker"], r["id"]) for r in wanted.collect()) == [("anew", 1), ("anew", 2), ("held", 7), ("held", 8), ("moved on", 6), ("moved on", 7), ("moved on", 8)]
    assert {(r["asker"], r["gap"]) for r in gaps.collect()} == {("held", False), ("moved on", True), ("nothing new", False), ("anew", False)}


def test_replay_meets_two_stretches_of_the_log_alone(spark):
    rng = random.Random(8)
    log, at = [], {"p": 0, "q": 500}
    for i in range(1, 400):
        for project in at:
            at[project] += rng.choice([0, 1_000, 60_000, 60_000, 899_999, 900_000, 1_900_000])
            log.append((project, i, f"e{i}", "k", at[project], max(1, i - 9)))
    asks = [(f"a{n}", rng.choice("pqr"), rng.randint(0, 400), rng.choice([rng.randint(0, 120_000_000), rng.choice(log)[4] + rng.choice([0, 899_999, 900_000])])) for n in range(300)]
    asks += asks[:5]
    gaps_wanted, ids_wanted = set(), set()
    for asker, project, after, when in asks:
        before = [(e[4], e[1], e[5]) for e in log if e[0] == project and e[4] <= when]
        if before and when - max(before)[0] < 900_000:
            _, number, floor = max(before)
            gaps_wanted.add((asker, project, after + 1 < floor))
            ids_wanted |= {(asker, project, i) for i in range(max(floor, after + 1), number + 1)}
    wanted, gaps = sessions.replay(spark.createDataFrame(log, sessions.ENTRY), spark.createDataFrame(asks, "asker string, project string, after long, at long"))
    found, ids = list(map(tuple, gaps.collect())), list(map(tuple, wanted.collect()))
    assert set(found) == gaps_wanted and len(found) == len(gaps_wanted) and set(ids) == ids_wanted and len(ids) == len(ids_wanted)
    joins = [x for x in gaps._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all("stretch" in x for x in joins)
