"""A synced table against a sequential rule: any batches, restarts, a crash before the commit, repeats, compaction; scrubbing around its bound."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstack.plans.streams import in_deliveries
from quillstack.streaming import sync, windows

SCHEMA = "sync long, external_id string, at timestamp, op string, content_hash string, error string"
START = datetime(2024, 1, 1, tzinfo=UTC)


def made(seed, n=240):
    """Changes in order of time: twelve syncs over nine keys, some of them broken."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        op = rng.choice(["upsert", "upsert", "delete", "delete", "skip", "error", None])
        key, at = rng.choice([*"abcdefgh", None]), START + timedelta(minutes=i)
        rows.append((i * 12 // n, key, at, op, rng.choice("xyz") if op == "upsert" else None, "broken" if op == "error" else None))
    return rows


def expected(rows):
    last = {}
    for s, key, at, op, content, _ in rows:
        if key is not None and op in ("upsert", "delete"):
            last[key, s] = max(last.get((key, s), (at, "", "")), (at, op, content or ""))
    state = {}
    for (key, s), (_, op, content) in sorted(last.items()):
        status, held, _ = state.get(key, (None, None, None))
        if status != "forgotten" and op == "upsert":
            status, held = "active", content
        elif status in ("active", "doubted"):
            status = {"active": "doubted", "doubted": "forgotten"}[status]
        if status:
            state[key] = (status, held, s)
    return {(key, *v) for key, v in state.items()}


@pytest.mark.parametrize("batches", [1, 5, 9])
def test_any_batches_make_one_table(spark, tmp_path, batches):
    rows = made(batches)
    table = sync.SyncedTable(str(tmp_path / "t"), compact_after=2)
    cuts = [len(rows) * i // batches for i in range(batches + 1)]
    for n in range(batches):
        batch = spark.createDataFrame(rows[cuts[n] : cuts[n + 1]], SCHEMA)
        assert table.apply(batch, n)
        assert not table.apply(batch, n)
    assert set(map(tuple, table.rows(spark).collect())) == expected(rows)
    log = table.log(spark)
    bad = sum(r[1] is None or r[3] not in ("upsert", "delete", "skip") for r in rows)
    assert log.agg(F.sum("fetched"), F.sum("errors"), F.max(F.size("samples"))).first()[:2] == (len(rows), bad)
    assert log.where(F.size("samples") > sync.ERROR_SAMPLES).isEmpty()
    commit = table.commit(spark)
    assert commit["version"] == batches and len(commit["folders"]) <= 2 and commit["cursor"]["stream"].startswith("2024-01-01")


def test_stream_with_a_crash_before_the_commit(spark, tmp_path, monkeypatch):
    rows, table = made(77), sync.SyncedTable(str(tmp_path / "t"))
    follow = lambda: table.follow(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "state"))
    put = sync.put_text
    for n, part in enumerate((rows[:100], rows[100:170], rows[170:])):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 1:
            before = set(map(tuple, table.rows(spark).collect()))

            def fail(*_):
                raise OSError("gone before the commit")

            monkeypatch.setattr(sync, "put_text", fail)
            with pytest.raises(Exception, match="gone before the commit"):
                follow()
            assert set(map(tuple, table.rows(spark).collect())) == before == expected(rows[:100])
            monkeypatch.setattr(sync, "put_text", put)
        follow()
    assert set(map(tuple, table.rows(spark).collect())) == expected(rows)
    assert table.commit(spark)["batches"] == {"stream": 2}


def test_sources_count_their_own_batches_and_empty_ones_commit(spark, tmp_path):
    table = sync.SyncedTable(str(tmp_path / "t"))
    one = spark.createDataFrame([(1, "k", START, "upsert", "x", None)], SCHEMA)
    assert table.rows(spark).collect() == []
    assert table.apply(one.where("false"), 0, "mail") and table.apply(one, 0, "wiki") and not table.apply(one, 0, "wiki")
    assert [tuple(r) for r in table.rows(spark).collect()] == [("k", "active", "x", 1)]
    assert table.commit(spark)["batches"] == {"mail": 0, "wiki": 0} and list(table.commit(spark)["cursor"]) == ["wiki"]


@pytest.mark.parametrize("cuts", [(0, 4), (0, 1, 2, 3, 4)])
def test_a_delete_takes_back_what_an_earlier_batch_brought_of_its_sync(spark, tmp_path, cuts):
    at = lambda minutes: START + timedelta(minutes=minutes)
    rows = [(1, "new", at(0), "upsert", "x", None), (1, "new", at(1), "delete", None, None), (1, "back", at(2), "delete", None, None), (1, "back", at(1), "upsert", "y", None)]
    table = sync.SyncedTable(str(tmp_path / "t"), compact_after=2)
    for n, (start, end) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
        assert table.apply(spark.createDataFrame(rows[start:end], SCHEMA), n)
    assert table.rows(spark).collect() == []
    assert table.apply(spark.createDataFrame([(2, "new", at(9), "upsert", "z", None)], SCHEMA), len(cuts))
    assert [tuple(r) for r in table.rows(spark).collect()] == [("new", "active", "z", 2)]
    assert table.log(spark).orderBy("version").collect()[-1]["counts"]["created"] == 1


def test_scrubbing_before_within_and_after_the_bound(spark):
    at = lambda minutes: START + timedelta(minutes=minutes)
    rows = [("e", i, "t" if i else None, at(m)) for i, m in enumerate((5, 10, 200, 700, 2000))]
    rows += [("x", 90, "t", at(9)), ("x", 91, "t", at(220)), ("x", 92, "t", at(260)), ("x", 93, "t", at(10 + 360)), ("x", 94, "u", at(701)), ("x", 95, "t", at(700 + 361))]
    rows += [("e", 98, "end", at(9000)), ("x", 99, "end", at(9001))]

    def scrub(stream):
        gone = stream.where("kind = 'x'").select("target", F.col("at").alias("forgotten_at"))
        return windows.scrubbed(stream.where("kind = 'e'"), gone, ["id"], "target", "at").select("id", "forgotten")

    found = in_deliveries(spark.createDataFrame(rows, "kind string, id long, target string, at timestamp"), "at", scrub).collect()
    assert sorted(map(tuple, found)) == [(0, False), (1, True), (2, True), (3, False), (4, False), (98, True)]


def test_scrubbing_keeps_all_values_and_tells_repeated_events_once(spark):
    """Values of every kind pass unchanged; events and tombstones are repeated within a delivery and over two; many targets share a state."""
    at = lambda minutes: START + timedelta(minutes=minutes, microseconds=7)
    rows = [("e", i, f"t{i % 40}", at(10 * i), 2**60 + i, i / 3, bytes([i]), [{"x": None if i % 2 else i}]) for i in range(200)]
    rows += [("x", 1000 + i, f"t{i}", at(10 * i + 900), None, None, None, None) for i in range(0, 40, 4)]
    rows += [("e", 999, "end", at(9000), 1, 1.0, b"", []), ("e", 998, None, at(5), 2**53 + 1, None, None, None)]
    rows = rows + rows[::3] + [r for r in rows if r[0] == "x"]
    schema = "kind string, id long, target string, at timestamp, big long, part double, raw binary, list array<struct<x: int>>"

    def scrub(stream):
        gone = stream.where("kind = 'x'").select("target", F.col("at").alias("forgotten_at"))
        return windows.scrubbed(stream.where("kind = 'e'"), gone, ["id"], "target", "at", groups=3)

    made = in_deliveries(spark.createDataFrame(rows, schema), "at", scrub)
    assert made.columns == [*(c.split()[0] for c in schema.split(", ")[:7]), "list", "forgotten"]
    stones = [(r[2], r[3]) for r in rows if r[0] == "x"]
    want = {r[1]: (*r[:4], r[4], r[5], r[6], r[7], any(t == r[2] and r[3] <= g <= r[3] + timedelta(hours=6) for t, g in stones)) for r in rows if r[0] == "e" and r[1] != 999}
    got = made.collect()
    assert len(got) == len(want) and any(x[-1] for x in want.values())
    for r in got:
        mine = (*tuple(r)[:3], r["at"].replace(tzinfo=START.tzinfo), r["big"], r["part"], r["raw"] and bytes(r["raw"]), r["list"] and [x.asDict() for x in r["list"]], r["forgotten"])
        assert mine == (*want[r["id"]][:6], want[r["id"]][6] and bytes(want[r["id"]][6]), *want[r["id"]][7:])
    # One keyed state with a row for a group of targets, no join of streams with a row for each event.
    plan = scrub(spark.createDataFrame(rows, schema).withWatermark("at", "1 second"))._jdf.queryExecution().logical().toString()
    assert "Join" not in plan and "Union" in plan
