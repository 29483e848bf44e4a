"""Results of the whole job against brute force, where a cut would show."""

import duckdb

from quillstack import catalog
from quillstack.operators import duplicates, governance, memory, neighbours, ranking, search
from quillstack.plans import retrieval

SF = "/root/testdata/sf0.001"


def test_burst_across_midnight(spark):
    stamps = [f"2024-01-01 {h}:30:00" for h in (20, 21, 22, 23)] + [f"2024-01-02 0{h}:30:00" for h in range(4)]
    rows = [(1, t) for t in stamps] + [(2, t) for t in stamps[:7]] + [(3, "2024-01-01 00:59:00")] + [(3, "2024-01-02 00:53:00")] * 7
    items = spark.createDataFrame(rows, "source long, at string").selectExpr("source", "CAST(at AS timestamp) AS at")
    found = {(r["source"], str(r["window_start"]), r["n"]) for r in memory.bursts(items, "source", "at").collect()}
    assert found == {(1, "2024-01-01 20:30:00", 8), (3, "2024-01-01 00:59:00", 8)}


def test_poisoning_burst_equals_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    brute = f"""WITH e AS (SELECT * FROM '{sf}/events.parquet'), s AS (SELECT DISTINCT user_id, ts FROM e)
      SELECT s.user_id, CAST(floor(epoch_us(s.ts) / 1000000) AS BIGINT) AS window_start, count(*) AS n FROM s JOIN e ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 24 HOUR
      GROUP BY s.user_id, s.ts HAVING count(*) >= 8"""
    ours = catalog.QUERIES["poisoning_burst"](spark, sf).select("user_id", "window_start", "n").collect()
    assert len(ours) and sorted(map(tuple, ours)) == sorted(duckdb.sql(brute).fetchall())


def test_knn_asks_every_fiftieth_vector(spark):
    sf = "/root/testdata/sf0.01"
    brute = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM '{sf}/embeddings.parquet'),
      s AS (SELECT a.vec_id, b.vec_id AS candidate, round(greatest(0, least(1, list_cosine_similarity(a.v, b.v))), 5) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, candidate) AS rnk FROM s) WHERE rnk <= 10"""
    theirs = sorted(duckdb.sql(brute).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["knn_topk"](spark, sf).select("vec_id", "candidate", "score", "rnk").collect())) == theirs
    plan = catalog.QUERIES["knn_topk"](spark, sf)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_knn_visits_only_cells_that_may_hold_a_neighbour(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(neighbours, "PART", 40)  # several parts and blocks a cell
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (30, 16))
    x = middles[rng.integers(0, 30, 1500)] + rng.normal(0, 0.03, (1500, 16))
    x[100:160] = x[100]  # copies, with ties in score
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [1.0] * 3), (9004, [float("nan")] * 16), (9005, [None] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen: list = []
    found = neighbours.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "vec_id", "embedding", 7, seen=seen).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for q in range(0, 1500, 50):
        score = np.floor(np.clip(unit @ unit[q], 0, 1) * 1e5 + 0.5) / 1e5
        best = sorted((-s, i) for i, s in enumerate(score.tolist()) if i != q)[:7]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, (r.asDict().values() for r in found))) == sorted(want)
    assert seen[1] == 30 * 1501 and seen[0] < seen[1] / 4
    # Opposed vectors all score 0: every cell is visited and the smaller keys win.
    apart = spark.createDataFrame([(1, [1.0, 0.0])] + [(i, [-1.0, -0.01 * i]) for i in range(2, 40)], "vec_id long, embedding array<double>")
    assert [(r["candidate"], r["score"]) for r in search.knn(apart.where("vec_id = 1"), apart, "vec_id", "vec_id", "embedding", 3).orderBy("rnk").collect()] == [(2, 0.0), (3, 0.0), (4, 0.0)]
    assert search.knn(apart, apart.limit(0), "vec_id", "vec_id", "embedding", 3).collect() == []


def test_mmr_sees_text_after_600_characters(spark, monkeypatch):
    head, same, other = "alpha beta " * 60, "gamma delta " * 400, "omega sigma kappa lambda " * 200
    texts = [(1, "a", 1.0, head + same), (1, "b", 0.9, head + same), (1, "c", 0.8, head + other)]
    rows = spark.createDataFrame(texts, "request long, key string, score double, text string")
    monkeypatch.setattr(retrieval, "_request_candidates", lambda spark, sf: rows)
    order = [r["key"] for r in retrieval.mmr_selection(spark, SF).orderBy("position").collect()]
    # b repeats a, c differs only after character 600: with the first 600 alone all are alike and the order is a, b, c.
    assert order == ["a", "c", "b"]


def test_clusters_of_a_long_descending_chain(spark):
    chain = [1, *range(300, 1, -1)]
    edges = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a long, b long")
    assert {(r["id"], r["root"]) for r in memory.clusters(edges).collect()} == {(i, 1) for i in chain}


def test_contradiction_clusters_link_all_parts_of_an_order(spark, tmp_path):
    orders = {1: [9, 5, 7], 2: [7, 12], 3: [20, 21, 22, 23], 4: [30], 5: [40, 40], 6: [23, 24]}
    rows = [(o, p, 1 + p % 50) for o, parts in orders.items() for p in parts]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {(r["id"], r["root"]) for r in catalog.QUERIES["contradiction_clusters"](spark, str(tmp_path)).collect()}
    assert found == {(p, 5) for p in (5, 7, 9, 12)} | {(p, 20) for p in (20, 21, 22, 23, 24)}


def test_contradiction_clusters_equal_union_find(spark):
    sf = "/root/testdata/sf0.001"
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    rows = duckdb.sql(f"SELECT l_partkey, min(l_partkey) OVER (PARTITION BY l_orderkey) FROM '{sf}/lineitem.parquet'").fetchall()
    for p, low in rows:
        x, y = sorted((root(p), root(low)))
        up[y] = x
    brute = {(p, root(p)) for pair in rows if pair[0] != pair[1] for p in pair}
    assert {(r["id"], r["root"]) for r in catalog.QUERIES["contradiction_clusters"](spark, sf).collect()} == brute


def test_near_duplicates_with_membership_equal_brute_force(spark):
    base = [f"w{i}" for i in range(40)]
    loop = ["a", "b", "c"] * 4
    texts = [base, base, [*base, "x"], [*base, "x"], base[:20], loop, loop + ["a", "b"], ["q", "r"], ["q", "r"], ["z"] + base[1:], []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = {i: {tuple(t[j : j + 3]) for j in range(max(len(t) - 2, 1))} for i, t in enumerate(texts) if t}
    brute = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * 80}
    of = {r["doc_id"]: r["class_id"] for r in duplicates.shingle_classes(docs, "doc_id").collect()}
    linked = {(r["a"], r["b"]) for r in duplicates.jaccard_pairs(docs, "doc_id").collect()}
    assert set(of) == set(sets) and (5, 6) in brute and of[6] == 5
    assert {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or tuple(sorted((of[a], of[b]))) in linked)} == brute


def test_near_dup_membership_is_registered(spark):
    rows = catalog.QUERIES["near_dup_classes"](spark, SF).collect()
    ids = {r["doc_id"] for r in rows}
    assert len(ids) == len(rows) and all(r["class_id"] <= r["doc_id"] and r["class_id"] in ids for r in rows)


def test_merged_rights_have_no_cap(spark):
    rows = [(1, ["a", "b", "c"], 0), (1, ["c", "b"], 2), (1, ["b", "b", "d", "c"], 1), (2, ["a"], 1), (2, ["b"], 0), (3, ["z", "y"], 3), (3, None, 1), (None, ["n"], 0)]
    merged = governance.merge_acls(spark.createDataFrame(rows, "g long, acl array<string>, level int"), "g", "acl", "level")
    assert {(r["g"], tuple(r["acl"]), r["level"]) for r in merged.collect()} == {(1, ("b", "c"), 2), (2, (), 1), (3, ("y", "z"), 3), (None, ("n",), 0)}
    # No list of a group is left out: nothing takes a slice of them.
    assert "slice(" not in merged._jdf.queryExecution().toString()


def test_all_keywords_count_for_intent(spark):
    keywords = spark.createDataFrame([("other", 1, f"k{i}") for i in range(10_500)] + [("last", 2, "needle")], "intent string, priority int, keyword string")
    texts = spark.createDataFrame([(1, ["needle", "k10400"]), (2, ["needle"]), (3, ["none"])], "id long, t array<string>")
    found = {r["id"]: (r["intent"], r["hits"]) for r in ranking.infer_intent(texts, "id", "t", keywords, "general").collect()}
    assert found == {1: ("other", 1), 2: ("last", 1), 3: ("general", 0)}
