"""Ball-tree clustering, n-gram join and prefix trie against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import ball_tree, ngram_join, prefix_trie, queries

VECTORS = "vec_id long, embedding array<float>, cluster string, distance string"
DOCS = "doc_id long, text string, n int, component_id string"
TURNS = "conv_id long, turn long, role string, text string, depth string"


def lloyd(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids, points = np.array([e for _, e in start[:k]], np.int64), np.array([e for _, e in kept], np.int64)
    for _ in range(rounds):
        label = ((points[:, None] - centroids) ** 2).sum(2).argmin(1)
        centroids = np.array([points[label == c].sum(0) // (label == c).sum() if (label == c).any() else centroids[c] for c in range(len(centroids))])
    away = ((points[:, None] - centroids) ** 2).sum(2)
    label, least = away.argmin(1), away.min(1)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return sorted(((i, int(c), int(d), int(least[label == c].sum()), int(least.sum()), digest[c]) for (i, _), c, d in zip(kept, label, least, strict=True)), key=str)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 1, (9, 64))
    near = [(i, (middles[i % 9] + rng.normal(0, 0.02, 64)).tolist()) for i in range(700)]
    copies = [(10_000 + i, near[0][1]) for i in range(900)]
    odd = [(None, near[5][1]), (3, near[8][1]), (3, near[3][1]), (20_001, None), (20_002, [0.5] * 63), (20_003, [0.5] * 63 + [None]), (20_004, [float("nan")] * 64), (20_005, [float("inf")] + [0.0] * 63), (20_006, [0.0] * 64), (20_007, [-0.001] * 64)]
    rows = near + copies + odd
    frame = spark.createDataFrame([(i, e, "x", "y") for i, e in rows], VECTORS).repartition(3)
    out = ball_tree.cluster_vectors(frame)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == lloyd(rows)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    few = spark.createDataFrame([(i, e, None, None) for i, e in rows], VECTORS)
    assert sorted(map(tuple, ball_tree.cluster_vectors(few).collect()), key=str) == lloyd(rows)
    assert ball_tree.cluster_vectors(few.limit(0)).collect() == []


@pytest.mark.parametrize("spread", [0.5, 30, 3000, 40_000_000])
def test_balls_go_whole_and_right(spread):
    rng = np.random.default_rng(int(spread))
    middles = rng.normal(0, spread, (6, 8))
    points = np.floor(middles[rng.integers(0, 6, 900)] + rng.normal(0, 1, (900, 8))).astype(np.int64)
    centroids = np.floor(middles).astype(np.int64)[[0, 1, 2, 3, 4, 5, 5, 0]]  # ties go to the smaller number
    order, tree = ball_tree.Tree.grow(points)
    assert (tree.points == points[order]).all() and all(len(r) == 2 ** len(tree.levels) - 1 for r in (tree.radii, tree.sums))
    label, n, total = tree.filter(centroids)
    brute = ((points[order][:, None].astype(object) - centroids) ** 2).sum(2).argmin(1)
    assert (label == brute).all() and (n == np.bincount(brute.astype(int), minlength=8)).all()
    assert all((total[c] == points[order][brute == c].sum(0)).all() for c in range(8))


def linked(rows, k=5, percent=80):
    """doc_id, number of shingles and smallest linked doc_id of each row, by all pairs and union-find."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    live = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for x in live:
        for y in live:
            both = len(sets[x] & sets[y])
            if x < y and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                up[root(y)] = root(x)
    low = defaultdict(lambda: math.inf)
    for i in live:
        low[root(i)] = min(low[root(i)], rows[i][0])
    return sorted(((d, len(sets[i]), low[root(i)] if i in set(live) else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, small):
    if small:  # many blocks and parts
        monkeypatch.setattr(ngram_join, "BLOCK", 500)
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(3000)}"
    line = [word() for _ in range(30)]  # a passage that a third of all rows share
    base = [[word() for _ in range(rnd.randrange(3, 60))] + (line if i % 3 == 0 else []) for i in range(150)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(150, 300):  # near copies, a chain of them too
        b = list(base[rnd.randrange(len(base))])
        if rnd.random() < 0.8:
            b[rnd.randrange(len(b))] = word()
        base.append(b)
        rows.append((i, " ".join(b)))
    rows += [(1000 + i, rows[0][1].upper()) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (None, rows[1][1]), (2003, "one two"), (2004, "ONE  two"), (2005, "two one"), (7, rows[9][1]), (7, rows[7][1])]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS)
    out = ngram_join.ngram_join(frame)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == linked(rows)


def test_ngram_join_of_a_column_that_stays_open(spark):
    # All rows share columns, hardly any two are linked, and some meet in late rounds only.
    rnd = random.Random(8)
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join(shared + [f"r{i // 2}x{j + (i % 2 == 1) * (j == 0) * 100}" for j in range(14)])) for i in range(160)]
    rows += [(500 + i, " ".join(shared[: 36 + rnd.randrange(4)])) for i in range(30)]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS)
    assert sorted(map(tuple, ngram_join.ngram_join(frame).collect()), key=str) == linked(rows)


def test_ngram_join_without_rows_or_links(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.ngram_join(none).collect() == []
    apart = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}", 1, "x") for i in range(20)], DOCS)
    assert sorted(map(tuple, ngram_join.ngram_join(apart).collect())) == [(i, 2, i) for i in range(20)]


def trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built, members, kids = {}, defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]  # the sign of a remainder is that of c, as in SQL
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in kids[p])
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_equals_lists_of_prefixes(spark):
    rnd = random.Random(4)
    rows = []
    for c in range(230):
        if c % 7 == 3 and c % 20:
            continue
        talk = [("user", f"t{rnd.randrange(2)}"), ("assistant", f"u {rnd.randrange(3)}")] + [(rnd.choice("ab"), f"x{rnd.randrange(2)} y z"[: rnd.randrange(8)]) for _ in range(rnd.randrange(5))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(talk[: rnd.randrange(1, 8)])]
    rows += [(1000 + c, i, "user", f"same {i}") for c in range(0, 400, 7) for i in range(6)]  # a large group of equal conversations
    rows += [(2000 + c, i, "user", f"long {i}") for c in (1, 2, 3) for i in range(40 + c)]  # long ones that share many turns
    rows += [(3000, 1, None, None), (3000, None, "user", "first"), (3000, 1, "", ""), (3000, 1, "user", "b"), (3000, 1, "user", "a"), (None, 0, "user", "x"), (3021, 0, "user", "only"), (-5, 0, "user", "below"), (-5, 1, "user", "zero")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], TURNS).repartition(5)
    out = prefix_trie.prefix_trie(frame)
    assert sorted(map(tuple, out.collect()), key=str) == trie(rows)


def test_trie_without_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(none).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "c")], TURNS)).collect() == []


@pytest.mark.parametrize("name, table", [("op11_ball_tree", "embeddings"), ("op13_prefix_trie", "conversations")])
def test_queries_on_whole_tables(spark, name, table):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    out = sorted(map(tuple, queries.QUERIES[name](spark, sf).collect()), key=str)
    if table == "embeddings":
        assert out == lloyd([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    else:
        assert out == trie([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_ngram_join_sees_whole_texts(spark):
    head = " ".join(f"h{i}" for i in range(3000))
    rows = [(1, head + " x y z"), (2, head + " x y"), (3, " ".join(f"g{i}" for i in range(3000))), (4, head[:9000])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    assert sorted(map(tuple, ngram_join.ngram_join(frame).collect()), key=str) == linked(rows)
