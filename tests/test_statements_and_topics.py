"""Statement merge and topic clusters against the sequential rules."""

import random

from pyspark.sql import functions as F

from quillstack.functions.text import content_terms, dice, fold, squeeze
from quillstack.graph import greedy_leaders
from quillstack.operators import analytics
from quillstack.operators.lifecycle import kind_family
from quillstack.operators.memory import divergence
from quillstack.operators.statements import StatementIndex, merge_statements
from quillstack.scratch import Scratch

WORDS = "budget retard serveur client contrat livraison equipe projet facture banque offre audit module capteur version reseau usine piece plan stock".split()


def statement_rows(rnd, n, start=0):
    rows = []
    for k in range(n):
        base = random.Random(rnd.randrange(10))
        words = [base.choice(WORDS) for _ in range(16)]
        if rnd.random() < 0.3:
            words[rnd.randrange(16)] = rnd.choice(WORDS)
        text = f"Le {' '.join(words)} de {rnd.choice(['720', '650'])} jours"
        if rnd.random() < 0.2:
            text = text.upper()
        if rnd.random() < 0.15:
            text += " n'est pas " + words[0]
        rows.append((f"s{start + k}", start + k // 5, k % 5, rnd.choice(["fact", "constraint", "decision"]), text))
    return rows


def sequential(spark, stored, rows):
    """The rule one statement at a time: form, shortlist of four stored ones, earliest of the delivery."""
    frame = spark.createDataFrame([(r[0], r[3], r[4]) for r in stored + rows], "id string, kind string, content string").dropDuplicates(["id"])
    frame = frame.withColumns({"family": kind_family(F.col("kind")), "form": squeeze(fold(F.col("content"))), "terms": content_terms(F.col("content"))})
    about = {r["id"]: r for r in frame.collect()}
    a = frame.select(F.col("id").alias("a"), F.col("content").alias("ca"), F.col("terms").alias("ta"))
    b = frame.select(F.col("id").alias("b"), F.col("content").alias("cb"), F.col("terms").alias("tb"))
    pairs = a.crossJoin(b).select("a", "b", dice(F.col("ta"), F.col("tb")).alias("d"), F.size(divergence(F.col("ca"), F.col("cb"))).alias("m"))
    like = {(r["a"], r["b"]): (r["d"], r["m"] == 0) for r in pairs.collect()}
    out, forms, leaders = {}, {}, []
    for i, *_ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        me = about[i]
        if (me["kind"], me["form"]) in forms:
            action, target, d = forms[me["kind"], me["form"]]
            out[i] = ("twin" if action == "new" else action, target, d)
            continue
        same = sorted(s[0] for s in stored if (about[s[0]]["kind"], about[s[0]]["form"]) == (me["kind"], me["form"]))
        listed = sorted(((-like[i, s[0]][0], s[0]) for s in stored if about[s[0]]["family"] == me["family"] and like[i, s[0]][0] >= 0.5))[:4]
        good = [(d, s) for d, s in listed if -d > 0.93 and like[i, s][1]]
        twins = [s for s in leaders if about[s]["family"] == me["family"] and like[s, i][0] > 0.93 and like[s, i][1]]
        if same:
            out[i] = ("stored", same[0], 1.0)
        elif good:
            out[i] = ("stored", good[0][1], -good[0][0])
        elif twins:
            out[i] = ("twin", twins[0], like[twins[0], i][0])
        else:
            out[i] = ("new", i, 1.0)
            leaders.append(i)
        forms[me["kind"], me["form"]] = out[i]
    return {i: (x, t, round(d, 6)) for i, (x, t, d) in out.items()}, [r for r in rows if out[r[0]][0] == "new"]


def test_statements_merge_like_one_after_the_other(spark, tmp_path):
    rnd = random.Random(2)
    frame = lambda rows: spark.createDataFrame([*rows, ("void", 0, 9, "fact", "  "), ("null", 0, 9, "fact", None)], "id string, doc long, i int, kind string, content string")
    first, second = statement_rows(rnd, 40), statement_rows(rnd, 40, 100)
    index = StatementIndex(spark, str(tmp_path / "index")).start(frame(first))
    stored = []
    for delivery, rows in ((1, first), (2, second)):
        got = {r["id"]: (r["action"], r["target"], r["similarity"]) for r in merge_statements(index, frame(rows), delivery).collect()}
        want, new = sequential(spark, stored, rows)
        assert got == want and {"new", "twin"} <= {x for x, _, _ in want.values()}
        stored = stored + new
        assert sorted(r["item"] for r in index.items().collect()) == sorted(r[0] for r in stored)
    assert "stored" in {x for x, _, _ in want.values()}
    # The same delivery again, as after a crash, leaves the same index; as a new delivery it adds nothing.
    assert {r["id"]: (r["action"], r["target"], r["similarity"]) for r in merge_statements(index, frame(second), 2).collect()} == want
    again = merge_statements(index, frame(second), 3).collect()
    assert {r["action"] for r in again} == {"stored"} and index.items().count() == len(stored)
    assert merge_statements(index, frame([]), 4).collect() == []


def test_vectors_count_on_the_shortlist(spark, tmp_path):
    schema = "id string, doc long, i int, kind string, content string, vector array<double>"
    index = StatementIndex(spark, str(tmp_path / "index")).start(spark.createDataFrame([], schema))
    merge_statements(index, spark.createDataFrame([("a", 1, 0, "fact", "budget serveur client", [1.0, 0.0]), ("b", 1, 1, "fact", "budget serveur usine", [0.0, 1.0])], schema), 1)
    given = [("c", 2, 0, "fact", "budget serveur banque", [0.1, 1.0]), ("d", 2, 1, "fact", "autre chose", [1.0, 0.0]), ("e", 2, 2, "decision", "budget serveur offre", [1.0, 0.0])]
    got = {r["id"]: (r["action"], r["target"]) for r in merge_statements(index, spark.createDataFrame(given, schema), 2).collect()}
    assert got == {"c": ("stored", "b"), "d": ("new", "d"), "e": ("new", "e")}


def test_greedy_leaders_equal_the_sequence(spark):
    rnd = random.Random(9)
    edges = {(a, b) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(150)) if a < b} | {(100 + i, 101 + i) for i in range(12)}
    kept, want = [], {}
    for v in range(113):
        home = next((k for k in kept if (k, v) in edges), None)
        if home is None:
            kept.append(v)
        else:
            want[v] = home
    rows = spark.createDataFrame([(a, b, a) for a, b in edges], "a long, b long, at long")
    assert {r["v"]: r["leader"] for r in greedy_leaders(rows, Scratch(spark, "test")).collect()} == want
    assert greedy_leaders(rows.limit(0), Scratch(spark, "test")).collect() == []


def test_topics_cluster_like_the_sequence(spark):
    rnd = random.Random(3)
    topics = [(p, 100 * p + i, rnd.sample(WORDS[:12], rnd.randrange(0, 7))) for p in range(3) for i in range(50)]
    want = {}
    for p in range(3):
        known = []
        for _, i, terms in sorted((t for t in topics if t[0] == p), key=lambda t: (-len(t[2]), t[1])):
            mine = set(terms)
            if not mine:
                continue
            same = lambda k: mine == k if 1 in (len(mine), len(k)) else len(mine & k) >= 2 and len(mine & k) / min(len(mine), len(k)) >= 0.6  # noqa: E731, B023
            home = next((k for k, theirs in known if same(theirs)), None)
            if home is None:
                known.append((i, mine))
            want[i] = i if home is None else home
    frame = spark.createDataFrame(topics, "project long, topic_id long, terms array<string>")
    assert {r["topic_id"]: r["cluster"] for r in analytics.cluster_topics(frame).collect()} == want


def test_no_table_of_like_topics_is_written(spark, monkeypatch):
    """200 wordings that all tell the same, and shorter ones: pairs are judged where they meet, none is kept."""
    topics = [("p", i, ["a", "b", "c", "d", "e", "f", f"g{i}", f"h{i}"]) for i in range(200)] + [("p", 200 + i, ["a", "b", "c", f"g{i}"]) for i in range(50)]
    sizes, keep = [], Scratch.keep

    def counted(self, df, name):
        sizes.append((table := keep(self, df, name)).count())
        return table

    monkeypatch.setattr(Scratch, "keep", counted)
    frame = spark.createDataFrame(topics, "project string, topic_id long, terms array<string>")
    assert {r["cluster"] for r in analytics.cluster_topics(frame).collect()} == {0}
    assert max(sizes) <= 2 * len(topics)


def test_equal_sets_of_terms_are_compared_once(spark, tmp_path, monkeypatch):
    """150 wordings of the same terms in two deliveries, and 100 that share half of them: no table of pairs is kept."""
    rnd, sizes, keep = random.Random(4), [], Scratch.keep
    mixed = [("m", k, 0, "fact", " ".join(rnd.sample(WORDS[:12], 12)) + "." * (k % 3)) for k in range(150)]
    half = [("h", 200 + k, 0, "fact", " ".join([*WORDS[:6], *(f"mot{k}n{j}" for j in range(6))])) for k in range(100)]
    rows = [(f"{r[0]}{r[1]:03d}", *r[1:]) for r in mixed + half]

    def counted(self, df, name):
        sizes.append((table := keep(self, df, name)).count())
        return table

    monkeypatch.setattr(Scratch, "keep", counted)
    frame = lambda part: spark.createDataFrame(rows[part::2], "id string, doc long, i int, kind string, content string")
    index = StatementIndex(spark, str(tmp_path / "index")).start(frame(0))
    first = {r["id"]: (r["action"], r["target"]) for r in merge_statements(index, frame(0), 1).collect()}
    assert first == {r[0]: ("new", r[0]) if r[0] == "m000" or r[0][0] == "h" else ("twin", "m000") for r in rows[0::2]}
    second = {r["id"]: (r["action"], r["target"]) for r in merge_statements(index, frame(1), 2).collect()}
    assert second == {r[0]: ("new", r[0]) if r[0][0] == "h" else ("stored", "m000") for r in rows[1::2]}
    assert max(sizes) <= len(rows)
