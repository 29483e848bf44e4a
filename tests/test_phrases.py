"""Many phrases at once and sensitivity with its reasons, against brute force and the query's own SQL on worded rows."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from quillstack.operators import phrases as p
from quillstack.plans import finding


def form_of(spark, text):
    return spark.range(1).select(p.phrase_form(F.lit(text))).first()[0]


def test_phrases_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "ab", "b", "aba", "c-d", "École", "4", "bœuf", "x.y"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "ab", "abab", "AB  a\n\tb" * 400]
    phrases = list({" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(80)}) + ["ab", "a b", "aba a", "ECOLE 4", " ", "--", None]
    rows = [(i % 50, t, "extra") for i, t in enumerate(texts)]  # some ids repeat
    labels = [(f"l{i % 9}", x) for i, x in enumerate(phrases)] + [("again", "ab"), ("again", "ab")]
    forms = {x: form_of(spark, x) if x is not None else None for x in {*phrases, *texts}}
    want = []
    for key, text, _ in rows:
        for label, form in {(n, forms[x]) for n, x in labels if forms[x] and re.search("[a-z0-9]", forms[x])}:
            at = [m.start() for m in re.finditer(rf"(?<![a-z0-9])(?={re.escape(form)}(?![a-z0-9]))", forms[text] or "")]
            if at:
                want.append((key, label, form, len(at), at[0]))
    given = spark.createDataFrame(rows, "id long, text string, form string"), spark.createDataFrame(labels, "label string, phrase string")
    for size in (p.BLOCK_CHARS, 40):  # one automaton, and many passes
        found = p.find_phrases(*given, "id", "text", size)
        assert found.columns == ["id", "label", "form", "n", "first"]
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_no_phrases_and_no_texts(spark):
    texts, none = spark.createDataFrame([(1, "ab")], "id long, text string"), spark.createDataFrame([], "label string, phrase string")
    assert p.find_phrases(texts, none, "id", "text").collect() == []
    assert p.find_phrases(texts.where("id > 1"), spark.createDataFrame([("x", "ab")], "label string, phrase string"), "id", "text").collect() == []


def test_blocks_hold_their_letters():
    assert list(p.blocks(["aa", "b", "cccc", "d"], 3)) == [["aa", "b"], ["cccc"], ["d"]]


WORDED = {
    "Note\nLe salaire et la prime annuelle sont revus.": (2, "topics:C2:salaire,remuneration"),
    "Note\nLe budget a de la marge de manœuvre, contrat signé.": (1, ""),
    "Note\nLe budget a une marge sûre, contrat signé.": (2, "topics:C2:budget,contrat,marge"),
    "Note\n** SECRET **\nsuite": (3, "marking:C3"),
    "Note\nun secret bien gardé": (1, ""),
    "Document confidentiel du mois": (2, "marking:C2"),
    "Note\nfusions-acquisitions, tarifs\nnégociés et RIB": (2, "topics:C2:prix,donnees bancaires,fusion-acquisition"),
    "Note\nNiveau de sensibilité : Confidentielle": (2, "stated:C2"),
    "Classification - public\nrien": (1, ""),
    "Note\ncarte 4111 1111 1111 1111": (2, "personal:C2:CARD"),
    "Note\nFR76 3000 6000 0112 3456 7890 189": (2, "personal:C2:IBAN"),
    "Très secret\nmots de passe": (3, "marking:C3"),
    "": (1, ""),
    None: (1, ""),
}


def test_sensitivity_by_rule_and_by_sql(spark, tmp_path):
    rows = [(3 * i, text, "fr", None, 0) for i, text in enumerate(WORDED)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["level"], r["reasons"]) for r in finding.sensitivity_reasons(spark, str(tmp_path)).collect()}
    for (key, *_), (level, reason) in zip(rows, WORDED.values(), strict=True):
        assert got[key] == (level, " ".join(["source:C1 declared:C0", reason]).strip())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    stated = con.execute(finding.ORACLES["sensitivity_reasons"])
    names = [c[0] for c in stated.description]
    assert {r[names.index("doc_id")]: (r[names.index("level")], r[names.index("reasons")]) for r in stated.fetchall()} == got
