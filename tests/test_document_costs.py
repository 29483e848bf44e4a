"""Steps over whole texts cost a few looks at each letter, and find what a plain look finds."""

import time

from pyspark.sql import functions as F

from quillstack.operators import documents as d


def _seconds(frame) -> float:
    took = []
    for _ in range(3):
        began = time.time()
        frame.write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    return min(took)


def test_personal_data_costs_no_more_than_two_plain_looks_a_type(spark):
    # Prose without personal data: names after a civility are looked for at capitals alone, and texts without a find are not split.
    prose = spark.range(16).select(F.repeat(F.lit("les mots de la phrase vont ensemble sans fin et sans nombre "), 12_000).alias("text")).repartition(4).cache()
    plain = _seconds(prose.select(*[F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(kind) for kind, p in d.PII if kind not in ("PERSON", "EMAIL")]))
    found = _seconds(prose.select(d.pii_spans(F.col("text")).alias("spans")))
    prose.unpersist()
    assert found < 2 * plain


def test_looks_ahead_lose_no_personal_data(spark):
    texts = ["185052A00608435 x", "1 85 05 2B 006 084 62", "1 85 05 2B 006 084 63", "+33 6 12 34 56 78", "0612345678", "a@b.org", "Mme Élan-Roy O'Brien", "M. Petit et Dr\nZola", "mme Durand", "4111-1111-1111-1111", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", d.pii_spans(F.col("text")).alias("s")).orderBy("i").collect()
    assert [r["s"] and [(s["type"], s["value"]) for s in r["s"]] for r in rows] == [
        [("NIR", "185052A00608435")],  # eight digits in a row are all that a Corsican department leaves
        [("NIR", "1 85 05 2B 006 084 62")],
        [],
        [("PHONE", "+33 6 12 34 56 78")],
        [("PHONE", "0612345678")],
        [("EMAIL", "a@b.org")],
        [("PERSON", "Élan-Roy O'Brien")],
        [("PERSON", "Petit"), ("PERSON", "Zola")],
        [],
        [("CARD", "4111-1111-1111-1111")],
        None,
        [],
    ]


def test_ingestion_reads_a_text_once(spark):
    documents = spark.createDataFrame([(1, "# Titre\nLe salaire et le mot de passe. FR14 2004 1010 0505 0001 3M02 606"), (2, "Un texte."), (3, None)], "doc_id long, text string")
    made = d.ingest(documents, "doc_id")
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["doc_id"], r["section"], r["level"]) for r in made.orderBy("doc_id").collect()] == [(1, "Titre", 2), (2, "", 1)]


def test_signs_hold_the_words_they_are_looked_up_by():
    given = {
        "override": ["disregard the prior rules"], "role": ["tu es maintenant une"], "system": ["prompt systeme", "<system>", "<|system|>", "###system"], "exfiltrate": ["post my cle", "transmet le mot de passe"],
        "conceal": ["sans prevenir le user"], "tool": ["lance la commande", "execute the function", "appelle outil"], "encoded": ["rot13 decrypt"],
    }
    for name, pattern, _ in d.INJECTION:
        for text in given[name]:
            assert d.re.search(pattern, text) and any(w in text for w in d.INJECTION_WORDS[name])
    assert len(d.TOPICS) == len(d.TOPIC_WORDS)
