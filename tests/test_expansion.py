"""Other names for a task: equivalents of all projects in their order, names of its own titles, nothing that the task holds."""

from quillstack.operators import answering


def test_equivalents_then_names_of_titles(spark):
    titles = spark.createDataFrame([("Projet Atlas Facturation (AF)",), ("Guide Mise En Production (MEP)",), (None,), ("sans nom",)], "title string")
    tasks = [(1, "Préparer la mise en production de AF"), (2, "Le délai et l'échéance"), (3, "rien"), (4, ""), (5, None), (6, "API, client, test, rgpd, sso et cout")]
    every = answering.synonyms(spark).unionByName(answering.aliases_of_titles(titles), allowMissingColumns=True)
    rows = answering.expand(spark.createDataFrame(tasks, "id long, text string"), every, "id").orderBy("id", "place").collect()
    got = {i: [r["alias"] for r in rows if r["id"] == i] for i, _ in tasks}
    # By place: the wording itself (equivalents, then names of titles), then the short form.
    assert got[1] == ["mep", "déploiement", "release", "MEP", "Atlas Facturation"]
    assert got[2] == ["deadline", "planning"]
    assert got[3] == got[4] == got[5] == []
    assert got[6] == ["interface", "endpoint", "customer", "recette", "qualification", "données personnelles", "GDPR", "authentification unique"]
