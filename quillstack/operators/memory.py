"""Versioned, bitemporal memory: versions, as-of views, diffs, lifecycle rules, contradictions and entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import acronym, content_terms, dice, fold, let, numbers_with_units, squeeze
from ..graph import components
from ..scratch import Scratch


def current_versions(items: DataFrame, lineage: str = "lineage", version: str = "version") -> DataFrame:
    """The newest version of every lineage."""
    newest = items.groupBy(lineage).agg(F.max_by(F.struct("*"), F.col(version)).alias("row"))
    return newest.select("row.*")


def known_at(items: DataFrame, at: Column, lineage: str = "lineage", version: str = "version", created: str = "created_at") -> DataFrame:
    """The newest version of every lineage that was known at a time."""
    return current_versions(items.where(F.col(created) <= at), lineage, version)


def as_of(items: DataFrame, at: Column, **names) -> DataFrame:
    """Known and valid at a time: the version is chosen first, so an ended newest version hides those before it."""
    known = known_at(items, at, **names)
    return known.where((F.col("status") != "forgotten") & (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def as_of_diff(before: DataFrame, after: DataFrame, latest: DataFrame, lineage: str = "lineage") -> DataFrame:
    """(lineage, change, why): added, changed or removed between two views, and for removals what became of the lineage."""
    a, b = before.select(lineage, F.col("version").alias("va")), after.select(lineage, F.col("version").alias("vb"))
    both = a.join(b, lineage, "full_outer").join(latest.select(lineage, "status"), lineage, "left")
    change = F.when(F.col("va").isNull(), "added").when(F.col("vb").isNull(), "removed").when(F.col("va") != F.col("vb"), "changed")
    why = F.when(F.col("vb").isNull(), F.when(F.col("status").isin("superseded", "obsolete", "forgotten"), F.col("status")).otherwise("expired"))
    return both.select(lineage, change.alias("change"), why.alias("why")).where(F.col("change").isNotNull())


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "key", content: str = "content_hash") -> DataFrame:
    """(key, change) between two snapshots: added, removed, changed, unchanged."""
    both = old.select(key, F.col(content).alias("ho")).join(new.select(key, F.col(content).alias("hn")), key, "full_outer")
    return both.select(key, F.when(F.col("ho").isNull(), "added").when(F.col("hn").isNull(), "removed").when(F.col("ho") == F.col("hn"), "unchanged").otherwise("changed").alias("change"))


def apply_versions(items: DataFrame, changes: DataFrame, lineage: str = "lineage") -> DataFrame:
    """The log with one more version for every changed lineage. changes: lineage, content, created_at."""
    last = items.groupBy(lineage).agg(F.max("version").alias("last"))
    fresh = changes.join(last, lineage, "left").withColumn("version", F.coalesce("last", F.lit(0)) + 1).drop("last")
    return items.unionByName(fresh, allowMissingColumns=True)


def version_changes(items: DataFrame, fields: list[str], lineage: str = "lineage") -> DataFrame:
    """(lineage, version, field, before, after) as text: what each version changed, and all that the first of a lineage set.

    Versions count up by one; the one before is met by its number, so a long lineage is not one task's. Null is a value like others.
    """
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    now = items.select(lineage, "version", texts.alias("now"))
    old = now.select(lineage, (F.col("version") + 1).alias("version"), F.col("now").alias("old"))
    both = now.join(old, [lineage, "version"], "left").select(lineage, "version", F.posexplode("now").alias("i", "f"), "old")
    before = F.get("old", F.col("i"))["value"]
    changed = both.where(~before.eqNullSafe(F.col("f.value")))
    return changed.select(lineage, "version", "f.field", before.alias("before"), F.col("f.value").alias("after"))


def status_fold(events: DataFrame, lineage: str = "lineage") -> DataFrame:
    """The status that a lineage's latest event leaves; restoring goes back to the last status before the closing event."""
    status = F.create_map(*[F.lit(x) for pair in {"created": "proposed", "validated": "validated", "obsoleted": "obsolete", "superseded": "superseded", "forgotten": "forgotten"}.items() for x in pair])
    named = events.withColumn("status", F.element_at(status, F.col("event")))
    w = Window.partitionBy(lineage).orderBy("at", "event")
    opened = F.when(F.col("status").isin("proposed", "validated"), F.col("status"))
    before = F.last(opened, ignorenulls=True).over(w)
    resolved = named.withColumn("status", F.when(F.col("event") == "restored", F.coalesce(before, F.lit("proposed"))).otherwise(F.col("status")))
    return resolved.groupBy(lineage).agg(F.max_by("status", F.struct("at", "event")).alias("status"))


def decay_confidence(items: DataFrame, reinforced: DataFrame, lineage: str = "lineage") -> DataFrame:
    """Confidence times 0.95, not below 0.2, unless the lineage was reinforced."""
    seen = reinforced.select(lineage).distinct().withColumn("seen", F.lit(True))
    faded = F.greatest(F.lit(0.2), F.col("confidence") * 0.95)
    return items.join(seen, lineage, "left").withColumn("confidence", F.when(F.col("seen"), F.col("confidence")).otherwise(F.least("confidence", faded))).drop("seen")


def propagate_forget(provenance: DataFrame, lineage: str = "lineage") -> DataFrame:
    """(lineage, action, factor): forgotten when all sources are, confidence times 0.6 when some are."""
    share = provenance.groupBy(lineage).agg(F.every("forgotten").alias("all"), F.some("forgotten").alias("any"))
    return share.where("any").select(lineage, F.when(F.col("all"), "forget").otherwise("weaken").alias("action"), F.when(F.col("all"), 0.0).otherwise(0.6).alias("factor"))


def weaken(items: DataFrame, actions: DataFrame, lineage: str = "lineage", least: float = 0.05) -> DataFrame:
    """Items after ``propagate_forget``: forgotten, or less sure but not below ``least``; others stay as they are."""
    hit = actions.select(F.col(lineage).alias("_l"), "action", "factor")
    rows = items.join(hit, F.col(lineage) == F.col("_l"), "left")
    sure = F.when(F.col("action") == "weaken", F.greatest(F.lit(least), F.col("confidence") * F.col("factor"))).otherwise(F.col("confidence"))
    return rows.withColumns({"status": F.when(F.col("action") == "forget", "forgotten").otherwise(F.col("status")), "confidence": sure}).drop("_l", "action", "factor")


def promote(inclusions: DataFrame, lineage: str, at: str, now: Column, days: int = 30, least: int = 5) -> DataFrame:
    """Lineages included at least ``least`` times in the last days."""
    recent = inclusions.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))
    return recent.groupBy(lineage).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bursts(items: DataFrame, source: str, at: str, hours: int = 24, least: int = 8) -> DataFrame:
    """(source, window_start, n): the windows of ``hours``, both ends included, that open with an item of a source and hold at least ``least`` of its items.

    Any window with so many items has one of these from its first item on, so no burst is lost between fixed starts. The count is a
    difference of two running sums, which stays linear for a source with very many items.
    """
    each = items.where(F.col(at).isNotNull()).groupBy(source, F.col(at).alias("window_start")).agg(F.count("*").alias("c"))
    ordered = Window.partitionBy(source).orderBy(F.unix_micros(F.col("window_start").cast("timestamp")))
    upto = F.sum("c").over(ordered.rangeBetween(Window.unboundedPreceding, hours * 3_600_000_000))
    before = F.sum("c").over(ordered.rangeBetween(Window.unboundedPreceding, -1))
    return each.withColumn("n", upto - F.coalesce(before, F.lit(0))).where(F.col("n") >= least).select(source, "window_start", "n")


#: Term pairs of which two statements cannot both be true, as beginnings of stems.
OPPOSITES = (
    ("obligatoir", "facultati"),
    ("obligatoir", "optionnel"),
    ("autoris", "interdit"),
    ("activ", "desactiv"),
    ("inclu", "exclu"),
    ("accept", "refus"),
    ("augment", "diminu"),
    ("hauss", "baiss"),
    ("ouvert", "ferm"),
    ("public", "priv"),
    ("intern", "extern"),
    ("synchron", "asynchron"),
    ("centralis", "decentralis"),
    ("nativ", "web"),
    ("natif", "web"),
    ("minimum", "maximum"),
    ("possibl", "impossibl"),
    ("compatibl", "incompatibl"),
    ("valid", "rejet"),
)
#: What negates a clause, on folded text.
NEGATION = (
    r"\b(?:ne|n['’])\s*(?:\w+['’]?\s+){0,3}?(?:pas|plus|jamais|guere|aucun\w*|rien|nullement)\b"
    r"|\b(?:pas\s+de|pas\s+d['’]|aucun\w*|jamais|abandon\w*|plutot\s+qu\w*|au\s+lieu\s+d\w*|et\s+non)\b"
)
#: What announces the thing that is given up, and where its name ends.
REPLACEMENT = (
    r"(?:plutôt|plutot)\s+qu(?:e|['’])\s*"
    r"|au\s+lieu\s+(?:de\s+|d['’]|du\s+|des\s+)"
    r"|à\s+la\s+place\s+(?:de\s+|d['’]|du\s+|des\s+)"
    r"|en\s+remplacement\s+(?:de\s+|d['’]|du\s+|des\s+)"
    r"|remplacer?(?:a|ont|ons)?\s+"
    r"|abandon(?:ne|née|nées|nent|ner|nons)?\s+(?:de\s+|du\s+|des\s+|d['’]|la\s+|le\s+|les\s+|l['’])?"
    r"|renon\w*\s+(?:à|a)\s+"
    r"|et\s+non\s+(?:plus\s+)?"
)
PHRASE_END = r"[.;:!?,()\[\]\n«»\"]| et | mais | car "
PHRASE_LENGTH = 120
#: Label words that say nothing about the subject, as stems.
LABELS = ("decision", "decid", "besoin", "contraint", "risqu", "fait", "exigenc", "note", "point", "vigilanc")


def _topics(terms: Column) -> Column:
    return F.filter(terms, lambda t: ~t.rlike("^[0-9]") & ~t.isin(*LABELS))


def topic_terms(text: Column) -> Column:
    """What a statement is about: content terms without numbers and label words."""
    return _topics(content_terms(text))


def denied(text: Column) -> Column:
    """The terms of the negated clauses of a text. They are few, so no other clause is cut into terms."""
    clauses = F.filter(F.split(text, r"[;.!?]\s*"), lambda clause: fold(clause).rlike(NEGATION))
    return F.flatten(F.transform(clauses, content_terms))


def negated_about(text: Column, other: Column) -> Column:
    """Whether a clause of the text is negated and speaks of something the other text holds."""
    return F.arrays_overlap(denied(text), content_terms(other))


def facts(text: Column) -> Column:
    """What ``divergence`` looks at in a text, cut out of it once."""
    signs = "^(?:" + "|".join(sorted({side for pair in OPPOSITES for side in pair})) + ")"
    parts = F.struct(content_terms(text).alias("terms"), numbers_with_units(text).alias("numbers"), denied(text).alias("denied"))
    return let(parts, lambda x: F.struct(x["terms"].alias("terms"), x["numbers"].alias("numbers"), x["denied"].alias("denied"), F.filter(x["terms"], lambda t: t.rlike(signs)).alias("signs")))


def divergence(a: Column, b: Column) -> Column:
    """array<string> of marks on which two statements differ: numeric, negation, opposites."""
    return let(F.struct(facts(a).alias("a"), facts(b).alias("b")), lambda x: _marks(x["a"], x["b"]))


def _marks(a: Column, b: Column) -> Column:
    na, nb = a["numbers"], b["numbers"]
    units = F.array_intersect(F.filter(F.transform(na, lambda x: x["unit"]), lambda u: u.isNotNull()), F.transform(nb, lambda x: x["unit"]))
    of = lambda values, unit: F.transform(F.filter(values, lambda x: x["unit"] == unit), lambda x: x["value"])
    by_unit = F.exists(units, lambda u: ~F.arrays_overlap(of(na, u), of(nb, u)))
    va, vb = F.transform(na, lambda x: x["value"]), F.transform(nb, lambda x: x["value"])
    numeric = (F.size(va) > 0) & (F.size(vb) > 0) & (by_unit | ((F.size(F.array_except(va, vb)) > 0) & (F.size(F.array_except(vb, va)) > 0)))
    negated = F.arrays_overlap(a["denied"], b["terms"]) != F.arrays_overlap(b["denied"], a["terms"])
    ta, tb = a["signs"], b["signs"]
    has = lambda t, p: F.exists(t, lambda x: x.startswith(p))
    opposed = F.lit(False)
    for left, right in OPPOSITES:
        opposed = opposed | (has(ta, left) & has(tb, right) & ~has(ta, right) & ~has(tb, left)) | (has(ta, right) & has(tb, left) & ~has(ta, left) & ~has(tb, right))
    marks = F.array(F.when(numeric, "numeric"), F.when(negated, "negation"), F.when(opposed, "opposites"))
    return F.filter(marks, lambda m: m.isNotNull())


def replaces(newer: Column, older: Column) -> Column:
    """Whether a text names something as given up, in words it does not use otherwise, that the older one asserts."""
    given_up = rf"(?iU)(?:{REPLACEMENT})((?:(?!{PHRASE_END}).){{1,{PHRASE_LENGTH}}})"
    asserted = lambda text: content_terms(F.regexp_replace(text, given_up, " "))
    phrases = F.regexp_extract_all(newer, F.lit(given_up), F.lit(1))
    kept = F.struct(asserted(newer).alias("newer"), asserted(older).alias("older"))
    return let(kept, lambda k: F.exists(phrases, lambda p: F.arrays_overlap(F.array_except(content_terms(p), k["newer"]), k["older"])))


def _related(cut: Column, near: Column, supersedes: Callable[[Column, Column], Column]) -> Column:
    """(relation, similarity) from the terms a and b and the marks of two statements; ``supersedes`` is given their similarity and whether they differ."""

    def measured(x: Column) -> Column:
        topics = let(F.struct(_topics(x["a"]).alias("a"), _topics(x["b"]).alias("b")), lambda t: dice(t["a"], t["b"]))
        return F.struct(F.round(F.greatest(near, topics), 6).alias("similarity"), F.greatest(near, dice(x["a"], x["b"])).alias("alike"), F.size(x["marks"]).alias("n"))

    def related(x: Column) -> Column:
        similarity, differ = x["similarity"], x["n"] > 0
        relation = (
            F.when(supersedes(similarity, differ), "supersedes")
            .when((similarity > 0.7) & differ, "contradicts")
            .when((x["alike"] > 0.93) & (x["n"] == 0), "duplicates")
        )
        return F.struct(relation.alias("relation"), similarity.alias("similarity"))

    return let(let(cut, measured), related)


def related_facts(a: Column, b: Column) -> Column:
    """(relation, similarity) of two texts by their ``facts``, where none is a decision that replaces the other; the same both ways."""
    cut = F.struct(a["terms"].alias("a"), b["terms"].alias("b"), _marks(a, b).alias("marks"))
    return _related(cut, F.lit(0.0), lambda similarity, differ: F.lit(False))


def relate(pairs: DataFrame, judge: Callable[[Column, Column], Column] = divergence) -> DataFrame:
    """(a, b, relation, similarity) of statement pairs a (older), b: supersedes, contradicts, duplicates or none.

    pairs: a, b, text_a, text_b, both_decisions, hours_apart, cosine. ``judge`` gives the marks of difference of two texts.
    """
    near = F.coalesce("cosine", F.lit(0.0))
    cut = F.struct(content_terms(F.col("text_a")).alias("a"), content_terms(F.col("text_b")).alias("b"), judge(F.col("text_a"), F.col("text_b")).alias("marks"))
    replaced = F.coalesce(replaces(F.col("text_b"), F.col("text_a")), F.lit(False))
    newer = F.col("both_decisions") & (F.col("hours_apart") >= 1)
    related = _related(cut, near, lambda similarity, differ: newer & ((similarity > 0.8) & differ | (replaced & (similarity >= 0.25))))
    # A filter on the relation would have Catalyst compute it twice; the row is dropped as an empty list instead.
    each = F.filter(F.array(related), lambda r: r["relation"].isNotNull())
    return pairs.select("a", "b", F.explode(each).alias("r")).select("a", "b", "r.relation", "r.similarity")


def clusters(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): connected components with the smallest member as root, by star rounds until nothing changes."""
    joined = components(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), Scratch(edges.sparkSession, "clusters"))
    return joined.select(F.col("v").alias("id"), "root").unionByName(joined.select(F.col("root").alias("id"), "root").distinct())


def cluster_report(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, size, n_edges, severity, keep): contradictory groups of live items; keep is validated, newer, surer.

    items: id, kind, status, confidence, at. Severity: critical between validated decisions or constraints, else review.
    """
    live = items.where(F.col("status").isin("proposed", "validated"))
    firm = (F.col("status") == "validated") & F.col("kind").isin("decision", "constraint")
    sides = live.select("id", firm.alias("firm"))
    kept = edges.join(sides.select(F.col("id").alias("a"), F.col("firm").alias("fa")), "a").join(sides.select(F.col("id").alias("b"), F.col("firm").alias("fb")), "b")
    roots = clusters(kept)
    per_edge = kept.join(roots.withColumnRenamed("id", "a"), "a").groupBy("root").agg(F.count("*").alias("n_edges"), F.some(F.col("fa") & F.col("fb")).alias("critical"))
    strength = F.struct((F.col("status") == "validated").cast("int").alias("s"), "at", "confidence", F.col("id"))
    members = roots.join(live, "id").groupBy("root").agg(F.count("*").alias("size"), F.max_by("id", strength).alias("keep"))
    return members.join(per_edge, "root").select("root", "size", "n_edges", F.when(F.col("critical"), "critical").otherwise("review").alias("severity"), "keep")


def alias_suggestions(entities: DataFrame, key: str, name: str, least: float = 0.6) -> DataFrame:
    """(a, b, score, reason): names that may mean one thing; equal forms are one class, named by its smallest key.

    Equal form 1.0 (class and member), and between classes: acronym 0.9, containment 0.75, Dice of the words at least ``least``.
    Classes meet by equal acronym and form, by the rarest word of a form that another may contain, and by a prefix of their words in
    order of rarity, which two sets at the threshold share. The prefix is as short as the sizes of both allow: a word that everything has brings
    nothing together, also where names have two words, of which one is common to all.
    """
    scratch = Scratch(entities.sparkSession, "aliases")
    named = entities.select(F.col(key).alias("id"), squeeze(fold(F.col(name))).alias("form")).where(F.col("form") != "")
    classes = named.groupBy("form").agg(F.min("id").alias("id"))
    same = named.join(classes.withColumnRenamed("id", "a"), "form").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"), F.lit(1.0).alias("score"), F.lit("form").alias("reason"))
    flat = F.replace(F.col("form"), F.lit(" "), F.lit(""))
    rows = scratch.keep(classes.select("id", "form", content_terms(F.col("form")).alias("t"), acronym(F.col("form")).alias("short"), flat.alias("flat"), F.array_distinct(F.split("form", " ")).alias("w")), "classes")

    def by_rarity(column: str) -> DataFrame:
        each = rows.select("id", F.size(column).alias("n"), F.explode(column).alias("word"))
        often = each.groupBy("word").agg(F.count("*").alias("df"))
        return each.join(often, "word").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("o"))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        l, r = left.toDF("x", "k"), right.toDF("y", "j")  # noqa: E741
        return l.join(r, (F.col("k") == F.col("j")) & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    shorts = rows.where(F.size("t") > 1).select("id", "short")
    words_of = rows.select("id", F.explode("w").alias("word"))
    rarest = by_rarity("w").select("id", F.col("o")[0]["word"].alias("word"))
    # Sets of n and m words at the threshold (as rounded below) share at least so many, and of these the rarest lies in the first n - that + 1.
    lowest = least - 5e-5
    sizes = F.broadcast(rows.select(F.size("t").alias("m")).where("m > 0").distinct())
    alike = (F.col("m") * (2 - lowest) >= F.col("n") * lowest) & (F.col("n") * (2 - lowest) >= F.col("m") * lowest)
    head = (F.col("n") - F.ceil((F.col("n") + F.col("m")) * (lowest / 2) - 1e-9) + 1).cast("int")
    prefix = by_rarity("t").join(sizes, alike).select("id", "n", "m", F.explode(F.transform(F.slice("o", F.lit(1), head), lambda e: e["word"])).alias("word"))
    fuller = prefix.where("n >= m").select("id", F.struct("word", "n", "m").alias("k"))
    lesser = prefix.where("n <= m").select("id", F.struct("word", F.col("m").alias("n"), F.col("n").alias("m")).alias("k"))
    met = meet(shorts, rows.select("id", "flat")).unionByName(meet(rarest, words_of)).unionByName(meet(fuller, lesser)).distinct()
    side = lambda n: rows.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("form", "t", "short", "flat")])
    pairs = met.join(side("a"), "a").join(side("b"), "b")
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    short = ((F.col("a_flat") == F.col("b_short")) & (F.size("b_t") > 1)) | ((F.col("b_flat") == F.col("a_short")) & (F.size("a_t") > 1))
    within = padded("a_form").contains(padded("b_form")) | padded("b_form").contains(padded("a_form"))
    like = F.round(dice(F.col("a_t"), F.col("b_t")), 4)
    reason = F.when(short, "acronym").when(within, "containment").when(like >= least, "lexical")
    score = F.when(short, 0.9).when(within, 0.75).otherwise(like)
    return same.unionByName(pairs.select("a", "b", score.alias("score"), reason.alias("reason")).where(F.col("reason").isNotNull()))


def merge_entities(entities: DataFrame, merges: DataFrame, undone: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Entities with ``entity``, the smallest of all that merges (a, b) join them with. ``undone`` (a, b): merges taken back, as if never made."""
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    kept = pair(merges) if undone is None else pair(merges).join(pair(undone), ["a", "b"], "left_anti")
    roots = clusters(kept).select(F.col("id").alias("_m"), "root")
    return entities.join(roots, F.col(key) == F.col("_m"), "left").withColumn("entity", F.coalesce("root", key)).drop("_m", "root")


def reflect(events: DataFrame, month: str, per_section: int = 25) -> DataFrame:
    """The events of a month by section: one per (event, lineage), the newest ``per_section`` of each. events: lineage, event, section, at."""
    inside = events.where(F.date_format("at", "yyyy-MM") == month).groupBy("event", "lineage", "section").agg(F.max("at").alias("at"))
    n = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("at"), "lineage", "event"))
    return inside.withColumn("n", n.cast("long")).where(F.col("n") <= per_section)
