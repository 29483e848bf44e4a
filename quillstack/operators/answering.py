"""From a task to served items: rewriting, scopes, hydration, hybrid search, follow-ups, anchors, pins, profiles, feedback."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import fold, squeeze, terms
from .search import fuse, top_k

#: Where a task falls into parts, and the words that join two of them.
PARTS = r"(?i)\s*(?:\n+\s*(?:[-*•]|\d+[.)])?\s*|;\s*|\?\s+|\s+puis\s+|\s+ensuite\s+|\s+then\s+)"
JOINTS = r"(?i),?\s+(?:et|and|ainsi que)\s+"
MIN_WORDS, MOST_PARTS, LEAST_TERMS = 12, 4, 2


def key_terms(text: Column, most: int = 24) -> Column:
    """The ``most`` most frequent terms of a text, those of equal frequency in order of their first place."""
    t = terms(text)
    each = F.transform(F.array_distinct(t), lambda x: F.struct((-F.size(F.filter(t, lambda y: y == x))).alias("often"), F.array_position(t, x).alias("first"), x.alias("term")))
    return F.transform(F.slice(F.array_sort(each), 1, most), lambda e: e["term"])


def where_clauses(filters: Mapping[str, object]) -> Column:
    """One condition from a mapping: a scalar is an equality, a list a membership, a mapping of gt, gte, lt, lte a range, None nothing."""
    compare: dict[str, Callable[[Column, object], Column]] = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
    out = F.lit(True)
    for name, value in filters.items():
        if isinstance(value, Mapping):
            for op, bound in value.items():
                out = out & compare[op](F.col(name), F.lit(bound))
        elif isinstance(value, list | tuple | set | frozenset):
            out = out & F.col(name).isin(*value)
        elif value is not None:
            out = out & (F.col(name) == F.lit(value))
    return F.coalesce(out, F.lit(False))


def in_scope(project: object, organisation: Column, scope: Column) -> Column:
    """Items of the project, and long-term items of the whole organisation."""
    return F.coalesce((F.col("project") == F.lit(project)) | (organisation & (scope == "long_term")), F.lit(False))


def action_matches(action: Column, wanted: str) -> Column:
    """The action itself or one below it: ``memory`` matches ``memory.validated``."""
    return (action == wanted) | action.startswith(f"{wanted}.")


def decompose(tasks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, subtopic): the parts of a task of twelve words and more that hold two terms and more; none for a single part."""
    n_words = lambda c: F.size(F.filter(F.split(squeeze(c), " "), lambda w: w != ""))
    pieces = F.flatten(F.transform(F.split(F.col(text), PARTS), lambda p: F.when(n_words(p) >= MIN_WORDS // 2, F.split(p, JOINTS)).otherwise(F.array(p))))
    clean = F.transform(pieces, lambda p: F.regexp_replace(p, r"^[ ,.:;?!\-–—\n\t]+|[ ,.:;?!\-–—\n\t]+$", ""))
    rows = tasks.where(n_words(F.col(text)) >= MIN_WORDS).select(key, F.posexplode(clean).alias("at", "subtopic"))
    rows = rows.withColumn("t", F.array_sort(F.array_distinct(terms(F.col("subtopic"))))).where(F.size("t") >= LEAST_TERMS)
    once = rows.groupBy(key, "t").agg(F.min(F.struct("at", "subtopic")).alias("r")).select(key, "r.at", "r.subtopic")
    place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    found = once.withColumn("place", place.cast("long")).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    return found.where((F.col("n") > 1) & (F.col("place") <= MOST_PARTS)).select(key, "place", "subtopic")


#: A long name of up to seven words with its short form in brackets.
LONG_AND_SHORT = r"([A-ZÀ-Ý][\w'’-]+(?:[ -][\w'’-]+){0,6})\s*\(([A-Z][A-Z0-9]{1,9})\)"


def aliases_of_titles(titles: DataFrame, title: str = "title") -> DataFrame:
    """(gram, alias) from titles of the form ``Long Name (ABBR)``, both ways; the name keeps as many last words as the short form has letters."""
    found = titles.select(F.explode(F.arrays_zip(F.regexp_extract_all(F.col(title), F.lit(LONG_AND_SHORT), F.lit(1)).alias("name"), F.regexp_extract_all(F.col(title), F.lit(LONG_AND_SHORT), F.lit(2)).alias("short"))).alias("m"))
    words, short = F.split("m.name", " "), F.col("m.short")
    name = F.when(F.size(words) > F.length(short), F.array_join(F.slice(words, -F.length(short), F.length(short)), " ")).otherwise(F.col("m.name"))
    rows = found.select(name.alias("name"), short.alias("short"))
    return rows.select(fold(F.col("name")).alias("gram"), F.col("short").alias("alias")).unionByName(rows.select(fold(F.col("short")).alias("gram"), F.col("name").alias("alias"))).distinct()


#: Folded terms of project work and their equivalents, in the order in which they are offered.
SYNONYMS = {
    "bdd": ("base de données", "database"),
    "base de donnees": ("bdd", "database"),
    "database": ("base de données",),
    "mep": ("mise en production", "déploiement"),
    "mise en production": ("mep", "déploiement", "release"),
    "deploiement": ("mise en production", "release"),
    "authentification": ("auth", "login", "SSO"),
    "sso": ("authentification unique", "single sign-on"),
    "delai": ("échéance", "deadline", "planning"),
    "echeance": ("délai", "deadline"),
    "deadline": ("échéance", "délai"),
    "budget": ("coût", "chiffrage"),
    "cout": ("budget", "chiffrage"),
    "exigence": ("besoin", "requirement"),
    "besoin": ("exigence", "requirement"),
    "risque": ("risk", "menace"),
    "decision": ("arbitrage", "choix"),
    "choix": ("décision", "arbitrage"),
    "rgpd": ("données personnelles", "GDPR"),
    "securite": ("sécurité", "security"),
    "api": ("interface", "endpoint"),
    "facturation": ("factures", "billing"),
    "client": ("customer",),
    "test": ("recette", "qualification"),
    "recette": ("tests", "qualification"),
}


def synonyms(spark: SparkSession) -> DataFrame:
    """(gram, alias, rank) of the equivalents that hold for every project."""
    return spark.createDataFrame([(gram, alias, rank) for gram, others in SYNONYMS.items() for rank, alias in enumerate(others)], "gram string, alias string, rank int")


def expand(tasks: DataFrame, aliases: DataFrame, key: str, text: str = "text", most: int = 8) -> DataFrame:
    """(key, place, alias): other names of the one to three word runs of a task that it does not hold itself, by place in the task.

    aliases: gram, alias and, where the names of a run have an order, rank; names without one come after those with one, by name.
    """
    if "rank" not in aliases.columns:
        aliases = aliases.withColumn("rank", F.lit(None).cast("int"))
    low = fold(F.col(text))
    w = F.regexp_extract_all(low, F.lit(r"[a-z0-9_'’-]+"), F.lit(0))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
    rows = tasks.select(key, low.alias("low"), w.alias("w")).where(F.size("w") > 0)
    grams = rows.select(key, "low", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("gram"))
    met = grams.join(aliases, "gram").where(~F.col("low").contains(fold(F.col("alias"))))
    first = met.groupBy(key, "alias").agg(F.min(F.struct(F.expr("locate(gram, low)").alias("at"), "gram", F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"))).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first", "alias"))
    return first.withColumn("place", place.cast("long")).where(F.col("place") <= most).select(key, "place", "alias")


def hydrate(hits: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Hits with the columns of the source of truth; hits of rows that are gone or no longer active are dropped."""
    return hits.join(source.where("status = 'active'").drop("status"), key)


def hybrid(lexical: DataFrame | None, dense: DataFrame | None, query: str, item: str) -> DataFrame:
    """Fused ranks of the lists there are, with ``mode``: hybrid, or the name of the only list that answered a query."""
    lists = [part.select(query, item, "rnk", F.lit(name).alias("list_name")) for name, part in (("lexical", lexical), ("dense", dense)) if part is not None]
    if not lists:
        raise ValueError("no list to fuse")
    every = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    modes = every.groupBy(query).agg(F.when(F.count_distinct("list_name") > 1, "hybrid").otherwise(F.max("list_name")).alias("mode"))
    return fuse(every, query, item).join(modes, query)


def merge_sources(hits: DataFrame, query: str, item: str) -> DataFrame:
    """(query, item, score, signals) of the lists of several sources: an item once, with its best score and the lists that had it."""
    return hits.groupBy(query, item).agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("list_name")), "+").alias("signals"))


def uncovered(subtopics: DataFrame, served: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, place, subtopic, rest): subtopics of which no served text has half of the terms. served: key, text."""
    asked = subtopics.select(key, "place", "subtopic", F.array_distinct(terms(F.col("subtopic"))).alias("t")).where(F.size("t") > 0)
    texts = served.select(key, F.array_distinct(terms(F.col("text"))).alias("d"))
    share = F.size(F.array_intersect("t", "d")) / F.size("t")
    best = asked.join(texts, key, "left").groupBy(key, "place", "subtopic").agg(F.coalesce(F.max(share), F.lit(0.0)).alias("share"))
    return best.where(F.col("share") < least).drop("share")


def rounds(tasks: DataFrame, subtopics: DataFrame, search: Callable[[DataFrame], DataFrame], texts: DataFrame, key: str, item: str, most: int = 3, discount: float = 0.85) -> DataFrame:
    """(key, item, score, round): hits of a task, then of its subtopics that nothing served covers, at most ``most`` rounds.

    search: a function from (key, text) to (key, item, score, rnk). Later rounds count less; the best score of an item stays.
    """
    hits = search(tasks.select(key, "text")).select(key, item, "score").withColumn("round", F.lit(1).cast("long"))
    for turn in range(2, most + 1):
        served = hits.select(key, item).distinct().join(texts, item).select(key, "text")
        left = uncovered(subtopics, served, key)
        asked = left.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "subtopic"))), lambda s: s["subtopic"]), " ").alias("text"))
        more = search(asked).select(key, item, F.round(F.col("score") * discount ** (turn - 1), 6).alias("score")).withColumn("round", F.lit(turn).cast("long"))
        hits = hits.unionByName(more)
    return hits.groupBy(key, item).agg(F.max("score").alias("score"), F.min("round").alias("round"))


def follow_up(hits: DataFrame, served: DataFrame, query: str, item: str, allowed: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """The next ``k`` hits that were not served and may be read, and (query, withheld): how many more may not be."""
    fresh = hits.join(served.select(query, item).distinct(), [query, item], "left_anti").withColumn("_ok", F.coalesce(allowed, F.lit(False)))
    withheld = fresh.groupBy(query).agg(F.count_if(~F.col("_ok")).alias("withheld"))
    return top_k(fresh.where("_ok").drop("_ok", "rnk"), query, item, k), withheld


def newly_served(before: DataFrame, after: DataFrame, query: str, item: str) -> DataFrame:
    """Items of a completed request that the first one did not serve; pinned items are not news."""
    return after.where("reason_code <> 'INCLUDED_PINNED'").join(before.where("included").select(query, item), [query, item], "left_anti").select(query, item)


def anchors(hits: DataFrame, items: DataFrame, project: str, item: str, decisions: int = 20, preferences: int = 10) -> DataFrame:
    """(project, item, rrf): the newest decisions and preferences of a project that were not found, at the score of the last hit.

    items: project, item, kind, status, at of current items.
    """
    n = F.row_number().over(Window.partitionBy(project, "kind").orderBy(F.desc("at"), F.col(item)))
    wanted = ((F.col("kind") == "decision") & F.col("status").isin("validated", "superseded")) | ((F.col("kind") == "preference") & (F.col("status") == "validated"))
    newest = items.where(wanted).withColumn("_n", n).where(F.col("_n") <= F.when(F.col("kind") == "decision", decisions).otherwise(preferences))
    tail = hits.groupBy(project).agg(F.min("rrf").alias("rrf"))
    left = newest.select(project, item).join(hits.select(project, item).distinct(), [project, item], "left_anti")
    return left.join(tail, project, "left").select(project, item, F.coalesce("rrf", F.lit(0.0)).alias("rrf"))


def newest_pool(items: DataFrame, group: str, at: str, key: str, size: int) -> DataFrame:
    """The ``size`` newest items of each group: the pool that new ones are compared with."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(at), F.desc(key)))
    return items.withColumn("_n", n).where(F.col("_n") <= size).drop("_n")


def relation_candidates(*lists: DataFrame) -> DataFrame:
    """(item, other, found_by) of candidate lists (item, other, list_name): each pair once with the lists that have it."""
    every = lists[0]
    for part in lists[1:]:
        every = every.unionByName(part)
    return every.where("item <> other").groupBy("item", "other").agg(F.array_join(F.array_sort(F.collect_set("list_name")), "+").alias("found_by"))


def with_pins(found: DataFrame, pins: DataFrame, stored: DataFrame, item: str) -> DataFrame:
    """(item, state): pinned items with what was found; pins that no longer exist are ghosts with their stored title."""
    known = stored.select(F.col(item).alias("_s"), F.col("title").alias("_t"))
    rows = pins.join(known, F.col(item) == F.col("_s"), "left")
    pinned = rows.select(item, F.coalesce("_t", "title").alias("title"), F.when(F.col("_s").isNull(), "ghost").otherwise("pinned").alias("state"))
    rest = found.join(pins.select(item), item, "left_anti").join(stored, item).select(item, "title", F.lit("found").alias("state"))
    return pinned.unionByName(rest)


#: The section each kind of candidate is served under.
SECTIONS = {"decision": "decisions", "requirement": "requirements", "constraint": "constraints", "risk": "constraints", "preference": "preferences", "procedure": "procedures", "learning": "procedures"}


def section_of(candidate_type: Column, kind: Column) -> Column:
    named = F.element_at(F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair]), kind)
    return F.when(candidate_type == "chunk", "sources").when(candidate_type == "session", "session").otherwise(F.coalesce(named, F.lit("facts")))


def outside_profile(candidate_type: Column, kind: Column, pinned: Column, sections: list[str]) -> Column:
    """Whether a candidate's section is not part of an agent's profile; pinned ones always are."""
    return ~section_of(candidate_type, kind).isin(*sections) & ~pinned


def applies(task_types: Column, agent_kinds: Column, intent: Column, agent: Column) -> tuple[Column, Column]:
    """Whether a procedure fits a request, and the reason if not: task or agent. Empty lists and unknown sides fit all."""
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    task = some(task_types) & intent.isNotNull() & ~F.array_contains(task_types, intent) & ~F.array_contains(task_types, "general")
    kind = some(agent_kinds) & agent.isNotNull() & ~F.array_contains(agent_kinds, agent)
    task, kind = F.coalesce(task, F.lit(False)), F.coalesce(kind, F.lit(False))
    return ~task & ~kind, F.when(task, "task").when(kind, "agent")


def can_read(level: Column, acls: list[Column], scope: Column, subject: Column, held: list[str], clearance: int, user: str | None) -> Column:
    """The read rule of a viewer: level, every list, and personal memory only for its subject, whose own list need not name others."""
    mine = F.lit(False) if user is None else F.coalesce(subject == user, F.lit(False))
    personal = F.coalesce(scope == "user", F.lit(False))
    own = lambda acl: personal & F.coalesce((F.size(acl) > 0) & F.forall(acl, lambda p: p == F.concat(F.lit("user:"), subject)), F.lit(False))
    out = (level <= clearance) & (~personal | mine)
    for acl in acls:
        out = out & (F.coalesce(F.arrays_overlap(acl, F.array(*[F.lit(p) for p in held])), F.lit(False)) | own(acl))
    return out


def rebuild(decisions: DataFrame, current: DataFrame, item: str, readable: Column) -> DataFrame:
    """Stored decisions as their reader may see them now: gone and forgotten items and those above the reader's rights lose title and text."""
    now = current.select(F.col(item).alias("_i"), F.col("status").alias("_status"), readable.alias("_ok"))
    rows = decisions.join(now, F.col(item) == F.col("_i"), "left")
    state = F.when(F.col("_i").isNull() | (F.col("_status") == "forgotten"), "forgotten").when(~F.coalesce("_ok", F.lit(False)), "restricted").otherwise("full")
    rows = rows.withColumn("state", state)
    return rows.withColumns({c: F.when(F.col("state") == "full", F.col(c)) for c in ("title", "excerpt")}).drop("_i", "_status", "_ok")


def teasers(items: DataFrame, text: str, tokens: int = 40) -> DataFrame:
    """Items with a teaser of at most so many tokens and the tokens of the whole, which is fetched when it is asked for."""
    from ..functions.text import estimate_tokens, truncate_to_tokens

    return items.withColumn("teaser", truncate_to_tokens(squeeze(F.col(text)), tokens)).withColumn("full_tokens", estimate_tokens(F.col(text)))


def feedback_outcome(flags: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags on citations that a request never had, and (item, request) proposals to end memory items flagged as outdated.

    flags: request, citation, flag. decisions: request, citation, item (null for what is no memory item).
    """
    unknown = flags.join(decisions.select("request", "citation"), ["request", "citation"], "left_anti")
    proposals = flags.where("flag = 'outdated'").join(decisions.where("item is not null"), ["request", "citation"]).select("item", "request").distinct()
    return unknown, proposals


def suggest_profile(decisions: DataFrame, ratings: DataFrame, kind: str, base: float = 0.3, least: int = 3, ratio: float = 0.3) -> DataFrame:
    """(kind, n_feedback, avg_rating, irrelevant_ratio, min_relevance, drop_sections): what feedback on an agent kind's contexts suggests.

    decisions: kind, section, flag of served items. ratings: kind, rating. Too few ratings suggest nothing.
    """
    per = decisions.groupBy(kind, "section").agg(F.count("*").alias("served"), F.count_if(F.col("flag") == "irrelevant").alias("bad"))
    bad = F.when((F.col("bad") >= least) & (F.col("bad") / F.col("served") >= 0.5), F.col("section"))
    shares = per.groupBy(kind).agg((F.sum("bad") / F.sum("served")).alias("r"), F.array_join(F.array_sort(F.collect_set(bad)), ",").alias("drop"))
    rows = ratings.groupBy(kind).agg(F.count("*").alias("n_feedback"), F.round(F.avg("rating"), 2).alias("avg_rating")).join(shares, kind, "left")
    enough = F.col("n_feedback") >= least
    return rows.select(
        kind,
        "n_feedback",
        "avg_rating",
        F.round("r", 4).alias("irrelevant_ratio"),
        F.when(enough & (F.col("r") > ratio), F.round(F.least(F.lit(0.9), F.lit(base + 0.05)), 2)).alias("min_relevance"),
        F.when(enough, F.nullif(F.col("drop"), F.lit(""))).alias("drop_sections"),
    )


def compare_runs(base: DataFrame, target: DataFrame, case: str, value: str) -> DataFrame:
    """(case, base, target, delta) of two evaluation runs; cases of one run alone keep a null side."""
    a, b = base.select(case, F.col(value).alias("base")), target.select(case, F.col(value).alias("target"))
    return a.join(b, case, "full_outer").withColumn("delta", F.round(F.col("target") - F.col("base"), 4))


def new_cases(decisions: DataFrame, covered: DataFrame, key: str, at: str, most: int = 10) -> DataFrame:
    """(key, question): the newest validated decisions that no case expects yet, as questions."""
    left = decisions.join(covered.select(key), key, "left_anti").orderBy(F.desc(at), key).limit(most)
    return left.select(key, F.concat(F.lit("What was decided about “"), "title", F.lit("”?")).alias("question"))
