"""The life of memory items: evidence, current versions, expiry, consolidation, purges, conflicts, snapshots, timelines.

Everything is set-based over keys: an item is followed to its lineage's current version by a join, never row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import content_terms, dice, fold, squeeze
from .memory import current_versions, divergence

#: Trust from least to most.
TRUST = ("low", "medium", "high")
#: Kinds whose items can replace, contradict or repeat each other; other kinds are families of their own.
FAMILY = {"fact": "statement", "constraint": "statement", "requirement": "statement", "summary": "statement"}
OPEN = ("proposed", "validated")


def kind_family(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair]), kind), kind)


def resolve_current(items: DataFrame, refs: DataFrame, ref: str = "id") -> DataFrame:
    """``refs`` with current_id, current_version and current_status of the lineage that the named version belongs to."""
    now = current_versions(items).select(F.col("lineage").alias("_l"), F.col("id").alias("current_id"), F.col("version").alias("current_version"), F.col("status").alias("current_status"))
    known = items.select(F.col("id").alias("_id"), "lineage").join(now, F.col("lineage") == F.col("_l")).drop("_l")
    return refs.join(known, F.col(ref) == F.col("_id")).drop("_id")


def provenance_rollup(items: DataFrame, provenance: DataFrame) -> DataFrame:
    """(lineage, trust, kinds, n_chunks): the least trust, the source kinds and the number of chunks of all a lineage's evidence."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TRUST]), F.col("trust"))
    joined = provenance.join(items.select(F.col("id").alias("item"), "lineage"), "item")
    rows = joined.groupBy("lineage").agg(F.min(rank).alias("r"), F.array_sort(F.collect_set("source_kind")).alias("kinds"), F.count_distinct("chunk").alias("n_chunks"))
    return rows.select("lineage", F.element_at(F.array(*[F.lit(t) for t in TRUST]), F.col("r").cast("int")).alias("trust"), "kinds", "n_chunks")


def provenance_floor(provenance: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item, floor): the highest level of an item's evidence; a chunk without a level of its own has its document's, unknown ones 0."""
    rows = provenance.join(chunks.select("chunk", F.col("level").alias("_c")), "chunk", "left").join(documents.select("document", F.col("level").alias("_d")), "document", "left")
    return rows.groupBy("item").agg(F.max(F.coalesce("_c", "_d", F.lit(0))).alias("floor"))


def create_items(drafts: DataFrame, provenance: DataFrame, documents: DataFrame, ttl_hours: int = 12) -> DataFrame:
    """(item, level, status, expires_at) of new items: not below the level of their evidence; short-term ones expire.

    drafts: item, level, scope, created_at, confidence. provenance: item, document. documents: document, level.
    """
    floor = provenance.join(documents.select("document", F.col("level").alias("_d")), "document").groupBy(F.col("item").alias("_i")).agg(F.max("_d").alias("_floor"), F.count_distinct("document").alias("n_sources"))
    rows = drafts.join(floor, F.col("item") == F.col("_i"), "left")
    level = F.greatest("level", F.coalesce("_floor", F.lit(0)))
    expires = F.when(F.col("scope") == "short_term", F.col("created_at") + F.make_interval(hours=F.lit(ttl_hours)))
    return rows.select("item", level.alias("level"), F.when(F.coalesce("n_sources", F.lit(0)) > 1, "validated").otherwise("proposed").alias("status"), expires.alias("expires_at"))


def supersede_versions(chunks: DataFrame, document: str = "document", version: str = "version") -> tuple[DataFrame, DataFrame]:
    """The chunks with status active or superseded, and the edges (newer, older) from each version to the one before."""
    newest = F.max(version).over(Window.partitionBy(document))
    marked = chunks.withColumn("status", F.when(F.col(version) < newest, "superseded").otherwise("active"))
    versions = chunks.select(document, version).distinct()
    before = F.lag(version).over(Window.partitionBy(document).orderBy(version))
    edges = versions.withColumn("older", before).where(F.col("older").isNotNull()).select(document, F.col(version).alias("newer"), "older")
    return marked, edges


def missing_statements(items: DataFrame, provenance: DataFrame, restated: DataFrame, document: int | str, version: int) -> DataFrame:
    """(item): proposed items that only older versions of a document support, that its new version does not restate.

    items: item, status, statement. provenance: item, document, version. restated: statement of the new version.
    """
    own = provenance.where((F.col("document") == document) & (F.col("version") < version)).select("item").distinct()
    other = provenance.where((F.col("document") != document) | (F.col("version") >= version)).select("item").distinct()
    left = items.where(F.col("status") == "proposed").join(own, "item", "left_semi").join(other, "item", "left_anti")
    return left.join(restated.select("statement").distinct(), "statement", "left_anti").select("item")


def expire_short_term(items: DataFrame, now: Column) -> DataFrame:
    """Items with the status after expiry: open short-term items past their end are obsolete."""
    over = (F.col("scope") == "short_term") & F.col("status").isin(*OPEN) & F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return items.withColumns({"status": F.when(over, "obsolete").otherwise(F.col("status")), "expired": over})


def consolidate(items: DataFrame, least: float = 0.93) -> DataFrame:
    """(item, kept, similarity): items that repeat a stronger one of the same family and access, without saying otherwise.

    items: item, kind, statement, access, status, at, confidence. Equal wordings meet by their form; others meet where they share one
    of their three rarest terms, which similarity above 0.93 of term sets guarantees for sets of fewer than twenty terms and more.
    """
    rows = items.select("item", kind_family(F.col("kind")).alias("family"), "access", squeeze(fold(F.col("statement"))).alias("form"), "statement", content_terms(F.col("statement")).alias("t"), F.struct((F.col("status") == "validated").cast("int").alias("s"), "at", "confidence", "item").alias("strength"))
    one = rows.groupBy("family", "access", "form").agg(F.max("strength").alias("best"))
    same = rows.join(one, ["family", "access", "form"]).where(F.col("item") != F.col("best.item")).select("item", F.col("best.item").alias("kept"), F.lit(1.0).alias("similarity"))
    left = rows.join(same.select("item"), "item", "left_anti")
    terms = left.select("item", "family", "access", F.size("t").alias("n"), F.explode("t").alias("term"))
    often = terms.groupBy("family", "access", "term").agg(F.count("*").alias("df"))
    ordered = terms.join(often, ["family", "access", "term"]).groupBy("item", "family", "access", "n").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("o"))
    # Prefix filter for Dice: sets of n and m terms above the threshold share more than least / (2 - least) * n of either's terms.
    head = (F.col("n") - F.ceil(F.col("n") * least / (2 - least)) + 1).cast("int")
    keys = ordered.select("item", "family", "access", F.explode(F.slice("o", F.lit(1), head)).alias("e")).select("item", "family", "access", F.col("e.term").alias("key"))
    l, r = keys.alias("l"), keys.alias("r")  # noqa: E741
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.family") == F.col("r.family")) & F.col("l.access").eqNullSafe(F.col("r.access")) & (F.col("l.item") < F.col("r.item"))
    pairs = l.join(r, met).select(F.col("l.item").alias("a"), F.col("r.item").alias("b")).distinct()
    side = lambda name: left.select(F.col("item").alias(name), F.col("statement").alias(f"{name}_text"), F.col("t").alias(f"{name}_t"), F.col("strength").alias(f"{name}_s"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", F.round(dice(F.col("a_t"), F.col("b_t")), 6))
    close = both.where(F.col("similarity") > least).where(F.size(divergence(F.col("a_text"), F.col("b_text"))) == 0)
    loser, winner = F.least("a_s", "b_s"), F.greatest("a_s", "b_s")
    near = close.select(loser["item"].alias("item"), winner.alias("w"), "similarity").groupBy("item").agg(F.max(F.struct("w", "similarity")).alias("m"))
    return same.unionByName(near.select("item", F.col("m.w.item").alias("kept"), F.col("m.similarity").alias("similarity")))


def purge_copies(copies: DataFrame, forgotten: DataFrame, key: str, text: str, notice: str = "[forgotten]") -> DataFrame:
    """Stored copies with the wording of forgotten sources replaced, and the hash of what is left."""
    gone = forgotten.select(F.col(key).alias("_k")).distinct().withColumn("_gone", F.lit(True))
    rows = copies.join(gone, F.col(key) == F.col("_k"), "left")
    left = rows.withColumn(text, F.when(F.col("_gone"), notice).otherwise(F.col(text))).withColumn("purged", F.coalesce("_gone", F.lit(False)))
    return left.withColumn("content_hash", F.sha2(text, 256)).drop("_k", "_gone")


def conflict_list(edges: DataFrame, items: DataFrame, visible: Column) -> DataFrame:
    """(a, b, winner, loser_visible): contradictions of which both ends are current, open and visible, with the end to keep.

    Ends are followed to their lineage's current version; an edge within one lineage is none. Validated beats proposed, then the
    newer, then the surer one.
    """
    now = current_versions(items).where(F.col("status").isin(*OPEN)).where(visible)
    strength = F.struct((F.col("status") == "validated").cast("int").alias("s"), "created_at", "confidence", "id")
    ends = items.select(F.col("id").alias("_ref"), "lineage").join(now.select("lineage", F.col("id").alias("_now"), strength.alias("_s")), "lineage").select("_ref", "_now", "_s")
    side = lambda name: ends.select(F.col("_ref").alias(name), F.col("_now").alias(f"{name}_id"), F.col("_s").alias(f"{name}_s"))
    both = edges.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(F.col("a_id") != F.col("b_id"))
    pairs = both.select(F.least("a_s", "b_s").alias("lo"), F.greatest("a_s", "b_s").alias("hi"))
    return pairs.select(F.least("lo.id", "hi.id").alias("a"), F.greatest("lo.id", "hi.id").alias("b"), F.col("hi.id").alias("winner")).distinct()


def outdated_since(snapshot: DataFrame, items: DataFrame) -> DataFrame:
    """(key, reason) of a snapshot's items that are no longer what was stored: superseded, obsolete, forgotten or edited."""
    now = resolve_current(items, snapshot.select(F.col("id").alias("key")), "key")
    reason = F.when(F.col("current_status").isin("forgotten", "superseded", "obsolete"), F.col("current_status")).when(F.col("current_id") != F.col("key"), "edited")
    return now.select("key", reason.alias("reason")).where(F.col("reason").isNotNull()).distinct()


def timeline(*parts: DataFrame) -> DataFrame:
    """(at, kind, label, item, place): entries of several sources, equal ones once, the oldest first."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    once = every.dropDuplicates(["at", "kind", "label", "item"])
    place = F.row_number().over(Window.partitionBy("item").orderBy("at", "kind", "label"))
    return once.withColumn("place", place.cast("long"))


def triage(items: DataFrame, actions: DataFrame) -> DataFrame:
    """(item, status, outcome) after a batch of decisions on proposals: only proposed items change, the last action of an item counts.

    actions: item, action (accept, reject, defer), turn.
    """
    last = actions.groupBy(F.col("item").alias("_a")).agg(F.max_by("action", "turn").alias("action"))
    rows = items.join(last, F.col("item") == F.col("_a"))
    open_ = F.col("status") == "proposed"
    status = F.when(open_ & (F.col("action") == "accept"), "validated").when(open_ & (F.col("action") == "reject"), "obsolete").otherwise(F.col("status"))
    outcome = F.when(~open_, "skipped").when(F.col("action") == "defer", "deferred").otherwise("applied")
    return rows.select("item", status.alias("status"), outcome.alias("outcome"))


def mentions(texts: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity): texts that hold an alias of an entity at word borders. Runs of one to three words meet the aliases by equality.

    aliases: entity, alias of at most three words.
    """
    named = aliases.select("entity", squeeze(fold(F.col("alias"))).alias("form")).where(F.col("form") != "").distinct()
    words = F.regexp_extract_all(fold(F.col(text)), F.lit("[a-z0-9#]+"), F.lit(0))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
    rows = texts.select(F.col(key), words.alias("w")).where(F.size("w") > 0)
    found = rows.select(key, F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("form"))
    return found.join(named, "form").select(key, "entity").distinct()


def graph_of(items: DataFrame, relations: DataFrame, provenance: DataFrame, mentioned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, type) and edges (src, dst, type) of memory: current items, their relations, documents and entities."""
    now = current_versions(items).select(F.concat(F.lit("m:"), "id").alias("node"), F.col("id").alias("_id"))
    to_now = resolve_current(items, items.select(F.col("id").alias("_ref")), "_ref").select("_ref", F.concat(F.lit("m:"), "current_id").alias("node"))
    end = lambda column: to_now.select(F.col("_ref").alias(column), F.col("node").alias(f"_{column}"))
    related = relations.join(end("a"), "a").join(end("b"), "b").where(F.col("_a") != F.col("_b")).select(F.col("_a").alias("src"), F.col("_b").alias("dst"), F.lit("relation").alias("type"))
    sourced = provenance.join(to_now, F.col("item") == F.col("_ref")).select(F.col("node").alias("src"), F.concat(F.lit("d:"), "document").alias("dst"), F.lit("source").alias("type"))
    named = mentioned.join(to_now, F.col("item") == F.col("_ref")).select(F.col("node").alias("src"), F.concat(F.lit("e:"), "entity").alias("dst"), F.lit("mention").alias("type"))
    edges = related.unionByName(sourced).unionByName(named).distinct()
    other = edges.where("type <> 'relation'").select(F.col("dst").alias("node"), F.when(F.col("type") == "source", "document").otherwise("entity").alias("type")).distinct()
    return now.select("node", F.lit("memory").alias("type")).unionByName(other), edges


def idle_sessions(turns: DataFrame, now: Column, ttl_hours: int = 12) -> DataFrame:
    """(session, n, last_at, state): idle sessions close after half their life, at most 12 hours; expired ones are gone."""
    idle = min(12, ttl_hours / 2)
    rows = turns.groupBy("session").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    hours = (F.unix_micros(now) - F.unix_micros("last_at")) / 3_600_000_000
    return rows.withColumn("state", F.when(hours >= ttl_hours, "expired").when(hours >= idle, "closed").otherwise("open"))


def purge_turns(turns: DataFrame, needle: str, text: str = "text", least: int = 6) -> DataFrame:
    """The turns without those that hold the folded needle; needles shorter than ``least`` purge nothing."""
    looked = squeeze(fold(F.lit(needle)))
    hit = squeeze(fold(F.col(text))).contains(looked) if len(needle.strip()) >= least else F.lit(False)
    return turns.where(~F.coalesce(hit, F.lit(False)))


def share(learnings: DataFrame, projects: DataFrame) -> DataFrame:
    """(item, project, status): validated learnings proposed to the other projects of a workspace that have no item of that wording.

    learnings: item, project, workspace, status, statement. projects: project, workspace.
    """
    known = learnings.select("project", squeeze(fold(F.col("statement"))).alias("form")).distinct()
    given = learnings.where("status = 'validated'").select("item", F.col("project").alias("origin"), "workspace", squeeze(fold(F.col("statement"))).alias("form"))
    once = given.groupBy("workspace", "form").agg(F.min(F.struct("item", "origin")).alias("g")).select("workspace", "form", "g.item", "g.origin")
    offered = once.join(projects, "workspace").where(F.col("project") != F.col("origin"))
    return offered.join(known, ["project", "form"], "left_anti").select("item", "project", F.lit("proposed").alias("status"))
