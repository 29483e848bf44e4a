"""Access, classification and freshness rules that label every candidate with the first reason against it.

Rules never filter: each row keeps a ``reason_code`` (null: no objection), so exclusions can be explained later. Extension point:
a rule is a pair (code, condition); ``verdict`` takes any ordered list of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import age_days, policy_days

#: Roles from the most to the least powerful.
ROLES = ("owner", "editor", "viewer")


def principals(user_id: Column, role: Column) -> Column:
    """user:<id>, project:* and every role that the given one includes."""
    held = F.array(*[F.lit(f"role:{r}") for r in ROLES])
    below = F.when(role == "owner", held).when(role == "editor", F.slice(held, 2, 2)).when(role == "viewer", F.slice(held, 3, 1)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("project:*"), F.concat(F.lit("user:"), user_id.cast("string"))), below)


def acl_allows(acl: Column, held: Column) -> Column:
    """Overlap; an empty or missing list denies."""
    return F.coalesce(F.arrays_overlap(acl, held), F.lit(False))


def clearance(*levels: Column) -> Column:
    """The smallest level given, between 0 and 3; nulls set no limit."""
    return F.greatest(F.lit(0), F.least(F.lit(3), *levels))


def merge_acls(df: DataFrame, key: str, acl: str, level: str) -> DataFrame:
    """Derived rights: the principals that all restricted sources' lists have, and the highest level.

    A list with project:* and an empty or missing one do not narrow access; without a restricted list everybody in the project may
    read. Principals are counted for each group, so that no list of a group is left out and none has to fit a row with the others.
    """
    narrow = F.coalesce((F.size(acl) > 0) & ~F.array_contains(acl, "project:*"), F.lit(False))
    total = df.groupBy(key).agg(F.count_if(narrow).alias("_n"), F.max(level).alias("level"))
    held = df.where(narrow).select(F.col(key).alias("_key"), F.explode(F.array_distinct(acl)).alias("_p")).groupBy("_key", "_p").agg(F.count("*").alias("_c"))
    shared = held.join(total.select(key, "_n"), F.col("_key").eqNullSafe(F.col(key)) & (F.col("_c") == F.col("_n"))).groupBy("_key").agg(F.array_sort(F.collect_list("_p")).alias("_acl"))
    merged = total.join(shared, F.col(key).eqNullSafe(F.col("_key")), "left")
    everybody = F.when(F.col("_n") == 0, F.array(F.lit("project:*"))).otherwise(F.array().cast("array<string>"))
    return merged.select(key, F.coalesce("_acl", everybody).alias("acl"), "level")


def access_scope(acl: Column) -> Column:
    n = F.coalesce(F.size(acl), F.lit(0))
    return F.when(n <= 0, "restricted").when(F.array_contains(acl, "public:*"), "public").when(F.array_contains(acl, "project:*"), "project").otherwise("restricted")


def valid_principals(acl: Column) -> Column:
    """Trimmed, distinct entries of the known forms."""
    return F.array_distinct(F.filter(F.transform(acl, lambda p: F.trim(p)), lambda p: p.rlike(r"^(user|role|group|project|public):[A-Za-z0-9_.*@-]+$")))


def parse_acl(text: Column) -> Column:
    return valid_principals(F.split(F.coalesce(text, F.lit("")), r"\s*[,;]\s*"))


@dataclass(frozen=True)
class Context:
    """What a request may see."""

    held: tuple[str, ...]
    clearance: int
    now: str
    requester: str | None = None
    scopes: tuple[str, ...] = ("short_term", "project", "long_term", "user")
    source_kinds: tuple[str, ...] | None = None
    include_sources: bool = True
    min_relevance: float = 0.2
    freshness: dict[str, int] = field(default_factory=dict)
    freshness_override: int | None = None


def rules(ctx: Context) -> list[tuple[str, Column]]:
    """The ordered rules over columns candidate_type, status, acl, level, quarantined, scope, subject, source_kind, kind, date,
    valid_to, expires_at, provenance_kinds, pinned, score."""
    now, held = F.lit(ctx.now).cast("timestamp"), F.array(*[F.lit(p) for p in ctx.held])
    c = F.col
    memory, chunk, session = (c("candidate_type") == kind for kind in ("memory", "chunk", "session"))
    scope = F.coalesce(c("scope"), F.lit("project"))
    own = F.concat(F.lit("user:"), c("subject"))
    subject_only = memory & (scope == "user") & c("subject").isNotNull() & F.forall("acl", lambda p: p == own) & (F.size("acl") > 0)
    foreign = F.lit(True) if ctx.requester is None else (c("subject").isNull() | (c("subject") != ctx.requester))
    kinds = F.lit(False) if ctx.source_kinds is None else ~F.coalesce(c("source_kind").isin(*ctx.source_kinds), F.lit(False))
    outside = F.when(memory, ~scope.isin(*ctx.scopes) | ((scope == "user") & foreign)).when(chunk, F.lit(not ctx.include_sources) | kinds).otherwise(F.lit("short_term" not in ctx.scopes))
    age = F.floor(age_days(c("date"), now))
    chunk_limit = policy_days(c("source_kind"), ctx.freshness, ctx.freshness_override)
    if ctx.freshness_override is not None:
        memory_limit = F.lit(ctx.freshness_override)
    else:
        limits = F.transform("provenance_kinds", lambda k: policy_days(k, ctx.freshness))
        memory_limit = F.when((F.size("provenance_kinds") > 0) & F.forall(limits, lambda d: d.isNotNull()), F.array_max(limits))
    durable = scope.isin("long_term", "user", "short_term") | ((c("status") == "validated") & (c("kind") == "decision"))
    closed = c("status").isin("superseded", "obsolete")
    stale_memory = ~closed & (F.coalesce(c("valid_to") <= now, F.lit(False)) | (~durable & F.coalesce(age > memory_limit, F.lit(False))))
    stale = ~c("pinned") & ~session & F.when(memory, stale_memory).otherwise(F.coalesce(age > chunk_limit, F.lit(False)))
    return [
        ("EXCLUDED_FORGOTTEN", c("status") == "forgotten"),
        ("EXCLUDED_ACL", ~acl_allows(c("acl"), held) & ~F.coalesce(subject_only, F.lit(False))),
        ("EXCLUDED_CLASSIFICATION", c("level") > ctx.clearance),
        ("EXCLUDED_QUARANTINE", c("quarantined")),
        ("EXCLUDED_SCOPE", outside),
        ("EXCLUDED_EXPIRED", memory & (scope == "short_term") & (c("expires_at") <= now)),
        ("EXCLUDED_STALE", stale),
        ("EXCLUDED_SUPERSEDED", (c("status") == "superseded") | (memory & (c("status") == "obsolete"))),
        ("EXCLUDED_LOW_SCORE", ~c("pinned") & ~session & (c("score") < ctx.min_relevance)),
    ]


def verdict(ordered: list[tuple[str, Column]]) -> Column:
    """The code of the first rule that holds; unknown conditions do not hold."""
    return F.coalesce(*[F.when(F.coalesce(condition, F.lit(False)), code) for code, condition in ordered], F.lit(None).cast("string"))


def redact(df: DataFrame, visible: Column, *columns: str) -> DataFrame:
    """Null in the named columns of rows that may not be seen."""
    return df.withColumns({name: F.when(F.coalesce(visible, F.lit(False)), F.col(name)) for name in columns})


def hidden_targets(events: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Events with ``hidden``: an unknown target is hidden."""
    return events.join(targets.select(F.col(key).alias("_t"), "readable"), F.col(key) == F.col("_t"), "left").withColumn("hidden", ~F.coalesce("readable", F.lit(False))).drop("_t", "readable")
