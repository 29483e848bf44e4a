"""Usage analytics: series, totals, breakdowns, latencies, alerts, regressions, knowledge gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..scratch import Scratch


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): exact interpolated percentiles of a group, null values left out.

    Equal values are counted first; the counts are dealt by range of (keys, value), and each range needs only the sum of the ranges
    before it. So neither a group nor the whole table has to fit one task.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "percentiles")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.keep(counted.repartitionByRange(width, *keys, "_v").withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*keys)
    sums = sums.withColumn("_before", F.sum("_s").over(group.orderBy("_part")) - F.col("_s")).withColumn("_n", F.sum("_s").over(group))
    same = F.col("_part") == F.col("_p")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    starts = sums.select(F.col("_part").alias("_p"), "_before", "_n", *[F.col(k).alias(f"_k_{k}") for k in keys])
    placed = ranged.join(starts, same)
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    placed = placed.withColumn("_upto", upto)
    pick = lambda at: F.min(F.when(F.col("_upto") > at, F.col("_v")))
    bounds = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_n") - 1)
        bounds += [pick(F.floor(at)).alias(f"_lo_{name}"), pick(F.ceil(at)).alias(f"_hi_{name}"), F.first(at - F.floor(at)).alias(f"_w_{name}")]
    found = placed.groupBy(*keys).agg(*bounds)
    between = lambda name: (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")).alias(name)
    return found.select(*keys, *[between(name) for name in shares])


def daily_series(events: DataFrame, at: str, value: str, slow: Column) -> DataFrame:
    """(day, n, p50, p95, total, n_slow): a row for each UTC day of the range, zero where nothing happened."""
    dated = events.withColumn("day", F.to_date(at))
    by_day = dated.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.count_if(slow).alias("n_slow"))
    middle = percentiles(dated, ["day"], value, {"p50": 0.5, "p95": 0.95})
    by_day = by_day.join(middle, "day", "left").select("day", "n", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "total", "n_slow")
    span = by_day.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(by_day, "day", "left").fillna(0, ["n", "total", "n_slow"])


def zero_filled_counts(df: DataFrame, column: str, domain: list) -> DataFrame:
    """Counts over a full domain of values, 0 for those that do not occur."""
    spark = df.sparkSession
    values = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    return F.broadcast(values).join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def ratio(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole != 0, part / whole).otherwise(0.0), 4)


def _stage_place(stages: tuple[str, ...], last: str) -> Column:
    known = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage")) if stages else F.lit(0)
    rank = F.when(F.col("stage") == last, 2).when(known > 0, 0).otherwise(1)
    return F.row_number().over(Window.orderBy(rank, known, "stage")).cast("long")  # a row for each stage


def map_averages(df: DataFrame, json: str, stages: tuple[str, ...] = (), last: str = "total") -> DataFrame:
    """(stage, n, avg_value, place) of a JSON object's numeric members: known stages in their order, then others by name, then ``last``."""
    each = df.select(F.explode(F.from_json(json, "map<string,double>")).alias("stage", "v")).where(F.col("v").isNotNull())
    return each.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("avg_value")).withColumn("place", _stage_place(stages, last))


def top_groups(df: DataFrame, key: str, k: int, visible: DataFrame | None = None) -> DataFrame:
    """The ``k`` most frequent values among the visible ones, ties by value."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    if visible is not None:
        counted = counted.join(visible.select(key), key, "left_semi")
    return counted.orderBy(F.desc("n"), key).limit(k)


def latest_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("place", n.cast("long")).where(F.col("place") <= k)


def not_retried(jobs: DataFrame, key: str, at: str, failed: Column) -> DataFrame:
    """Failed rows after which no other row of the same key came: those as late as the last row of their key."""
    last = jobs.groupBy(F.col(key).alias("_k")).agg(F.max(at).alias("_last"))
    rows = jobs.where(failed).join(last, F.col(key) == F.col("_k"), "left")
    return rows.where(F.coalesce(F.col("_last") <= F.col(at), F.lit(True))).drop("_k", "_last")


def open_edges(edges: DataFrame, key: str, ends: list[str], closed: DataFrame) -> DataFrame:
    """Edges of which neither end is closed; ``closed`` (id) lists what any of the tables that ends may name has closed."""
    each = edges.select(F.col(key).alias("_e"), F.explode(F.array_distinct(F.array(*ends))).alias("_end"))
    shut = each.join(closed.select(F.col("id").alias("_id")).distinct(), F.col("_end") == F.col("_id"), "left_semi").select("_e").distinct()
    return edges.join(shut, F.col(key) == F.col("_e"), "left_anti")


def regressions(runs: DataFrame, series: str, order: str, value: str, drop: float, floor: float) -> DataFrame:
    """Runs below the floor or lower than the one before by ``drop`` and more."""
    before = F.lag(value).over(Window.partitionBy(series).orderBy(order))
    rows = runs.withColumn("before", before)
    reason = F.when(F.col(value) < floor, "floor").when(F.col("before") - F.col(value) >= drop, "drop")
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull())


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, started, ended, n): runs of events of a key with less than ``gap`` between neighbours."""
    w = F.session_window(F.col(at), gap)
    grouped = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("started"), F.max(at).alias("ended"))
    return grouped.select(key, "started", "ended", "n")


def trend(recent: Column, older: Column) -> Column:
    rising = (recent >= 2) & (recent >= 2 * F.greatest(older, F.lit(1)))
    fading = (older >= 2) & (older >= 2 * F.greatest(recent, F.lit(1)))
    return F.when(rising, "rising").when(fading, "fading").otherwise("steady")


def gap_severity(requests: Column, askers: Column) -> Column:
    return F.when((requests >= 5) | (askers >= 3), "critical").when(requests >= 2, "recurring").otherwise("isolated")


def gap_report(topics: DataFrame, now: Column, days: int) -> DataFrame:
    """Topics asked in vain: (key, requests, askers, first_seen, last_seen, avg_score, trend, severity). topics: key, at, asker, score."""
    middle = now - F.make_interval(days=F.lit(days // 2), hours=F.lit(12 * (days % 2)))
    rows = topics.groupBy("key").agg(
        F.count("*").alias("requests"),
        F.count_distinct("asker").alias("askers"),
        F.min("at").alias("first_seen"),
        F.max("at").alias("last_seen"),
        F.round(F.avg("score"), 2).alias("avg_score"),
        F.count_if(F.col("at") >= middle).alias("recent"),
    )
    older = F.col("requests") - F.col("recent")
    return rows.withColumn("trend", trend(F.col("recent"), older)).withColumn("severity", gap_severity(F.col("requests"), F.col("askers"))).drop("recent")


def cluster_topics(topics: DataFrame, project: str = "project", overlap: float = 0.6) -> DataFrame:
    """(project, topic_id, cluster): wordings of a project, the fullest first, join the first fuller wording that leads and tells the same.

    topics: project, topic_id, terms (distinct topics of a project). Two wordings tell the same if they share two terms and more, at least
    ``overlap`` of the shorter; a wording of one term equals only itself. Equal wordings are one from the start, and the sequence is
    decided in rounds without a group for a project: a wording that no undecided earlier one tells leads, those it tells are members. Pairs are
    judged where they meet and only their minima leave the task, so that no table of pairs is moved or written.
    """
    scratch = Scratch(topics.sparkSession, "topics")
    rows = topics.where(F.size("terms") > 0).select(F.col(project).alias("project"), "topic_id", F.array_sort(F.array_distinct("terms")).alias("terms"))
    rows = scratch.keep(rows, "rows")
    heads = rows.groupBy("project", "terms").agg(F.min("topic_id").alias("head")).orderBy(F.desc(F.size("terms")), "head")
    heads = scratch.keep(heads.withColumn("no", F.monotonically_increasing_id()), "heads")  # its place in the sequence
    each = heads.where(F.size("terms") > 1).select("project", "no", F.explode("terms").alias("term"))
    rarest = each.groupBy("project", "term").agg(F.count("*").alias("df")).orderBy("df", "term").select("project", "term", F.monotonically_increasing_id().alias("place"))
    sets = each.join(scratch.keep(rarest, "terms"), ["project", "term"]).groupBy("no").agg(F.array_sort(F.collect_list("place")).alias("o"))
    least = F.greatest(F.lit(2), F.ceil(F.size("o") * overlap - 1e-9)).cast("int")
    sets = scratch.keep(sets.select("no", "o", least.alias("least")), "sets")

    leaders, left = [], sets
    while left.limit(1).count():
        later = _told(left, left).select(F.col("b").alias("no"))
        lead = scratch.keep(left.join(later.distinct(), "no", "left_anti"), "lead")
        lost = _told(lead, left).select(F.col("b").alias("no")).unionByName(lead.select("no")).distinct()
        leaders.append(lead)
        last, left = left, scratch.keep(left.join(scratch.keep(lost, "lost"), "no", "left_anti"), "left")
        if last is not sets:
            scratch.drop(last)
    every = scratch.keep(reduce(DataFrame.unionByName, leaders), "every") if leaders else sets
    members = scratch.keep(sets.join(every.select("no"), "no", "left_anti"), "members")
    led = scratch.keep(_told(every, members), "led").join(heads.select(F.col("no").alias("a"), F.col("head").alias("leader")), "a").select(F.col("b").alias("no"), "leader")
    homes = heads.join(led, "no", "left").select(F.col("project").alias("h_project"), F.col("terms").alias("h_terms"), F.coalesce("leader", "head").alias("cluster"))
    out = rows.join(scratch.keep(homes, "homes"), F.col("project").eqNullSafe(F.col("h_project")) & (F.col("terms") == F.col("h_terms")))
    return out.select(F.col("project").alias(project), "topic_id", "cluster")


def _told(first: DataFrame, later: DataFrame) -> DataFrame:
    """(b, a): for each of the ``later`` wordings that any of the ``first`` before it tells, the first of these.

    Both are (no, o, least): terms by rarity, and how many of them another wording that is as full has to share. Two that ask for the same number
    share their two rarest common terms in the first places of both; where the shorter asks for fewer, the rarest common term. A pair counts at those alone.
    """
    ends = "size(o) - least + 2"
    pairs = F.expr(f"flatten(transform(sequence(1, {ends} - 1), i -> transform(sequence(i + 1, {ends}), j -> struct(o[i - 1] AS x, o[j - 1] AS y))))")
    by_two = lambda s, no, o: s.select("least", F.col("no").alias(no), F.col("o").alias(o), F.explode(pairs).alias("k")).select("least", "k.*", no, o)
    common = F.array_intersect("oa", "ob")
    alike = by_two(first, "a", "oa").join(by_two(later, "b", "ob").hint("merge"), ["least", "x", "y"])
    alike = alike.where((F.col("a") < F.col("b")) & (F.size(common) >= F.col("least")) & (F.slice(common, 1, 2) == F.array("x", "y")))
    fuller = first.where("least > 2").select(F.col("no").alias("a"), F.col("o").alias("oa"), F.explode(F.sequence(F.lit(2), F.col("least") - 1)).alias("least"))
    fuller = fuller.select("a", "oa", "least", F.explode(F.expr("slice(oa, 1, size(oa) - least + 1)")).alias("x"))
    short = later.select(F.col("no").alias("b"), F.col("o").alias("ob"), "least", F.explode(F.expr("slice(o, 1, size(o) - least + 1)")).alias("x"))
    mixed = fuller.join(short.hint("merge"), ["least", "x"]).where((F.size(common) >= F.col("least")) & (F.slice(common, 1, 1) == F.array("x")))
    return alike.select("b", "a").unionByName(mixed.select("b", "a")).groupBy("b").agg(F.min("a").alias("a"))


def alerts(counts: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(alert, severity, place) of one row of counts: a row for each rule (name, severity, condition) that holds, the gravest first."""
    rank = {"critical": 0, "warning": 1, "info": 2}
    listed = [F.when(condition, F.struct(F.lit(rank[severity]).alias("place"), F.lit(name).alias("alert"), F.lit(severity).alias("severity"))) for name, severity, condition in rules]
    each = counts.select(F.explode(F.filter(F.array(*listed), lambda a: a.isNotNull())).alias("a"))
    return each.select("a.alert", "a.severity", F.col("a.place").cast("long").alias("place"))


def feedback_labels(ratings: DataFrame, flags: DataFrame, pins: DataFrame, key: str) -> DataFrame:
    """(key, label): what feedback says of an item. A pin beats a flag, a flag beats a rating; 4 and more is good, 2 and less bad."""
    good = F.when(F.col("rating") >= 4, 1).when(F.col("rating") <= 2, 0)
    r = ratings.select(key, good.alias("by_rating")).groupBy(key).agg(F.max("by_rating").alias("by_rating"))
    f = flags.groupBy(key).agg(F.max(F.when(F.col("flag") == "useful", 1).otherwise(0)).alias("by_flag"))
    p = pins.select(key).distinct().withColumn("by_pin", F.lit(1))
    both = r.join(f, key, "full_outer").join(p, key, "full_outer")
    return both.select(key, F.coalesce("by_pin", "by_flag", "by_rating").cast("int").alias("label")).where(F.col("label").isNotNull())


def key_status(revoked: Column, expires_at: Column, misplaced: Column, now: Column) -> Column:
    return F.when(misplaced, "misplaced").when(revoked, "revoked").when(F.coalesce(expires_at <= now, F.lit(False)), "expired").otherwise("active")


def whole_days(since: Column, now: Column) -> Column:
    """Whole days from one time to another, null for an unknown one."""
    return F.floor((F.unix_micros(now) - F.unix_micros(since)) / F.lit(86_400_000_000))


def cost_estimate(tokens: Column, rate: float) -> Column:
    return (tokens.cast("decimal(20,6)") / F.lit(1000) * F.lit(rate).cast("decimal(10,6)")).cast("decimal(18,6)")
