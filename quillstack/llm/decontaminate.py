"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every ``window`` consecutive words the document shares with a benchmark item, the smallest hash of its ``k``-word runs
(the rightmost of equal ones) is chosen in both texts alike. So the chosen hashes of the documents, joined with one hash per
distinct benchmark window, reach every shared window; each match is then laid over the window's place in the document and
compared word for word, and overlapping windows are extended to maximal spans. Items shorter than ``window`` words are one
window each, matched through the hashes of all runs of their length.

Scale: one scan of the documents; word arrays never leave the task that made them, since the fingerprints meet broadcast
blocks of at most ``block_windows`` distinct benchmark windows and the comparison sits in the join condition. A larger benchmark
takes more passes. One row per document and one per hit is shuffled, by document; copies of an item are one group of ids.

Defined cases: null and wordless texts have no words and hit nothing; null item ids mark words but are not counted or listed;
repeated documents each get their row, repeated items count once per item_id; an empty benchmark or table hits nothing; long texts
are used whole; other columns are ignored (``contamination``) or kept (``drop_contaminated``).
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Low bits of a fingerprint hold its place counted from the end, so that the smallest of equal hashes is the rightmost.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NOT_WORD), F.lit("")), F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where it is used inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(hashes: Column, n: int, tag: int) -> Column:
    """Hash and place of every run of ``n`` words."""
    count = F.greatest(F.size(hashes) - (n - 1), F.lit(0))

    def one(first: Column, i: Column) -> Column:
        parts = [first, *(F.get(hashes, i + j) for j in range(1, n))]
        return F.xxhash64(F.lit(tag), *parts).bitwiseAND(F.lit(~PLACE)) + (F.lit(PLACE) - i)

    return F.transform(F.slice(hashes, F.lit(1), count), one)


def _first_run(n: int, hashes: Column) -> Column:
    return F.element_at(_runs(hashes, n, n), 1)


def _winnowed(runs: Column, width: int) -> Column:
    count = F.greatest(F.size(runs) - (width - 1), F.lit(0))
    least = F.transform(F.slice(runs, F.lit(1), count), lambda first, i: F.least(first, *(F.get(runs, i + j) for j in range(1, width))) if width > 1 else first)
    return F.array_distinct(least)


def fingerprints(words: Column, window: int, k: int, short: list[int]) -> Column:
    """Chosen hashes of a word array; for each length in ``short``, the hashes of all runs of that length besides."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def chosen(h: Column) -> Column:
        parts = [_let(_runs(h, k, window), lambda r: _winnowed(r, window - k + 1)), *(_runs(h, n, n) for n in short)]
        return F.concat(*parts)

    return _let(hashes, chosen)


def _benchmark_windows(benchmark: DataFrame, window: int, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct windows (win, win_words, len, fp, at, groups), groups of equal items (grp, ids), and the short lengths."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    groups = items.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).withColumn("grp", F.xxhash64("words"))
    groups = scratch.keep(groups, "groups")
    n = F.size("words")
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array(F.lit(1)))
    cut = groups.select("grp", "words", F.explode(starts).alias("s")).select("grp", F.slice("words", F.col("s"), F.lit(window)).alias("win_words"))
    wins = cut.groupBy("win_words").agg(F.collect_set("grp").alias("groups")).withColumn("len", F.size("win_words"))
    hashes = F.transform("win_words", lambda w: F.xxhash64(w))
    own = _let(hashes, lambda h: F.array_min(_runs(h, k, window)))
    wins = wins.withColumn("mark", F.when(F.col("len") >= window, own))
    for length in range(1, window):
        whole = _let(hashes, partial(_first_run, length))
        wins = wins.withColumn("mark", F.when(F.col("len") == length, whole).otherwise(F.col("mark")))
    at = (F.lit(PLACE) - F.col("mark").bitwiseAND(F.lit(PLACE))).cast("int")
    wins = wins.select("win_words", "groups", "len", F.shiftright("mark", PLACE_BITS).alias("fp"), at.alias("at"))
    wins = scratch.keep(wins, "windows")
    short = sorted(r["len"] for r in wins.where(F.col("len") < window).select("len").distinct().collect())
    return wins, groups.select("grp", "ids"), short


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_windows: int = 200_000) -> DataFrame:
    """doc_id, text_key (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated, spans (first word from 0, end exclusive), items."""
    scratch = Scratch(documents.sparkSession, "decontaminate")
    wins, groups, short = _benchmark_windows(benchmark, window, k, scratch)
    blocks = max(1, -(-wins.count() // block_windows))
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    marks = docs.select("doc_id", "text_key", "words", fingerprints(F.col("words"), window, k, short).alias("marks"))

    def pass_over(b: int) -> DataFrame:
        some = wins if blocks == 1 else wins.where(F.pmod(F.xxhash64("win_words"), F.lit(blocks)) == b)
        # A null mark stands for the document itself; the first pass counts the documents, the others' joins drop it.
        listed = F.concat(F.array(F.lit(None).cast("long")), "marks")
        each = marks.select("doc_id", "text_key", "words", F.explode(listed).alias("mark"))
        each = each.withColumn("print", F.shiftright("mark", PLACE_BITS)).withColumn("place", (F.lit(PLACE) - F.col("mark").bitwiseAND(F.lit(PLACE))).cast("int"))
        start = F.col("place") - F.col("at")
        alike = F.when(start >= 0, F.slice("words", start + 1, F.col("len")) == F.col("win_words")).otherwise(False)
        met = each.join(F.broadcast(some), (F.col("print") == F.col("fp")) & alike, "left" if b == 0 else "inner")
        rows = met.where(F.col("mark").isNull() | F.col("len").isNotNull()) if b == 0 else met
        return rows.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.col("mark").isNull().cast("int").alias("self"), F.when(F.col("len").isNotNull(), F.struct(start.alias("start"), F.col("len").alias("len"))).alias("hit"), "groups")

    hits = reduce(DataFrame.unionByName, [pass_over(b) for b in range(blocks)])
    per_doc = hits.groupBy("doc_id", "text_key", "n_words").agg(F.sum("self").alias("rows"), F.collect_set("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_set("groups"))).alias("grps"))
    positions = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))))
    per_doc = scratch.keep(per_doc.select("doc_id", "text_key", "n_words", "rows", positions.alias("places"), "grps"), "per-document")
    listed = per_doc.where(F.size("grps") > 0).select("doc_id", "text_key", F.explode("grps").alias("g")).join(groups, F.col("g") == F.col("grp"))
    listed = listed.groupBy(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    out = per_doc.join(listed, F.col("doc_id").eqNullSafe(F.col("l_id")) & F.col("text_key").eqNullSafe(F.col("l_key")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    after = F.transform("places", lambda p: p + 1)
    spans = F.arrays_zip(F.array_except("places", after).alias("start"), F.array_except(after, F.col("places")).alias("end"))
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        F.size("places").cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
        spans.alias("spans"),
        items.alias("items"),
        F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("_qs_copy"),
    ).drop("_qs_copy")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that share no window with the benchmark. Each row is judged by its own text, also where doc_id repeats or is null."""
    scratch = Scratch(documents.sparkSession, "decontaminate")
    hit = contamination(documents, benchmark, **options).where("contaminated")
    hit = scratch.keep(hit.select(F.col("doc_id").alias("_qs_hit"), F.col("text_key").alias("_qs_key")).distinct(), "hit")
    return documents.join(hit, F.col("doc_id").eqNullSafe(F.col("_qs_hit")) & (F.xxhash64("text") == F.col("_qs_key")), "left_anti")
