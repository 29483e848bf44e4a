"""URL filters by a Bloom filter cascade, in DataFrame operations only.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains if the url's path starts with the
rule's. Every url has few keys that could be a rule (a suffix of its host with as many labels as some rule has, and a prefix of
its path as long as some rule's), and the key universe is all keys of all urls. Level 1 of a cascade is a Bloom filter of the
listed keys; level 2 one of the universe's keys that level 1 takes by mistake; level 3 one of the listed keys that level 2
takes by mistake; and so on until no mistake is left. A key is listed if the first level that rejects it has an even number.
So membership is exact for the whole universe and needs no join: the levels are literals of the plan.

Scale: the false-positive rate of level 1 is set so that about as many mistakes as listed keys are expected, however large the
universe is, and the number of hashes follows from the rate; all levels together then take a few words per listed key and their size is checked against ``max_words`` before
they go into the plan. A longer list is cut by key hash into parts, each with a cascade and a pass of its own over the urls; only
one part's levels are in a plan at a time. The url column is read twice: for the mistakes of level 1 and for the verdicts.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no rule; repeated urls each get their row; an
empty list allows all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

MAX_HASHES = 32


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def key(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Distinct keys of a url, the most specific first: longer keys, then longer hosts."""
    suffixes = [F.substring_index(host, ".", -n) for n in labels]
    pairs = [F.struct(F.length(F.concat(s, p)).alias("size"), F.length(s).alias("host_size"), F.concat(s, p).alias("key")) for s in suffixes for p in (F.substring(path, 1, n) for n in lengths)]
    ordered = F.sort_array(F.array_distinct(F.array(*pairs)), asc=False)
    return F.when(host != "", F.transform(ordered, lambda x: x["key"])).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    seed: int
    hashes: int

    def takes(self, key: Column) -> Column:
        """Whether the filter takes a key: all its bits are set."""
        bits, out = len(self.words) * 64, F.lit(True)
        table = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        for h in range(self.hashes):
            at = _bit(key, self.seed, h, bits)
            out = out & (F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def _bit(key: Column, seed: int, h: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * MAX_HASHES + h), key), F.lit(bits).cast("long"))


def _hashes_for(rate: float) -> int:
    """The number of hashes that needs the fewest bits for a rate."""
    return max(1, min(MAX_HASHES, round(-math.log2(rate))))


def _words_for(n: int, rate: float) -> int:
    """64-bit words of a filter that keeps the rate for n keys."""
    k = _hashes_for(rate)
    bits = -k * max(n, 1) / math.log(1 - rate ** (1 / k))
    return max(1, math.ceil(bits / 64))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """The filter of ``n`` keys. Bits are united per word before the shuffle; the driver gets at most ``words`` numbers."""
    words, hashes = _words_for(n, rate), _hashes_for(rate)
    places = keys.select(F.explode(F.array(*[_bit(F.col("key"), seed, h, words * 64) for h in range(hashes)])).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    rows = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    table = [0] * words
    for row in rows:
        table[row["word"]] = row["bits"]
    return Level(tuple(table), seed, hashes)


def is_listed(key: Column, levels: list[Level]) -> Column:
    """The key passes odd levels as listed and even ones as a mistake; the first that rejects it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels), 0, -1):
        out = F.when(levels[number - 1].takes(key), out).otherwise(F.lit(number % 2 == 0))
    return out


def build_cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch, max_words: int = 1 << 17) -> list[Level]:
    """Levels over (key) frames. ``universe`` may repeat keys; it is scanned once here, listed keys are left out by level."""
    size = listed.count()
    rate = _first_rate(size, universe.count())
    if _words_for(size, rate) > max_words:
        raise OverflowError(f"{_words_for(size, rate)} words are needed for {size} keys")
    levels = [_level(listed, size, rate, 1)]
    wrong = scratch.keep(universe.where(levels[0].takes(F.col("key"))).distinct().join(listed, "key", "left_anti"), "mistakes-1")
    right = listed
    # Every level halves the mistakes of the one before with hashes of its own, so this ends.
    while n := wrong.count():
        levels.append(_level(wrong, n, 0.5, len(levels) + 1))
        kept = scratch.keep(right.where(levels[-1].takes(F.col("key"))), f"mistakes-{len(levels)}")
        right, wrong = wrong, kept
    return levels


def _first_rate(listed: int, universe: int) -> float:
    """About as many mistakes as listed keys, and a quarter of the keys at most."""
    return min(0.25, max(listed, 1) / max(universe, 1))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, max_words: int = 1 << 17) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, or null), verdict (the rule's; allow where none fits)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = tuple({r.key: r for r in rules}.values())
    n_keys = len({r.host.count(".") for r in rules}) * len({len(r.path) for r in rules})
    parts = _parts(rules, parsed.count() * n_keys if rules else 0, max_words)
    out = parsed.withColumn("rule", F.lit(None).cast("string")).withColumn("blocked", F.lit(False))
    for number, part in enumerate(parts):
        out = _apply(out, part, scratch, spark, max_words)
        if number < len(parts) - 1:
            out = scratch.keep(out, "judged")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))


def _parts(rules: tuple[Rule, ...], universe: int, max_words: int) -> list[tuple[Rule, ...]]:
    """The rules in parts whose first level fits ``max_words`` for a universe of at most so many keys, in one verdict or two."""
    n = 1
    while rules and _words_for(size := -(-len(rules) // n), _first_rate(1, universe)) > max_words:
        if size == 1:
            raise OverflowError(f"max_words {max_words} is too small for one key")
        n *= 2
    return [p for i in range(n) if (p := rules[i::n])]


def _apply(judged: DataFrame, rules: tuple[Rule, ...], scratch: Scratch, spark: SparkSession, max_words: int) -> DataFrame:
    """Lets a part's rule replace the one found so far where it is longer."""
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    keyed = judged.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    cascades = {}
    for verdict in ("allow", "block"):
        own = [(r.key,) for r in rules if r.verdict == verdict]
        cascades[verdict] = build_cascade(spark.createDataFrame(own, "key string"), universe, scratch, max_words) if own else []
    never = F.lit(False)
    listed = {v: (lambda key, levels=levels: is_listed(key, levels) if levels else never) for v, levels in cascades.items()}
    best = F.get(F.filter("keys", lambda key: listed["allow"](key) | listed["block"](key)), 0)
    found = keyed.withColumn("found", best)
    longer = F.col("found").isNotNull() & (F.col("rule").isNull() | (F.length("found") > F.length("rule")))
    return found.select("page_id", "host", "path", F.when(longer, F.col("found")).otherwise(F.col("rule")).alias("rule"), F.when(longer, listed["block"](F.col("found"))).otherwise(F.col("blocked")).alias("blocked"))
