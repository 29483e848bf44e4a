"""Registered queries: many phrases at once, sensitivity with its reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as d
from ..operators import injection
from ..operators import phrases as p
from .common import table
from .processing import _FOLD


def phrase_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts, suppliers and nations and all lines of the benchmark, of any length, in whole documents."""
    named = lambda name, column: table(spark, sf, name).select(F.lit(name).alias("label"), F.col(column).alias("phrase"))
    lines = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("label"), F.explode(F.split("text", "\n")).alias("phrase"))
    every = named("part", "p_name").unionByName(named("supplier", "s_name")).unionByName(named("nation", "n_name")).unionByName(lines)
    found = p.find_phrases(table(spark, sf, "documents"), every, "doc_id", "text")
    return found.select("doc_id", "label", F.md5("form").alias("form_md5"), F.length("form").cast("long").alias("length"))


def sensitivity_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The level of every document with all that speaks for it; its first line is its title."""
    documents = table(spark, sf, "documents")
    title = F.element_at(F.split("text", "\n", 2), 1)
    rows = p.sensitivity(documents, title, F.col("text"), F.col("doc_id") % 3, F.lit(1), ["doc_id"])
    return rows.select("doc_id", F.col("sensitivity.level").alias("level"), F.array_join("sensitivity.reasons", " ").alias("reasons"))


def injection_signs(spark: SparkSession, sf: str) -> DataFrame:
    """The signs of instructions in the source of every page and in every document, by the text alone."""
    texts = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    texts = texts.unionByName(table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"))
    rows = texts.select("kind", "id", injection.findings(F.col("text")).alias("f"))
    return rows.select("kind", "id", F.col("f.score").alias("score"), F.array_join(F.col("f.reasons.code"), ",").alias("codes"))


def injection_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The signs in the visible text of every page, with what its source hides, and where each was found."""
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " ")
    rows = table(spark, sf, "pages").select("page_id", injection.findings(visible, F.col("html")).alias("f"))
    return rows.select("page_id", F.col("f.score").alias("score"), (F.col("f.score") >= d.QUARANTINE).alias("quarantined"), F.array_join(F.col("f.reasons.code"), ",").alias("codes"), F.array_join(F.col("f.reasons.excerpt"), " | ").alias("excerpts"))


QUERIES = {f.__name__: f for f in (phrase_mentions, sensitivity_reasons, injection_signs, injection_findings)}
_FORM = f"trim(regexp_replace({_FOLD}, '\\s+', ' ', 'g'))"
_EDGED = "regexp_matches(low, '(^|[^a-z0-9])(' || '{0}' || ')($|[^a-z0-9])')"


def _digits(kind: str, pattern: str, valid: str) -> str:
    return f"CASE WHEN len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}'), lambda c: {valid})) > 0 THEN '{kind}' END"


_LUHN = """list_sum(list_transform(range(1, length(regexp_replace(c, '[^0-9]', '', 'g')) + 1), lambda i: CASE
  WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[i] AS INTEGER) WHEN CAST(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[i] AS INTEGER) > 4
  THEN CAST(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[i] AS INTEGER) * 2 - 9 ELSE CAST(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[i] AS INTEGER) * 2 END)) % 10 = 0"""
_IBAN = """list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(substr(replace(c, ' ', ''), 5) || substr(replace(c, ' ', ''), 1, 4), ''),
  lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE CAST(ascii(upper(x)) - 55 AS VARCHAR) END), ''), ''), lambda x: CAST(x AS INTEGER))), lambda r, x: (r * 10 + x) % 97) = 1"""
_FLAT = "replace(replace(replace(c, ' ', ''), '2A', '19'), '2B', '18')"
_NIR = f"97 - CAST(substr({_FLAT}, 1, 13) AS BIGINT) % 97 = CAST(substr({_FLAT}, 14, 2) AS BIGINT)"
_TOPIC_CASES = ", ".join(
    f"CASE WHEN {_EDGED.format(phrases) if topic not in p.NOT_TOPICS else _EDGED.format(phrases).replace('low,', 'regexp_replace(low, ' + repr('(' + p.NOT_TOPICS[topic] + ')') + ', ' + repr('-') + ', ' + repr('g') + '),')} THEN '{topic}' END"
    for topic, phrases in p.TOPIC_PHRASES.items()
)
_LINES = f"list_transform(list_filter(regexp_split_to_array({_FOLD}, '{p.LINE_END}'), lambda x: length(trim(x)) <= {p.LINE_LETTERS}), lambda x: trim(regexp_replace(regexp_replace(x, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'), '\\s+', ' ', 'g')))"
_ANY_LINE = lambda level: f"list_has_any(lines, string_split('{p.LINE_MARKS[level]}', '|'))"
_TITLED = lambda level: f"regexp_matches(title, ' ({p.TITLE_MARKS[level]}) ')"
_LEVELS = "MAP {" + ", ".join(f"'{w}': {n}" for w, n in p.LEVEL_WORDS.items()) + "}"
_STATED = p.STATED.removesuffix("(?![a-z0-9_])") + "(?:[^a-z0-9_]|$)"
_SIGNS = [(code, weight, injection.sign_pattern(patterns).replace("'", "''")) for code, weight, patterns in injection.SIGNS]
_HIDDEN = f"len(regexp_extract_all(low, '{injection.INVISIBLE}')) >= {injection.INVISIBLE_LEAST}"
ORACLES: dict[str, str] = {
    "injection_signs": f"""WITH t AS (SELECT kind, id, coalesce({_FOLD}, '') AS low FROM (SELECT 'page' AS kind, page_id AS id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents))
      SELECT kind, id, CAST(round(1 - {' * '.join(f"CASE WHEN regexp_matches(low, '{x}') THEN 1 - CAST({w} AS DOUBLE) ELSE 1 END" for _, w, x in _SIGNS)} * CASE WHEN {_HIDDEN} THEN 0.6 ELSE 1 END, 4) AS DOUBLE) AS score,
        concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(low, '{x}') THEN '{c}' END" for c, _, x in _SIGNS)}, CASE WHEN {_HIDDEN} THEN 'HIDDEN_TEXT' END) AS codes FROM t""",
    "phrase_mentions": f"""WITH n AS (SELECT DISTINCT label, {_FORM.replace('text', 'phrase')} AS form FROM (SELECT 'part' AS label, p_name AS phrase FROM part UNION ALL SELECT 'supplier', s_name FROM supplier
        UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'benchmark', unnest(string_split(text, chr(10))) FROM benchmark)),
      t AS (SELECT doc_id, {_FORM} AS low FROM documents)
      SELECT doc_id, label, md5(form) AS form_md5, length(form) AS length FROM t JOIN n ON contains(low, form) WHERE regexp_matches(form, '[a-z0-9]') AND regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(form) || '($|[^a-z0-9])')""",
    "sensitivity_reasons": f"""WITH t AS (SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(split_part(text, chr(10), 1) || chr(10) || text)), 'œ', 'oe'), '\\s+', ' ', 'g')) AS low,
        ' ' || regexp_replace({_FOLD.replace('text', 'split_part(text, chr(10), 1)')}, '[^a-z0-9]+', ' ', 'g') || ' ' AS title, {_LINES} AS lines,
        list_filter([{_digits('CARD', d.CARD, _LUHN)}, {_digits('IBAN', d.IBAN, _IBAN)}, {_digits('NIR', d.SOCIAL, _NIR)}], lambda k: k IS NOT NULL) AS types FROM documents),
      x AS (SELECT *, list_filter([{_TOPIC_CASES}], lambda k: k IS NOT NULL) AS topics,
        coalesce(list_max(list_transform(regexp_extract_all(low, '{_STATED}', 1), lambda w: ({_LEVELS})[w])), 0) AS stated,
        greatest(CASE WHEN {_TITLED(3)} OR {_ANY_LINE(3)} OR {_EDGED.format(p.INLINE_MARKS[3])} THEN 3 ELSE 0 END, CASE WHEN {_TITLED(2)} OR {_ANY_LINE(2)} OR {_EDGED.format(p.INLINE_MARKS[2])} THEN 2 ELSE 0 END) AS marked FROM t),
      y AS (SELECT *, CASE WHEN len(topics) + len(list_filter(topics, lambda k: k IN {p.STAFF_TOPICS})) >= {p.TOPIC_POINTS} THEN 2 ELSE 0 END AS topical, CASE WHEN len(types) > 0 THEN 2 ELSE 0 END AS personal FROM x)
      SELECT doc_id, CAST(greatest(1, doc_id % 3, stated, marked, topical, personal) AS INTEGER) AS level,
        concat_ws(' ', 'source:C1', 'declared:C' || (doc_id % 3), CASE WHEN stated > 0 THEN 'stated:C' || stated END, CASE WHEN marked > 0 THEN 'marking:C' || marked END,
          CASE WHEN topical > 0 THEN 'topics:C2:' || array_to_string(topics, ',') END, CASE WHEN personal > 0 THEN 'personal:C2:' || array_to_string(types, ',') END) AS reasons FROM y""",
}
