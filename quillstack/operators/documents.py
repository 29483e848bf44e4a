"""Document processing: personal data, sensitivity, injection, chunks, statements, versions, summaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import STOPWORDS, fold, let, normalise_document, sentences, words

#: Personal data that a pattern alone recognises.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"
CARD = r"\b[3-6][0-9](?:[ -]?[0-9]){11,17}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b"
PHONE = r"(?<![0-9])(?:\+33[ .-]?|0)[1-9](?:[ .-]?[0-9]{2}){4}(?![0-9])"
SOCIAL = r"\b[12][ ]?[0-9]{2}[ ]?(?:0[1-9]|1[0-2])[ ]?(?:[0-9]{2}|2[AB])[ ]?[0-9]{3}[ ]?[0-9]{3}[ ]?[0-9]{2}\b"
#: Names after a civility, which itself stays. Only capitals look back: a look back of varying length tries each of its lengths.
PERSON = r"(?=[A-ZÀ-Ý])(?<=\b(?:M\.|Mme|Mlle|Monsieur|Madame|Mademoiselle|Dr|Docteur|Pr|Mr|Mrs|Ms)[.]?\s)[A-ZÀ-Ý][\w'’-]+(?:\s+[A-ZÀ-Ý][\w'’-]+)?"
#: The order in which overlapping finds win, and the types that make a content sensitive.
PII = (("IBAN", IBAN), ("CARD", CARD), ("NIR", SOCIAL), ("EMAIL", EMAIL), ("PHONE", PHONE), ("IP", IPV4), ("PERSON", PERSON))
SENSITIVE = ("IBAN", "CARD", "NIR")
#: What every card, social or phone number holds (eight digits in a row: a Corsican department cuts a social number), and every address.
DIGITS, AT = r"[0-9](?:[ .-]?[0-9]){7}", "@"


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    from_right = F.reverse(F.filter(F.split(digits, ""), lambda d: d.rlike("^[0-9]$")))
    doubled = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return (F.size(from_right) > 0) & (F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0)


def iban_ok(code: Column) -> Column:
    """The mod-97 check of an account number."""
    flat = F.upper(F.regexp_replace(code, " ", ""))
    moved = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))
    digits = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")))
    rest = F.aggregate(F.filter(F.split(F.array_join(digits, ""), ""), lambda c: c != ""), F.lit(0), lambda r, d: (r * 10 + d.cast("int")) % 97)
    return rest == 1


def social_ok(number: Column) -> Column:
    """The key of a French social number; Corsican departments count as 19 and 18."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(number, " ", ""), "2A", "19"), "2B", "18")
    return (97 - F.substring(flat, 1, 13).try_cast("long") % 97) == F.substring(flat, 14, 2).try_cast("long")


def pii_spans(text: Column) -> Column:
    """array<struct<start,end,type,value>> of valid finds without overlaps: an earlier type of the list, then the longer one, wins."""

    def of(kind: str, pattern: str, rank: int, numbered: Column) -> Column:
        valid = {"CARD": luhn, "IBAN": iban_ok, "NIR": social_ok}.get(kind)
        lacks = {"CARD": ~numbered, "NIR": ~numbered, "PHONE": ~numbered, "EMAIL": ~F.contains(text, F.lit(AT))}.get(kind)
        found = _places(text, pattern)
        found = found if lacks is None else F.when(lacks, _no_places()).otherwise(found)
        found = F.filter(found, lambda m: F.coalesce(valid(m["value"]), F.lit(False))) if valid else found
        return F.transform(found, lambda m: F.struct(F.lit(rank).alias("rank"), (-F.length(m["value"])).alias("short"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), F.lit(kind).alias("type"), m["value"].alias("value")))

    every = let(text.rlike(DIGITS), lambda numbered: F.array_sort(F.concat(*[of(kind, pattern, rank, numbered) for rank, (kind, pattern) in enumerate(PII)])))
    empty = F.array().cast("array<struct<rank:int,short:int,start:int,end:int,type:string,value:string>>")
    kept = F.aggregate(every, empty, lambda acc, s: F.when(F.exists(acc, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["value"].alias("value"))))


def has_sensitive(text: Column) -> Column:
    """Whether a text holds a valid account, card or social number."""
    found = lambda pattern, valid: F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), valid)
    return found(IBAN, iban_ok) | found(CARD, luhn) | found(SOCIAL, lambda n: F.coalesce(social_ok(n), F.lit(False)))


def _no_places() -> Column:
    return F.array().cast("array<struct<start:int,value:string>>")


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of a pattern's matches: what splits a text and what is split out of it take turns. Texts without a match are read once."""
    start = F.struct(F.lit(0).alias("at"), _no_places().alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["between"])
        return F.struct((at + F.length(pair["found"])).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), pair["found"].alias("value")))).alias("out"))

    def placed(found: Column) -> Column:
        pairs = F.filter(F.arrays_zip(F.split(text, pattern).alias("between"), found.alias("found")), lambda p: p["found"].isNotNull())
        return F.when(F.size(found) == 0, _no_places()).otherwise(F.aggregate(pairs, start, step)["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def redact_simple(text: Column) -> Column:
    """E-mail and IPv4 addresses replaced by their type; no lookup of overlaps is needed for these two."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL]"), IPV4, "[IP]")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its type."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), s["type"], F.lit("]")).alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.aggregate(spans, start, step), rest))


#: Words that raise a document's level (C2 confidential, C3 secret), matched on folded text.
MARKED_SECRET = r"(^|\n)\s*(c3|secret|strictement confidentiel)\b|\bclassification\s*:\s*(c3|secret)"
MARKED_CONFIDENTIAL = r"(^|\n)\s*(c2|confidentiel|confidential)\b|\bclassification\s*:\s*(c2|confidentiel)"
TOPICS = ((r"\b(salaire|remuneration|salary|licenciement|evaluation annuelle)\b", 2), (r"\b(contrat|contract|penalite|litige)\b", 1), (r"\b(marge|margin|chiffre d.affaires|budget)\b", 1), (r"\b(mot de passe|password|vulnerabilite|vulnerability)\b", 1))

#: What a text with such a mark or topic holds word for word.
SECRET_WORDS, CONFIDENTIAL_WORDS = ("c3", "secret", "strictement confidentiel"), ("c2", "confidentiel", "confidential")
TOPIC_WORDS = (
    ("salaire", "remuneration", "salary", "licenciement", "evaluation annuelle"),
    ("contrat", "contract", "penalite", "litige"),
    ("marge", "margin", "chiffre d", "budget"),
    ("mot de passe", "password", "vulnerabilite", "vulnerability"),
)


def _holds(low: Column, listed: tuple[str, ...]) -> Column:
    """Whether a text has one of a few strings: far cheaper than a pattern, which need not be looked for where none is."""
    return reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in listed))


def classify(text: Column, declared: Column, source_default: Column, has_sensitive: Column) -> Column:
    """The highest of the declared level, the source's, the marks', the topics' (3 points make C2) and that of personal data."""
    low = fold(text)
    marks = F.when(_holds(low, SECRET_WORDS) & low.rlike(MARKED_SECRET), 3).when(_holds(low, CONFIDENTIAL_WORDS) & low.rlike(MARKED_CONFIDENTIAL), 2).otherwise(0)
    points = sum((F.when(_holds(low, held) & low.rlike(p), w).otherwise(0) for (p, w), held in zip(TOPICS, TOPIC_WORDS, strict=True)), F.lit(0))
    return F.greatest(F.coalesce(declared, F.lit(0)), F.coalesce(source_default, F.lit(0)), marks, F.when(points >= 3, 2).otherwise(0), F.when(has_sensitive, 2).otherwise(0))


#: Signs of instructions hidden in content, with their weights: a list of our own.
INJECTION = (
    ("override", r"(ignore|oublie|disregard|forget)\w* (all |any |toutes? |les )?(the |les )?(previous|above|prior|precedentes?) (instructions|consignes|rules)", 0.6),
    ("role", r"(you are now|tu es maintenant|act as|agis comme) (a|an|un|une|the|le|la)?", 0.35),
    ("system", r"(system prompt|prompt systeme|<\|?system\|?>|### ?system)", 0.45),
    ("exfiltrate", r"(send|envoie|post|transmets?) .{0,40}(password|mot de passe|api key|cle|token|secret)", 0.5),
    ("conceal", r"(do not tell|ne dis pas|without telling|sans prevenir) .{0,30}(user|utilisateur)", 0.45),
    ("tool", r"(call|execute|run|appelle|lance) (the |le |la )?(tool|function|outil|commande|command)", 0.3),
    ("encoded", r"(base64|rot13)[^.]{0,30}(decode|decrypt|dechiffre)", 0.3),
)
#: What a text with a sign holds word for word; a plain look for these spares nearly all texts the look for the sign.
INJECTION_WORDS = {
    "override": ("ignore", "oublie", "disregard", "forget"),
    "role": ("you are now", "tu es maintenant", "act as", "agis comme"),
    "system": ("system",),
    "exfiltrate": ("password", "mot de passe", "api key", "cle", "token", "secret"),
    "conceal": ("do not tell", "ne dis pas", "without telling", "sans prevenir"),
    "tool": ("tool", "function", "outil", "command"),
    "encoded": ("base64", "rot13"),
}
QUARANTINE = 0.6


def injection_score(text: Column, hidden: Column, classifier: Callable[[Column], Column] | None = None) -> Column:
    """1 less the product of what every sign leaves; hidden text counts 0.4. ``classifier``: a further score from 0 to 1, if higher."""
    low, left = fold(text), F.lit(1.0)
    for name, pattern, weight in INJECTION:
        left = left * F.when(_holds(low, INJECTION_WORDS[name]) & low.rlike(pattern), 1 - weight).otherwise(1.0)
    score = 1 - left * F.when(hidden, 0.6).otherwise(1.0)
    return F.round(F.greatest(score, classifier(text)) if classifier else score, 4)


def hidden_counts(html: Column) -> tuple[Column, Column, Column]:
    """Invisible characters, elements hidden by style or attribute, comments of 12 characters and more."""
    invisible = F.regexp_count(html, F.lit("[\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]"))
    styled = F.regexp_count(html, F.lit(r"(?i)<[a-z0-9]+[^>]*(display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*.?true)[^>]*>"))
    comments = F.size(F.filter(F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1)), lambda c: F.length(F.trim(c)) >= 12))
    return invisible.cast("long"), styled.cast("long"), comments.cast("long")


_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
_END = re.compile(r"[.!?…]([\"»)\]]*\s+)(?=[^\sa-z])")
_SHORT = re.compile(r"(?:^|\s)(?:[A-Z]|M|Mme|Dr|Mr|Mrs|etc|cf|ex|art|p|St|No)\.$")


def _units(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of headings, list lines and sentences; together they cover all but blanks."""
    at = 0
    for line in text.splitlines(keepends=True):
        body = line.rstrip()
        lead = len(body) - len(body.lstrip())
        if body.strip():
            if _HEADING.match(body.strip()) or re.match(r"\s*(?:[-*•]|\d+[.)])\s", body):
                yield at + lead, at + len(body), "heading" if body.strip().startswith("#") else "item"
            else:
                start = lead
                for m in _END.finditer(body):
                    end = m.start(1)
                    if body[end - 1] != "." or not _SHORT.search(body[max(start, end - 5) : end]):  # the longest short form and what comes before it
                        yield at + start, at + end, "sentence"
                        start = m.end()
                if start < len(body):
                    yield at + start, at + len(body), "sentence"
        at += len(line)


def chunk_text(text: str | None, target: int = 350, overlap: int = 50, least: int = 80) -> list[tuple[int, int, int, str, int]]:
    """(ordinal, start, end, section, tokens): packs of whole units up to ``target`` tokens; text[start:end] is the chunk.

    A pack starts with as many of the last units as ``overlap`` holds; a heading closes a pack of ``least`` tokens and more, and no
    pack ends with one. A unit longer than the target is cut at blanks.
    """
    size = lambda a, b: round((b - a) / 3.8)
    units: list[tuple[int, int, str, str]] = []
    path: list[str] = []
    section = ""
    for a, b, kind in _units(text or ""):
        if kind == "heading":
            level, title = len(_HEADING.match(text[a:b])[1]), _HEADING.match(text[a:b])[2].strip()
            path = [*path[: min(level, 3) - 1], title][:3]
            section = " > ".join(path)
        while size(a, b) > target:
            cut = text.rfind(" ", a + 1, a + int(target * 3.8))
            cut = cut if cut > a else a + int(target * 3.8)
            units.append((a, cut, kind, section))
            a = cut + (text[cut] == " ")
        if a < b:
            units.append((a, b, kind, section))
    packs: list[list] = [[]]
    for unit in units:
        pack = packs[-1]
        held = size(pack[0][0], pack[-1][1]) if pack else 0
        if pack and ((unit[2] == "heading" and held >= least) or size(pack[0][0], unit[1]) > target):
            moved = []
            while len(pack) > 1 and pack[-1][2] == "heading":
                moved.insert(0, pack.pop())
            back: list = []
            if unit[2] != "heading" and not moved:
                for old in reversed(pack[1:]):
                    if size(old[0], pack[-1][1]) > overlap or size(old[0], unit[1]) > target:
                        break
                    back.insert(0, old)
            packs.append([*back, *moved])
        packs[-1].append(unit)
    return [(n, p[0][0], p[-1][1], p[-1][3], max(1, -(-(p[-1][1] - p[0][0]) * 10 // 38))) for n, p in enumerate(x for x in packs if x)]


def chunk(documents: DataFrame, key: str, text: str = "text", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """(key, ordinal, char_start, char_end, section, token_count, text): one row per chunk. ``carry``: columns of the document that go along."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields if f.name in carry}
    schema = ", ".join([f"{key} long, ordinal int, char_start int, char_end int, section string, token_count int, text string", *(f"`{c}` {kinds[c]}" for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(i, n, start, end, section, tokens, t[start:end]) for i, t in enumerate(texts) if t for n, start, end, section, tokens in chunk_text(t, **options)]
            if rows:
                at, *made = zip(*rows, strict=True)
                own = [pa.array(v, k) for v, k in zip(made, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)]
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *own, *(c.take(at) for c in batch.columns[2:])], names=[key, "ordinal", "char_start", "char_end", "section", "token_count", "text", *carry])

    return documents.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), *carry).mapInArrow(run, schema)


#: What a sentence has to hold to be a kind of statement, the first that fits wins: a list of our own.
STATEMENTS = (
    ("decision", r"\b(decid\w*|decision|we will|on retient|valide\w*|adopt\w*)\b", 0.8),
    ("constraint", r"\b(doit|doivent|must|shall|obligatoire|interdit|required|cannot)\b", 0.75),
    ("risk", r"\b(risque\w*|risk\w*|danger|menace|threat)\b", 0.7),
    ("requirement", r"\b(besoin|need\w*|souhaite\w*|en tant que|as a user|want\w*)\b", 0.7),
    ("procedure", r"\b(etape \d|step \d|procedure|d.abord|first,|then,|ensuite)\b", 0.65),
    ("fact", r"\b\d+([.,]\d+)?\s*(%|€|k€|jours?|days?|postes?|users?|ms|go|gb)\b", 0.6),
)


#: How much less sure statements of a source kind are, and those of a source of low trust.
SOURCE_DELTA = {"agent_trace": -0.15, "url": -0.1, "feedback": -0.05, "crm": -0.05}
LOW_TRUST_DELTA = -0.1


def source_delta(kind: Column, trust: Column) -> Column:
    by_kind = F.element_at(F.create_map(*[F.lit(x) for pair in SOURCE_DELTA.items() for x in pair]), kind)
    return F.coalesce(by_kind, F.lit(0.0)) + F.when(trust == "low", LOW_TRUST_DELTA).otherwise(0.0)


def statements(documents: DataFrame, key: str, text: str = "text", delta: Column | float = 0.0, most: int = 80) -> DataFrame:
    """(key, i, kind, sentence, confidence): sentences of a known kind, at most the ``most`` surest of a document; ``delta`` is of the document."""
    rows = documents.select(key, F.lit(delta).alias("delta") if isinstance(delta, float) else delta.alias("delta"), F.posexplode(sentences(F.col(text))).alias("i", "sentence"))
    low, kind, sure = fold(F.col("sentence")), F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, pattern, confidence in reversed(STATEMENTS):
        kind = F.when(low.rlike(pattern), name).otherwise(kind)
        sure = F.when(low.rlike(pattern), confidence).otherwise(sure)
    found = rows.withColumn("kind", kind).withColumn("confidence", F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.95), sure + F.col("delta"))), 4)).where("kind is not null").drop("delta")
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "i"))
    return found.withColumn("n", n).where(F.col("n") <= most).drop("n")


def salient(documents: DataFrame, key: str, text: str = "text", k: int = 5) -> DataFrame:
    """(key, entity, n): acronyms and capitalised names of a text by frequency."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\b[A-Z]{2,6}\b|(?<=[a-z,] )[A-Z][a-z]{2,}"), F.lit(0))
    counted = documents.select(key, F.explode(found).alias("entity")).groupBy(key, "entity").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "entity"))
    return counted.withColumn("at", rank).where(F.col("at") <= k).drop("at")


def preamble(title: Column, section: Column, source: Column, date: Column, entities: Column) -> Column:
    """One line of context put before a chunk."""
    parts = [F.concat(F.lit("Document: "), title), F.concat(F.lit("Section: "), section), F.concat(F.lit("Source: "), source), F.concat(F.lit("Date: "), F.date_format(date, "yyyy-MM-dd")), F.concat(F.lit("About: "), F.nullif(F.array_join(entities, ", "), F.lit("")))]
    return F.concat_ws(" | ", *parts)


def ingest_actions(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, action, version): create, new_version, metadata_only, or refused for what was forgotten.

    incoming: key, content_hash. existing: key, content_hash, version, forgotten (its newest version).
    """
    old = existing.select(F.col(key).alias("_k"), F.col("content_hash").alias("_h"), "version", "forgotten")
    both = incoming.join(old, F.col(key) == F.col("_k"), "left")
    action = F.when(F.col("_k").isNull(), "create").when(F.col("forgotten"), "refused").when(F.col("_h") == F.col("content_hash"), "metadata_only").otherwise("new_version")
    version = F.when(action == "new_version", F.col("version") + 1).when(action == "create", 1).otherwise(F.col("version"))
    return both.select(key, action.alias("action"), version.cast("long").alias("version"))


def session_summary(turns: DataFrame, most: int = 8) -> DataFrame:
    """(conv_id, turn, i, sentence, score): the sentences that tell most of a conversation, at most ``most``, and its first question.

    Score: frequency of the words in the conversation over the root of their number, more for decisions, numbers and users.
    """
    parts = turns.select("conv_id", "turn", "role", F.posexplode(sentences(F.col("text"))).alias("i", "sentence"))
    parts = parts.withColumn("t", F.filter(words(F.col("sentence")), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))).where(F.size("t") > 0)
    each = parts.select("conv_id", "turn", "i", F.explode("t").alias("term"))
    weight = each.groupBy("conv_id", "term").agg(F.count("*").alias("tf"))
    scored = each.join(weight, ["conv_id", "term"]).groupBy("conv_id", "turn", "i").agg(F.sum("tf").alias("sum"), F.count("*").alias("n"))
    rows = parts.select("conv_id", "turn", "i", "role", "sentence").join(scored, ["conv_id", "turn", "i"])
    low = fold(F.col("sentence"))
    factor = F.when(low.rlike(STATEMENTS[0][1]) | low.rlike(STATEMENTS[1][1]), 1.6).otherwise(1.0) * F.when(low.rlike("[0-9]"), 1.15).otherwise(1.0) * F.when(F.col("role") == "user", 1.1).otherwise(1.0)
    score = F.round(F.col("sum") / F.sqrt(F.col("n").cast("double")) * factor, 6)
    first = (F.col("role") == "user") & (F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "i")) == 1)
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("first"), F.desc("score"), "turn", "i"))
    return rows.withColumn("score", score).withColumn("first", first).withColumn("at", rank).where(F.col("at") <= most).select("conv_id", "turn", "i", "sentence", "score")


#: What minutes of a meeting call themselves, on folded text, and their short mark in capitals.
MEETING = r"compte[- ]rendu|\bcomite\b|\breunion\b|sprint review|\bcopil\b|\batelier\b|kick-?off|retrospective"
MEETING_MARK = r"(?:^|[\s(\[:])CR(?:\s|$|[-:])"


def is_meeting(title: Column, text: Column) -> Column:
    head = F.concat_ws("\n", title, text)
    return F.coalesce(fold(head).rlike(MEETING) | head.rlike(MEETING_MARK), F.lit(False))


def ingest(documents: DataFrame, key: str, text: str = "text", default_level: int = 1) -> DataFrame:
    """(key, ordinal, section, text, level, quarantined, preamble) of new documents, one row for each chunk.

    The steps of an ingestion in turn: regular text, personal data replaced, level, chunks, injection signs, context line. What is to
    be embedded follows from ``functions.vectors.embedding_input``.
    """
    regular = documents.select(key, normalise_document(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    marked = regular.select(key, "t", pii_spans(F.col("t")).alias("spans"))
    judged = marked.select(key, redact(F.col("t"), F.col("spans")).alias("text"), classify(F.col("t"), F.lit(0), F.lit(default_level), F.exists("spans", lambda s: s["type"].isin(*SENSITIVE))).cast("int").alias("level"))
    chunks = chunk(judged, key, carry=("level",))
    score = injection_score(F.col("text"), F.lit(False))
    line = preamble(F.lit(None).cast("string"), F.nullif(F.col("section"), F.lit("")), F.lit(None).cast("string"), F.lit(None).cast("date"), F.array().cast("array<string>"))
    return chunks.select(key, "ordinal", "section", "text", "level", (score >= QUARANTINE).alias("quarantined"), line.alias("preamble"))


def reindex_plan(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """(project, missing): projects with chunks that lack their context line and no re-index job that waits or runs."""
    lacking = chunks.where(F.col("preamble").isNull()).groupBy("project").agg(F.count("*").alias("missing"))
    return lacking.join(jobs.where(F.col("status").isin("pending", "running")).select("project"), "project", "left_anti")


def forget_documents(chunks: DataFrame, forgotten: DataFrame, document: str = "document") -> tuple[DataFrame, DataFrame]:
    """The chunks with the text of forgotten documents removed, and a tombstone (document, chunks, digest) for each of these."""
    gone = forgotten.select(F.col(document).alias("_d")).distinct()
    rows = chunks.join(gone, F.col(document) == F.col("_d"), "left")
    left = rows.withColumns({"text": F.when(F.col("_d").isNull(), F.col("text")), "status": F.when(F.col("_d").isNull(), F.col("status")).otherwise("forgotten")}).drop("_d")
    stones = rows.where(F.col("_d").isNotNull()).groupBy(document).agg(F.count("*").alias("chunks"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.sha2("text", 256))), ","), 256).alias("digest"))
    return left, stones
