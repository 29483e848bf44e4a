"""Many phrases at once: one automaton over folded text, and the sensitivity of texts with its reasons.

The phrases of a block become one automaton in each task, and every text is read once, whatever the number of phrases. Texts are folded and their
blanks squeezed before; a phrase counts where no letter or digit touches its ends, and overlapping phrases all count.

Defined cases: null and empty texts hold nothing; phrases without a letter or digit after folding are left out; equal phrases under several labels count for
each; repeated rows are told apart as they come; only the columns asked for stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import fold, squeeze
from ..scratch import Scratch
from .documents import CARD, IBAN, SOCIAL, iban_ok, luhn, social_ok

#: Letters that one automaton holds. More phrases take more passes over the texts, each with a broadcast of this size.
BLOCK_CHARS = 4_000_000
FOUND = "array<struct<form: string, n: long, first: long>>"


def phrase_form(phrase: Column | str) -> Column:
    """How a phrase or a text is compared: folded, with single blanks."""
    return squeeze(fold(phrase))


def blocks(forms: Iterable[str], size: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """The forms in lists of at most ``size`` letters; a longer form is a list of its own."""
    block, letters = [], 0
    for form in forms:
        if block and letters + len(form) > size:
            yield block
            block, letters = [], 0
        block.append(form)
        letters += len(form)
    if block:
        yield block


def with_phrases(rows: DataFrame, text: Column, forms: list[str], keep: list[Column], name: str = "found") -> DataFrame:
    """The kept columns with the forms that a row's text holds: how often, and the place of the first in the compared form of the text.

    Row by row, without a shuffle; the text goes to the tasks in its compared form alone.
    """
    given = rows.select(*keep, phrase_form(text).alias("_low"))
    columns = given.columns[:-1]
    if len({*columns, name, "_low"}) < len(columns) + 2:
        raise ValueError(f"kept columns must differ from each other, from {name} and from _low")
    made = T.StructType([*given.schema.fields[:-1], T.StructField(name, T.DataType.fromDDL(FOUND))])
    of_found = to_arrow_type(made[name].dataType)
    held = rows.sparkSession.sparkContext.broadcast(sorted(set(forms)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        machine = ahocorasick.Automaton()
        for form in held.value:
            machine.add_word(form, form)
        machine.make_automaton()
        for batch in batches:
            found = []
            for low in batch.column("_low"):
                low, seen = low.as_py() or "", {}
                for end, form in machine.iter(low) if len(machine) else ():
                    start = end - len(form) + 1
                    if (start and low[start - 1] in inner) or low[end + 1 : end + 2] in inner:
                        continue
                    n, first = seen.get(form, (0, start))
                    seen[form] = (n + 1, min(first, start))
                found.append([{"form": form, "n": n, "first": first} for form, (n, first) in sorted(seen.items())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found, of_found)], names=[*columns, name])

    return given.mapInArrow(scan, made)


def find_phrases(texts: DataFrame, phrases: DataFrame, key: str, text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, label, form, n, first): every phrase that a text holds, of any length and number.

    phrases: label, phrase. They are written once and dealt in blocks; a block passes the driver, the whole list never does.
    """
    named = phrases.select("label", phrase_form("phrase").alias("form")).where(F.col("form").rlike("[a-z0-9]")).distinct()
    kept = Scratch(texts.sparkSession, "phrases").keep(named, "forms")
    rows = texts.where(F.col(text).isNotNull())
    found = rows.select(F.col(key).alias("_key"), F.array().cast(FOUND).alias("found")).where(F.lit(False))
    for block in blocks((r["form"] for r in kept.select("form").distinct().toLocalIterator()), block_chars):
        found = found.unionByName(with_phrases(rows, F.col(text), block, [F.col(key).alias("_key")]))
    hits = found.select("_key", F.explode("found").alias("f")).select("_key", "f.form", "f.n", "f.first")
    return hits.join(kept, "form").select(F.col("_key").alias(key), "label", "form", "n", "first")


#: Sensitive topics and the wordings that show them, folded; those of staff weigh two points, others one, and three points make C2.
TOPIC_PHRASES = {
    "salaire": "salaire|salaires|salarial|salariale|salariales|salariaux",
    "remuneration": "remuneration|remunerations|prime annuelle|prime annuelles|primes annuelle|primes annuelles|prime variable|prime variables|primes variable|primes variables",
    "budget": "budget|budgets|budgetaire|budgetaires",
    "contrat": "contrat|contrats|contractuel|contractuelle|contractuels|contractuelles",
    "marge": "marge|marges",
    "negociation": "negociation|negociations|negocier",
    "prix": "prix negocie|prix negocies|prix negociee|prix negociees|prix unitaire|prix unitaires|prix de vente|tarif negocie|tarif negocies|tarifs negocie|tarifs negocies",
    "donnees bancaires": "rib|iban|coordonnees bancaires",
    "licenciement": "licenciement|licenciements|rupture conventionnelle|plan social",
    "evaluation individuelle": "evaluation annuelle|evaluation annuelles|evaluations annuelle|evaluations annuelles|evaluation individuelle|evaluation individuelles|evaluations individuelle|evaluations individuelles",
    "mot de passe": "mot de passe|mots de passe|identifiant de connexion|identifiants de connexion",
    "fusion-acquisition": "fusion acquisition|fusion acquisitions|fusions acquisition|fusions acquisitions|fusion-acquisition|fusion-acquisitions|fusions-acquisition|fusions-acquisitions|rachat de la societe",
}
STAFF_TOPICS = ("salaire", "remuneration", "licenciement", "evaluation individuelle")
TOPIC_POINTS = 3
#: Wordings that are no sign of a topic although they begin like one.
NOT_TOPICS = {"marge": "marge de manoeuvre|marge de manoeuvres|marges de manoeuvre|marges de manoeuvres"}
#: Markings anywhere in a text or title, in titles only, and as a line of their own of at most 60 letters, by level.
INLINE_MARKS = {3: "strictement confidentiel|strictement confidentielle|tres secret|secret defense", 2: "document confidentiel|diffusion restreinte|ne pas diffuser"}
TITLE_MARKS = {3: "strictement confidentiel|strictement confidentielle|tres secret|secret defense", 2: "confidentiel|confidentielle|restreint"}
LINE_MARKS = {
    3: "tres secret|secret|secret defense|strictement confidentiel|strictement confidentielle|diffusion tres restreinte|confidentiel direction|confidentielle direction",
    2: "confidentiel|confidentielle|document confidentiel|usage restreint|diffusion restreinte|ne pas diffuser|diffusion limitee",
}
LINE_LETTERS = 60
LINE_END = r"[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]+"
#: Personal data that makes a text sensitive, and what a find has to pass.
PERSONAL = {"CARD": (CARD, luhn), "IBAN": (IBAN, iban_ok), "NIR": (SOCIAL, social_ok)}
#: A stated level and what its words mean.
STATED = r"(?:classification|niveau\s+de\s+(?:classification|sensibilite|confidentialite)|sensibilite)\s*[:=\-–]\s*(c[0-3]|public|interne|confidentielle|confidentiel|secret)(?![a-z0-9_])"
LEVEL_WORDS = {"c0": 0, "public": 0, "c1": 1, "interne": 1, "c2": 2, "confidentiel": 2, "confidentielle": 2, "c3": 3, "secret": 3}


def _listed(phrases: str) -> list[str]:
    return phrases.split("|")


def _held(found: str, phrases: list[str]) -> Column:
    """How often a found list holds any of the phrases."""
    return F.aggregate(F.filter(F.col(found), lambda f: f["form"].isin(*phrases)), F.lit(0).cast("long"), lambda s, f: s + f["n"])


def _stated(low: Column) -> Column:
    levels = F.create_map(*[F.lit(x) for pair in LEVEL_WORDS.items() for x in pair])
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(low, F.lit(STATED), F.lit(1)), lambda w: levels[w])), F.lit(0))


def _any_valid(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    return F.exists(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda m: F.coalesce(valid(m), F.lit(False)))


def _line_level(text: Column) -> Column:
    """The highest level of a line that is nothing but a marking."""
    lines = F.filter(F.split(fold(text), LINE_END), lambda x: F.length(F.trim(x)) <= LINE_LETTERS)
    bare = F.transform(lines, lambda x: squeeze(F.regexp_replace(x, r"^[^a-z0-9]+|[^a-z0-9]+$", "")))
    return F.when(F.exists(bare, lambda x: x.isin(*_listed(LINE_MARKS[3]))), 3).when(F.exists(bare, lambda x: x.isin(*_listed(LINE_MARKS[2]))), 2).otherwise(0)


def sensitivity(rows: DataFrame, title: Column, text: Column, declared: Column, source_default: Column, keep: list[str], name: str = "sensitivity") -> DataFrame:
    """The kept columns with struct<level, reasons, topics>: the highest level of what speaks for one, and all that does.

    One scan for the wordings of topics and markings and none of the texts is shuffled. Reasons read kind:level, in the order source, declared, stated,
    marking, topics, personal data with its types. A title may be null; null levels of source and declaration count as 0 and give no reason.
    """
    both = F.concat_ws("\n", title, text)
    low = fold(both)
    types = F.filter(F.array(*[F.when(_any_valid(text, *rule), kind) for kind, rule in PERSONAL.items()]), lambda k: k.isNotNull())
    facts = {"_stated": _stated(low), "_lines": _line_level(F.coalesce(text, F.lit(""))), "_types": types, "_declared": declared.cast("int"), "_source": source_default.cast("int"), "_title": title}
    topics = [p for phrases in (*TOPIC_PHRASES.values(), *NOT_TOPICS.values(), *INLINE_MARKS.values()) for p in _listed(phrases)]
    scanned = with_phrases(rows, both, topics, [*[F.col(c) for c in keep], *[c.alias(n) for n, c in facts.items()]], "_found")
    padded = F.concat(F.lit(" "), F.regexp_replace(fold(F.coalesce(F.col("_title"), F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    titled = lambda level: F.exists(F.array(*[F.lit(f" {p} ") for p in _listed(TITLE_MARKS[level])]), lambda p: F.contains(padded, p))
    shown = [F.when(_held("_found", _listed(phrases)) > (_held("_found", _listed(NOT_TOPICS[topic])) if topic in NOT_TOPICS else 0), topic) for topic, phrases in TOPIC_PHRASES.items()]
    out = scanned.withColumn("_topics", F.filter(F.array(*shown), lambda t: t.isNotNull()))
    inline = [F.when(_held("_found", _listed(INLINE_MARKS[level])) > 0, level).otherwise(0) for level in (3, 2)]
    out = out.withColumn("_marked", F.greatest(F.when(titled(3), 3).when(titled(2), 2).otherwise(0), F.col("_lines"), *inline))
    points = F.aggregate("_topics", F.lit(0), lambda s, t: s + F.when(t.isin(*STAFF_TOPICS), 2).otherwise(1))
    out = out.withColumns({"_topical": F.when(points >= TOPIC_POINTS, 2).otherwise(0), "_personal": F.when(F.size("_types") > 0, 2).otherwise(0)})
    reason = lambda kind, column: F.concat(F.lit(f"{kind}:C"), column.cast("string"))
    reasons = F.filter(
        F.array(
            reason("source", F.col("_source")),
            reason("declared", F.col("_declared")),
            F.when(F.col("_stated") > 0, reason("stated", F.col("_stated"))),
            F.when(F.col("_marked") > 0, reason("marking", F.col("_marked"))),
            F.when(F.col("_topical") > 0, F.concat(F.lit("topics:C2:"), F.array_join("_topics", ","))),
            F.when(F.col("_personal") > 0, F.concat(F.lit("personal:C2:"), F.array_join("_types", ","))),
        ),
        lambda r: r.isNotNull(),
    )
    level = F.greatest(F.coalesce("_source", F.lit(0)), F.coalesce("_declared", F.lit(0)), "_stated", "_marked", "_topical", "_personal")
    return out.select(*keep, F.struct(level.alias("level"), reasons.alias("reasons"), F.col("_topics").alias("topics")).alias(name))
