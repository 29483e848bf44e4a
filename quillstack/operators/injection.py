"""Instructions hidden in content: seven signs with their weights, hidden text, and a score with the reasons for it.

Defined cases: null and empty texts score 0 without reasons; without a raw form only the text's own invisible characters count; a sign counts once
however often it occurs. Everything is a column expression over one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold, let, squeeze

#: Signs, their weights and patterns, for folded text.
SIGNS: tuple[tuple[str, float, tuple[str, ...]], ...] = (
    (
        "IGNORE_INSTRUCTIONS",
        0.7,
        (
            r"\b(ignore|disregard|forget|override|bypass)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all|any|your|the system)\b[^.\n]{0,30}\b(instructions?|prompts?|rules|directives|guidelines)\b",
            r"\b(ignorez?|ignorer|oubliez?|oublier|ne (?:tiens|tenez) (?:pas|plus) compte d?e?s?|fais abstraction des|faites abstraction des)\s+(?:de\s+)?(?:toutes?\s+)?(?:les|tes|vos)\s+(?:\w+\s+)?(instructions|consignes|directives|regles)\s+(precedentes|anterieures|ci-dessus|plus haut|initiales|systeme|du systeme)",
            r"\b(ignorez?|ignorer|oubliez?|oublier)\s+(toutes\s+(?:les|tes|vos)|tes|vos)\s+(instructions|consignes|directives|regles)\b",
        ),
    ),
    (
        "ROLE_MARKER",
        0.55,
        (
            r"(?m:^)\s*#*\s*(system|assistant|developer|systeme)\s*(prompt)?\s*:",
            r"<\|\s*(im_start|im_end|system|endoftext|assistant)\s*\|>",
            r"\[/?(inst|sys)\]",
            r"<</?sys>>",
            r"</?(system|instructions?|untrusted_content)>",
        ),
    ),
    (
        "ADDRESSED_TO_MODEL",
        0.45,
        (
            r"\b(you are now|act as an?|pretend (to be|you are)|from now on,? you|as an ai (language )?model,? you|(dear|hey) (ai|assistant|llm|chatbot|agent|model)\b|(note|message|instructions?) (to|for) (the )?(ai|assistant|llm|agent|model)\b|new instructions:)",
            r"\b(tu es desormais|vous etes desormais|a partir de maintenant,? (tu|vous)|agis comme|agissez comme|fais semblant d'etre|(cher|chere) (ia|assistant|agent|modele)\b|(note|message|consignes?) (pour|a) l'(ia|assistant|agent|modele)\b|(a|pour) l'attention de l'(ia|assistant|agent)\b|nouvelles consignes\s*:)",
        ),
    ),
    (
        "SECRET_REQUEST",
        0.5,
        (
            r"\b(reveal|print|output|repeat|send|leak|disclose|exfiltrate|share)\b[^.\n]{0,40}\b(system prompt|your instructions|api[ _-]?keys?|passwords?|secrets?|credentials|access tokens?)\b",
            r"\b(revele|revelez|affiche|affichez|envoie|envoyez|divulgue|divulguez|transmets|transmettez|recopie|recopiez)\b[^.\n]{0,40}\b(prompt systeme|tes instructions|vos instructions|cles? d'api|mots? de passe|secrets?|identifiants|jetons? d'acces)\b",
        ),
    ),
    (
        "EXFILTRATION_LINK",
        0.6,
        (
            r"!\[[^\]]*\]\(\s*https?://[^)\s]+\?[^)\s]*=",
            r"https?://[^\s)\"']*(\{\{|\{[a-z_]+\}|%7b|\$\{|\[(data|secret|conversation)\])",
            r"\b(send|post|forward|upload|append)\b[^.\n]{0,40}\b(to|vers)\s+https?://",
            r"\b(envoie|envoyez|transmets|transmettez|ajoute|ajoutez)\b[^.\n]{0,50}(\ba|\bvers|\bdans)\s+(l'url\s+)?https?://",
        ),
    ),
    (
        "SUSPICIOUS_ENCODING",
        0.3,
        (
            r"<\s*script\b",
            r"\bjavascript:",
            r"data:[a-z/+-]+;base64,",
            r"[a-z0-9+/]{160}",
            r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]",
        ),
    ),
    ("UNICODE_TAGS", 0.6, (r"[\x{E0000}-\x{E007F}]{3}",)),
)
#: Invisible characters, how many make a sign, its weight, and the least hidden wording that counts.
INVISIBLE = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{AD}]"
INVISIBLE_LEAST, HIDDEN_WEIGHT, HIDDEN_LETTERS, PROBE_LETTERS = 3, 0.4, 12, 60
#: Elements that a style hides with what they hold, and comments.
HIDDEN_ELEMENT = (
    r"(?is)<([a-z][a-z0-9]*)\b[^>]*style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?:px|pt|em)?\s*[;\"']|opacity\s*:\s*0(?:\.0+)?\s*[;\"']|color\s*:\s*(?:#fff(?:fff)?|white)\b)"
    r"[^\"']*[\"'][^>]*>(.*?)</\1\s*>"
)
COMMENT = r"(?s)<!--(.*?)-->"
BEFORE, AFTER, EXCERPT = 20, 40, 160


def sign_pattern(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def hidden_snippets(raw: Column) -> Column:
    """The wording of hidden elements and comments of a raw text, where it is long enough to count."""
    bodies = F.concat(F.regexp_extract_all(raw, F.lit(HIDDEN_ELEMENT), F.lit(2)), F.regexp_extract_all(raw, F.lit(COMMENT), F.lit(1)))
    plain = F.transform(bodies, lambda b: squeeze(F.regexp_replace(b, "<[^>]+>", " ")))
    return F.filter(F.coalesce(plain, F.array().cast("array<string>")), lambda b: F.length(b) >= HIDDEN_LETTERS)


def _excerpt(low: Column, pattern: str) -> Column:
    """What the pattern finds first, with some letters around it."""
    hit = F.regexp_substr(low, F.lit(pattern))
    at = F.call_function("locate", hit, low)
    first = F.greatest(F.lit(1), at - BEFORE)
    return F.substring(squeeze(F.regexp_replace(F.substring(low, first, at + F.length(hit) + AFTER - first), INVISIBLE, "")), 1, EXCERPT)


def findings(text: Column, raw: Column | None = None, classifier: Column | None = None) -> Column:
    """struct<score, reasons: array<struct<code, weight, excerpt>>>: 1 less the product of what each sign leaves.

    ``raw``: the document's form before its text was taken, whose hidden wording counts where the text shows it, and whose invisible characters
    count where there is another reason. ``classifier``: a further score from 0 to 1, which counts if it is higher. Excerpts are folded.
    """

    def of(low: Column) -> Column:
        reason = lambda code, weight, excerpt: F.struct(F.lit(code).alias("code"), (F.lit(weight) if isinstance(weight, float) else weight).cast("double").alias("weight"), excerpt.alias("excerpt"))
        signs = F.filter(F.array(*[F.when(low.rlike(sign_pattern(p)), reason(code, weight, _excerpt(low, sign_pattern(p)))) for code, weight, p in SIGNS]), lambda r: r.isNotNull())

        def with_hidden(reasons: Column) -> Column:
            own = F.regexp_count(low, F.lit(INVISIBLE)) >= INVISIBLE_LEAST
            hidden = F.when(own, reason("HIDDEN_TEXT", HIDDEN_WEIGHT, F.lit("")))
            if raw is not None:
                flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
                shown = F.get(F.filter(hidden_snippets(raw), lambda s: F.contains(flat, F.substring(s, 1, PROBE_LETTERS))), 0)
                hidden = F.coalesce(
                    hidden,
                    F.when(shown.isNotNull(), reason("HIDDEN_TEXT", HIDDEN_WEIGHT, F.substring(shown, 1, EXCERPT))),
                    F.when((F.size(reasons) > 0) & (F.regexp_count(F.coalesce(raw, F.lit("")), F.lit(INVISIBLE)) >= INVISIBLE_LEAST), reason("HIDDEN_TEXT", HIDDEN_WEIGHT, F.lit(""))),
                )
            model = F.when(classifier.isNotNull(), reason("CLASSIFIER", classifier, F.lit(""))) if classifier is not None else None
            found = F.filter(F.concat(reasons, F.array(hidden)), lambda r: r.isNotNull())

            def scored(every: Column) -> Column:
                score = 1 - F.aggregate(every, F.lit(1.0), lambda left, r: left * (1 - r["weight"]))
                told = F.concat(every, F.filter(F.array(model), lambda r: r.isNotNull())) if model is not None else every
                best = F.greatest(score, F.coalesce(classifier, F.lit(0.0))) if classifier is not None else score
                return F.struct(F.round(F.least(F.lit(1.0), best), 4).alias("score"), told.alias("reasons"))

            return let(found, scored)

        return let(signs, with_hidden)

    nothing = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<struct<code: string, weight: double, excerpt: string>>").alias("reasons"))
    return F.when(F.coalesce(text, F.lit("")) == "", nothing).otherwise(let(fold(F.coalesce(text, F.lit(""))), of))
