"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams of bytes is derived: every string that the expression can match
contains the trigrams of one branch of the query. A block of documents (rows of one Arrow batch) gets an inverted index: one pass
over the bytes of its texts codes the trigram at every place, and those that some rule mentions become postings, trigram to
documents, as written and with A-Z lower-cased. A rule's query intersects and unites postings, and the expression runs over the
whole text of the documents left. A rule that no trigram is mandatory for runs over every document.

Scale: the index is partitioned by document block, so its postings are never shuffled and a block lost with an executor is
built again from its input. There is no exchange at all: one scan, one row out for each row in.

Defined cases: null texts count as empty and have no spans; repeated rows each get their row; very long texts are searched
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    """``group``: the group whose length has to reach ``least`` (0: the match). Matches that don't are dropped, not shortened."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False


#: The base rules, in the order their kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Further public credential formats, which add spans.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
)
BRANCH_LIMIT = 64


def trigram_query(pattern: str, any_case: bool = False) -> tuple[frozenset[str], ...] | None:
    """The query in disjunctive form: a tuple of trigram sets, of which a matching text holds at least one set whole.

    None if some match needs no trigram. The trigrams are lower-case for rules that ignore case.
    """
    branches = [x.lower() if any_case else x for x in _literals(_parser.parse(pattern))]
    runs = [[run.encode().decode("latin-1") for run in branch.split("\0")] for branch in branches]
    grams = {frozenset(run[i : i + 3] for run in branch for i in range(len(run) - 2)) for branch in runs}
    if not grams or frozenset() in grams:
        return None
    return tuple(sorted((g for g in grams if not any(o < g for o in grams)), key=sorted))


def _literals(parsed) -> list[str]:
    """Literal runs that each way of matching contains; a NUL stands where something unknown lies between two runs."""
    ways = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            step = [chr(value)]
        elif name == "SUBPATTERN":
            step = _literals(value[-1])
        elif name == "BRANCH":
            step = [way for branch in value[1] for way in _literals(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = value
            inner = _literals(body)
            if low == 0:
                step = ["", *inner] if high == 1 and all(len(x) < 8 and "\0" not in x for x in inner) and len(body) == 1 and str(body[0][0]) == "LITERAL" else ["\0"]
            else:
                step = [x if high == 1 else x + "\0" for x in inner] if low == 1 else [x + "\0" + x for x in inner]
        elif name == "IN" and len(value) <= 6 and all(str(o) == "LITERAL" for o, _ in value):
            step = [chr(v) for _, v in value]
        elif name == "AT":
            step = [""]
        else:
            step = ["\0"]
        if len(ways) * len(step) > BRANCH_LIMIT:
            step = ["\0"]
        ways = [way + more for way in ways for more in step]
    return ways


def _matcher(rule: Rule) -> re.Pattern[str]:
    # Runs of a class without a literal are looked for at their least length: shorter runs are dropped in any case.
    pattern = f"{rule.pattern[:-1]}{{{rule.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) else rule.pattern
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def _spans(rule: Rule, matcher: re.Pattern[str], text: str) -> list[tuple[int, int]]:
    return [m.span() for m in matcher.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_block(texts: list[str], rules: tuple[Rule, ...]) -> list[list[list[tuple[int, int]]]]:
    """For each text, the spans by rule: postings of the block, Boolean queries over them, verification."""
    queries = [trigram_query(r.pattern, r.any_case) for r in rules]
    wanted = {fold: sorted({t for r, q in zip(rules, queries, strict=True) if q and r.any_case == fold for branch in q for t in branch}) for fold in (False, True)}
    postings = {(fold, t): found for fold, grams in wanted.items() for t, found in inverted_index(texts, grams, fold).items()}
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in rules] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        if query is None:
            candidates: set[int] | range = range(len(texts))
        else:
            candidates = set().union(*(set.intersection(*(postings[rule.any_case, t] for t in branch)) for branch in query))
        matcher = _matcher(rule)
        for i in candidates:
            found[i][k] = _spans(rule, matcher, texts[i])
    return found


def inverted_index(texts: list[str], grams: list[str], fold: bool, piece: int = 1 << 22) -> dict[str, set[int]]:
    """Postings of a block: for each of the trigrams the numbers of the texts that hold it. Bytes are read ``piece`` at a time."""
    postings: dict[str, set[int]] = {t: set() for t in grams}
    if not grams:
        return postings
    known = np.zeros(1 << 24, bool)
    code_of = {(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2]): t for t in grams}
    known[list(code_of)] = True
    lower = np.arange(256, dtype=np.int32)
    if fold:
        lower[ord("A") : ord("Z") + 1] += 32
    # A line of zeros between texts keeps trigrams of two texts apart; no rule has a NUL.
    encoded = [t.encode() for t in texts]
    starts = np.cumsum([0] + [len(e) + 2 for e in encoded[:-1]])
    raw = np.frombuffer(b"\0\0".join(encoded), np.uint8)
    for at in range(0, len(raw), piece):
        b = lower[raw[at : at + piece + 2]]
        codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        places = np.flatnonzero(known[codes])
        docs = np.searchsorted(starts, places + at, side="right") - 1
        for pair in np.unique((codes[places].astype(np.int64) << 32) | docs).tolist():
            postings[code_of[pair >> 32]].add(pair & 0xFFFFFFFF)
    return postings


def _digest(found: list[list[tuple[int, int]]], rules: tuple[Rule, ...]) -> str:
    spans = sorted((start, k, end) for k, spans in enumerate(found) for start, end in spans)
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in spans)


def scan_secrets(documents: DataFrame, base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES, block_rows: int = 512) -> DataFrame:
    """doc_id, one count ``n_<kind>`` for each base rule, base_sha256, spans (``kind:start:end`` by start, then kind)."""
    rules = (*base, *more)
    schema = ", ".join(["doc_id long", *(f"n_{r.kind} long" for r in base), "base_sha256 string", "spans string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                block = batch.slice(at, block_rows)
                found = scan_block([t or "" for t in block.column(1).to_pylist()], rules)
                counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in range(len(base))]
                hashes = pa.array([hashlib.sha256(_digest(f[: len(base)], rules).encode()).hexdigest() for f in found])
                yield pa.RecordBatch.from_arrays([block.column(0), *counts, hashes, pa.array([_digest(f, rules) for f in found], pa.string())], names=["doc_id", *(f"n_{r.kind}" for r in base), "base_sha256", "spans"])

    ids = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return ids.mapInArrow(run, schema)
