"""Lexical lists against brute force, over several blocks of queries and slices of documents."""

import math
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from quillstack.operators import search
from quillstack.scratch import Scratch


@pytest.mark.parametrize(("block", "products"), [(200_000, 1_000_000), (6, 40)])
def test_lexical_lists_are_whole_and_keep_a_row_for_a_document(spark, monkeypatch, block, products):
    rnd = random.Random(4)
    vocabulary = [f"word{i}" for i in range(12)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 12))) for _ in range(200)] + ["word1 word2 word2"] * 30 + ["", None, "ab"]
    asked = {q: sorted(set(rnd.sample(vocabulary, 4))) for q in range(8)}
    sizes, keep = [], Scratch.keep

    def counted(self, df, name):
        sizes.append((table := keep(self, df, name)).count())
        return table

    monkeypatch.setattr(Scratch, "keep", counted)
    monkeypatch.setattr(search, "BLOCK", block, raising=False)
    monkeypatch.setattr(search, "PRODUCTS", products, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    queries = spark.createDataFrame([(f"q{q}", " ".join(words)) for q, words in asked.items()] + [("none", None), ("other", "elsewhere")], "q string, text string")
    best, shares = search.lexical_lists(docs, queries, "doc", "q", 5)

    bags = [Counter(w for w in (t or "").split() if len(w) > 2) for t in texts]
    average, df = sum(sum(b.values()) for b in bags) / len(bags), Counter(w for b in bags for w in b)
    idf = {w: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    weigh = lambda bag, w: idf[w] * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / average)) if bag[w] else 0.0

    def want(score):
        out = set()
        for q, words in asked.items():
            scored = sorted((-round(score(bag, words), 6), d) for d, bag in enumerate(bags) if any(bag[w] for w in words))[:5]
            out |= {(f"q{q}", d, -s, rank) for rank, (s, d) in enumerate(scored, 1)}
        return out

    assert {tuple(r) for r in best.collect()} == want(lambda bag, words: sum(weigh(bag, w) for w in words))
    assert {tuple(r) for r in shares.collect()} == want(lambda bag, words: sum(1 for w in words if bag[w]) / len(words))
    assert max(sizes) <= len(texts)


def test_nothing_asked_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "word")], "doc long, text string")
    assert search.bm25(docs, docs.limit(0).withColumnRenamed("doc", "q"), "doc", "q").collect() == []
    assert search.bm25(docs.limit(0), spark.createDataFrame([(1, "word")], "q long, text string"), "doc", "q").collect() == []


def test_queries_are_named_without_a_session():
    """The entry can be read before any session exists."""
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=root, check=True)
