"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE_WORDS`` words each, all of its text). Every passage is encoded by measures of its
words and bytes; a small network embeds it, gated attention weighs the passages of a document, and the weighted representation
is scored by a logistic unit. Only document labels are known; which passages decide is learned with the rest.

Training takes a bounded sample: the ``max_documents`` labelled documents of smallest id hash outside the held-out fold, one text
each, as many of them in that order as hold at most ``max_passages`` passages together; one that does not fit is left out. Of a text
longer than an eighth of that, training sees passages evenly spread over all of it. The sample's encoded passages are small and are fitted on the driver with
fixed seeds. Everything else - encoding and scoring every passage of every document - runs in tasks over Arrow batches, without
an exchange. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: a null, empty or blank text has one passage of zeros and gets its score like any other; label rows without doc_id
or quality are ignored, several for one document are averaged; without labels of both classes every score is their mean (0.5
without labels); repeated rows score alike, and a doc_id with several texts trains with the one of smallest hash; an empty table
gives no rows; a null doc_id is not held out; other columns are ignored (``score_documents``) or kept (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .shingles import word_hashes

PASSAGE_WORDS = 64
BUCKETS = 64
MEASURES = 18
WIDTH = MEASURES + BUCKETS
THRESHOLD = 0.3
SLICE_BYTES = 1 << 20


def _byte_classes() -> np.ndarray:
    """0 other symbol, 1 upper, 2 lower, 3 digit, 4 sentence mark, 5 blank, 6 line end, 7 beyond ASCII."""
    kinds = np.zeros(256, np.int64)
    kinds[ord("A") : ord("Z") + 1], kinds[ord("a") : ord("z") + 1], kinds[ord("0") : ord("9") + 1] = 1, 2, 3
    kinds[[ord(c) for c in ".,;:'"]] = 4
    kinds[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], kinds[0x0A], kinds[128:] = 5, 6, 7
    return kinds


_CLASS = _byte_classes()


def encode_text(raw: np.ndarray) -> np.ndarray:
    """One row of measures for each passage of a text given as bytes; at least one row."""
    hashes, starts = word_hashes(raw)
    if not len(starts):
        return np.zeros((1, WIDTH), np.float32)
    n = -(-len(starts) // PASSAGE_WORDS)
    parts = []
    # A very long text is encoded some thousands of passages at a time.
    step = SLICE_BYTES // 512
    for first in range(0, n, step):
        words = slice(first * PASSAGE_WORDS, (first + step) * PASSAGE_WORDS)
        begin = int(starts[words][0])
        rest = starts[words.stop :]
        end = int(rest[0]) if len(rest) else len(raw)
        parts.append(_encode(raw[begin:end], hashes[words], starts[words] - begin))
    return np.concatenate(parts)


def _encode(raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    heads = starts[::PASSAGE_WORDS]
    n = len(heads)
    sizes = np.diff(np.append(heads, len(raw))).astype(np.float64)
    of_byte = np.repeat(np.arange(n), sizes.astype(np.int64))
    kinds = _CLASS[raw]
    share = np.bincount(of_byte * 8 + kinds, minlength=n * 8).reshape(n, 8) / sizes[:, None]
    codes = (_CLASS[raw[:-1]] * 8 + _CLASS[raw[1:]]) if len(raw) > 1 else np.zeros(0, np.int64)
    pairs = np.bincount(of_byte[:-1] * BUCKETS + codes, minlength=n * BUCKETS).reshape(n, BUCKETS) / sizes[:, None]

    of_word = np.arange(len(starts)) // PASSAGE_WORDS
    count = np.bincount(of_word, minlength=n).astype(np.float64)
    lengths = np.diff(np.append(starts, len(raw))).astype(np.float64)
    mean = np.bincount(of_word, lengths, n) / count
    spread = np.sqrt(np.maximum(np.bincount(of_word, lengths**2, n) / count - mean**2, 0))
    key = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)))
    runs = np.diff(np.append(fresh, len(key)))
    owner = (key[fresh] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n) / count
    most = np.zeros(n)
    np.maximum.at(most, owner, runs)
    again = np.zeros(len(starts))
    again[1:] = hashes[1:] == hashes[:-1]
    capital = (kinds[starts] == 1).astype(np.float64)
    symbol = np.isin(kinds[starts], (0, 3)).astype(np.float64)
    short = (lengths <= 4).astype(np.float64)
    by_word = [np.bincount(of_word, x, n) / count for x in (again, capital, symbol, short)]
    out = np.column_stack([share, mean / 10, spread / 10, distinct, most / count, *by_word, count / PASSAGE_WORDS, np.log1p(sizes) / 10, pairs])
    return out.astype(np.float32)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer((value.as_py() or "").encode(), np.uint8)


@dataclass(frozen=True)
class Model:
    """Weights of the network, or just a constant score."""

    constant: float | None
    params: dict[str, np.ndarray] | None = None

    def score(self, bags: np.ndarray, begins: np.ndarray) -> np.ndarray:
        if self.params is None:
            return np.full(len(begins), self.constant)
        return _forward(self.params, bags, begins)[0].astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, begins: np.ndarray):
    counts = np.diff(np.append(begins, len(x)))
    x = (x - p["mean"]) / p["scale"]
    h = np.tanh(x @ p["W"] + p["b"])
    a, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (a * g) @ p["w"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, begins), counts))
    att = s / np.repeat(np.add.reduceat(s, begins), counts)
    z = np.add.reduceat(att[:, None] * h, begins, axis=0)
    prob = _sigmoid(z @ p["c"] + p["d"])
    return prob, (x, h, a, g, att, z, counts)


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 40, seed: int = 11) -> Model:
    """Adam on the mean log loss of the documents, in seeded order."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.Generator(np.random.PCG64(seed))
    flat = np.concatenate(bags)
    p = {
        "W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), "b": np.zeros(hidden),
        "V": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gates)), "U": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gates)),
        "w": rng.normal(0, 1 / np.sqrt(gates), gates), "c": rng.normal(0, 1 / np.sqrt(hidden), hidden), "d": np.zeros(1),
    }
    fixed = {"mean": flat.mean(axis=0), "scale": flat.std(axis=0) + 0.02}
    first, second, turn = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(bags)), 0.01 * (0.93**epoch)
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            x, y = np.concatenate([bags[i] for i in some]), labels[some]
            begins = np.concatenate(([0], np.cumsum([len(bags[i]) for i in some])[:-1]))
            prob, (x, h, a, g, att, z, counts) = _forward(p | fixed, x, begins)
            off = (prob - y) / len(some)
            dz = np.repeat(off[:, None] * p["c"], counts, axis=0)
            pull = (dz * h).sum(axis=1)
            ds = att * (pull - np.repeat(np.add.reduceat(att * pull, begins), counts))
            da, dg = np.outer(ds, p["w"]) * g * (1 - a**2), np.outer(ds, p["w"]) * a * g * (1 - g)
            dh = (att[:, None] * dz + da @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
            grads = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ ds, "c": z.T @ off, "d": off.sum(keepdims=True)}
            turn += 1
            for k, grad in grads.items():
                grad = grad + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
    return Model(None, {k: np.asarray(v, np.float32) for k, v in (p | fixed).items()})


def _spread(encoded: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` passages, evenly spread over the text."""
    return encoded if len(encoded) <= most else encoded[np.linspace(0, len(encoded) - 1, most).astype(np.int64)]


def is_held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_documents: int = 4000, max_passages: int = 200_000) -> Model:
    scratch = Scratch(documents.sparkSession, "quality")
    usable = labels.where("doc_id is not null and quality is not null").where(~is_held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sample = known.withColumn("turn", F.xxhash64(F.lit(3), "doc_id")).orderBy("turn", "doc_id").limit(max_documents)
    sample = F.broadcast(scratch.keep(sample.select(F.col("doc_id").alias("s_id"), "label", "turn"), "sample"))  # max_documents rows

    most = max(1, max_passages // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                encoded = [_spread(encode_text(raw), most) for raw in _texts(piece.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([len(e) for e in encoded], pa.int64()), pa.array([e.tobytes() for e in encoded], pa.binary())],
                    names=["turn", "label", "passages", "encoded"],
                )

    texts = documents.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("s_id"))
    # However often a labelled document is repeated, one text of it is encoded and at most max_documents rows come to the driver.
    texts = texts.groupBy("s_id", "turn", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("turn", "label", "text")
    coded = scratch.keep(texts.mapInArrow(run, "turn long, label int, passages long, encoded binary"), "encoded")
    left, fits = max_passages, []
    for row in coded.select("turn", "passages").orderBy("turn", "passages").collect():  # max_documents rows
        if row["passages"] <= left:
            left -= row["passages"]
            fits.append((row["turn"], row["passages"]))
    wanted = F.broadcast(documents.sparkSession.createDataFrame(fits, "turn long, passages long"))
    chosen = coded.join(wanted, ["turn", "passages"], "left_semi").orderBy("turn", "passages").collect()
    bags = [np.frombuffer(r["encoded"], np.float32).reshape(-1, WIDTH) for r in chosen]
    return fit(bags, np.array([r["label"] for r in chosen], np.float64))


def with_scores(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``documents`` and the score of each row's whole text."""
    at = documents.columns.index("text")
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                bags = [encode_text(raw) for raw in _texts(piece.column(at))]
                begins = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
                scores = model.score(np.concatenate(bags), begins)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores, pa.float64())], names=[*piece.schema.names, name])
            pa.default_memory_pool().release_unused()

    return documents.mapInArrow(run, schema)


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each document."""
    model = train(documents, labels, **options)
    scored = with_scores(documents.select("doc_id", "text"), model).select("doc_id", "score")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the classifier does not reject."""
    model = train(documents, labels, **options)
    return with_scores(documents, model, "_qs_score").where(F.col("_qs_score") >= threshold).drop("_qs_score")
