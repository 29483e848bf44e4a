"""Near-duplicate documents by b-bit MinHash.

Every document gets ``bands x rows`` minima over its distinct word shingles. A key for each band finds candidates; the low
``bits`` bits of all minima, packed, give a similarity estimate by bit counts that is corrected for chance agreement, and
candidates whose estimate lies far below the threshold go. What is left is confirmed on the full shingle sets.

With 32 bands of 5 rows a pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8**5)**32 > 0.999996. The estimate
of 160 2-bit minima has a standard error below 0.04 at 0.8; pairs are kept from 0.8 less six of these errors on. Documents of
buckets that the first round leaves open get a finer signature, 4096 1-bit minima with a standard error below 0.0095, and the
same six errors then leave little between 0.74 and 0.8 to confirm.

Scale and skew. Documents with equal sets are one class from the start (a combined minimum per digest), so copies never meet
in pairs. In a bucket of many different classes pairs are not all made: classes are compared with leaders of the bucket,
links unite components, and only buckets that still hold more than one component go into the next round, with about 64 and then four
times as many leaders, drawn by hash from all but the largest component. A leader that has met the others of its bucket leaves it, so no pair of the bucket
is lost: when a bucket is done, each two of its classes are in one component or have met. Leaders and members meet in an
equi-join whose condition holds the estimate, so pairs that cannot link are never written. Intermediate results are tables in
the shared folder.

Defined cases: null and blank texts have an empty set and are linked with nothing; a null doc_id is linked with nothing, gets a
null component and is kept; doc_id is taken to identify a text: repeated rows are one document and each gets its row; an
empty table gives no rows; long texts are used whole; other columns are ignored (``near_duplicates``) or kept (``drop_near_duplicates``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components
from .shingles import MinHasher, shingle_sets

BANDS, ROWS, BITS = 32, 5, 2
FINE = 4096
FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig array<long>"


def _features(k: int):
    hasher = MinHasher(BANDS, ROWS, BITS)

    def lists(rows: list[np.ndarray | None]) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum([0 if r is None else len(r) for r in rows]))).astype(np.int32)
        full = [r for r in rows if r is not None]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(full) if full else np.empty(0, np.int64), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, minima = [], [], []
            for values in shingle_sets(batch.column(1), k):
                sizes.append(len(values))
                if len(values):
                    digests.append(np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64))
                    minima.append(hasher.minima(values))
            rows = np.array(minima, np.uint64).reshape(-1, BANDS * ROWS)
            keys, sigs = iter(hasher.keys(rows)), iter(hasher.packed(rows))
            full, marks = [n > 0 for n in sizes], iter(digests)
            pairs = [next(marks) if f else (None, None) for f in full]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([None if p[0] is None else int(p[0]) for p in pairs], pa.int64()),
                    pa.array([None if p[1] is None else int(p[1]) for p in pairs], pa.int64()),
                    lists([next(keys) if f else None for f in full]),
                    lists([next(sigs) if f else None for f in full]),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"],
            )
            pa.default_memory_pool().release_unused()

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # In small pieces: a set takes about twice the bytes of its text.
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                sets = list(shingle_sets(piece.column(1), k))
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["vid", "shingles"])

    return run


def _fine_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = MinHasher(1, FINE, 1, seed=8)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            piece = batch.slice(at, 64)
            minima = [hasher.minima(np.asarray(v.values).view(np.uint64)) for v in piece.column(1)]
            packed = hasher.packed(np.array(minima))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(packed) + 1, dtype=np.int32) * (FINE // 64)), pa.array(packed.ravel()))], names=["vid", "fine"])
        pa.default_memory_pool().release_unused()


def _fine_estimate(a: str, b: str) -> F.Column:
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    return 1 - 2 * differing / F.lit(float(FINE))


def _estimate(a: str, b: str) -> F.Column:
    """Collision-corrected similarity of two packed signatures."""
    words = -(-BANDS * ROWS // 64)
    differing = F.lit(0)
    for w in range(words):
        planes = [F.element_at(a, p * words + w + 1).bitwiseXOR(F.element_at(b, p * words + w + 1)) for p in range(BITS)]
        either = planes[0]
        for plane in planes[1:]:
            either = either.bitwiseOR(plane)
        differing = differing + F.bit_count(either)
    chance = 1 / 2**BITS
    return ((1 - differing / F.lit(float(BANDS * ROWS))) - chance) / (1 - chance)


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "neardup")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = scratch.keep(texts.mapInArrow(_features(k), FEATURES), "features")
    classes = scratch.keep(feats.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("vid")), "classes")
    c = classes.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "vid")
    reps = feats.join(c, (F.col("doc_id") == F.col("vid")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")))
    reps = scratch.keep(reps.select("vid", F.col("n_shingles").alias("n"), "bands", "sig").dropDuplicates(["vid", "n"]), "reps")

    # Buckets of two and more classes.
    rows = reps.select("vid", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("vid").alias("leader")).where("size > 1")
    placed = scratch.keep(rows.join(shared.select(F.col("key").alias("s_key"), "leader"), F.col("key") == F.col("s_key")).select("key", "vid", "leader"), "placed")
    signed = reps.select(F.col("vid").alias("r_vid"), "n", "sig")
    members = scratch.keep(placed.join(signed, F.col("vid") == F.col("r_vid")).select("key", "vid", "n", "sig", "leader"), "members")
    if members.limit(1).count() == 0:
        return _result(feats, classes, None)
    wanted = scratch.keep(members.select("vid").distinct(), "wanted")
    sets = texts.join(wanted, texts["doc_id"] == wanted["vid"], "left_semi").dropDuplicates(["doc_id", "text"]) if _repeats(feats) else texts.join(wanted, texts["doc_id"] == wanted["vid"], "left_semi")
    sets = scratch.keep(sets.mapInArrow(_full_sets(k), "vid long, shingles array<long>"), "sets")

    leaders = scratch.keep(members.where("vid = leader").select("key", F.col("vid").alias("l_vid"), F.col("n").alias("l_n"), F.col("sig").alias("l_sig"), F.col("vid").alias("l_comp")), "leaders")
    active = members.drop("leader").withColumn("comp", F.col("vid"))
    labels, turn = None, 0
    while True:
        links = _links(active, leaders, sets, percent, scratch)
        joined = components(links, scratch)
        labels = scratch.keep(joined.select(F.col("v").alias("vid"), F.col("root").alias("label")) if labels is None else _relabel(labels, joined), "labels")
        rest = active.join(leaders.select(F.col("key").alias("l_key"), "l_vid"), (F.col("key") == F.col("l_key")) & (F.col("vid") == F.col("l_vid")), "left_anti").drop("comp")
        rest = rest.join(labels.withColumnRenamed("vid", "b_vid"), F.col("vid") == F.col("b_vid"), "left").withColumn("comp", F.coalesce("label", "vid")).drop("b_vid", "label")
        rest = scratch.keep(rest, "rest")
        open_keys = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("key").alias("o_key"))
        again = scratch.keep(rest.join(open_keys, F.col("key") == F.col("o_key"), "left_semi"), "active")
        scratch.drop(rest, leaders, active)
        if again.limit(1).count() == 0:
            break
        active, turn = again, turn + 1
        if turn == 1:
            open_ids = active.select(F.col("vid").alias("o_vid")).distinct()
            fine = scratch.keep(sets.join(open_ids, F.col("vid") == F.col("o_vid"), "left_semi").mapInArrow(_fine_signatures, "vid long, fine array<long>"), "fine")
            known = fine.join(reps.select(F.col("vid").alias("r_vid"), "bands"), F.col("vid") == F.col("r_vid")).select(F.col("vid").alias("f_vid"), "fine", "bands")
            active = scratch.keep(active.join(known, F.col("vid") == F.col("f_vid")).drop("f_vid"), "active")
        active = active.withColumn("draw", F.xxhash64(F.lit(turn), "vid"))
        chosen = _choice(active, 16 * 4**turn, scratch)
        drawn = F.shiftrightunsigned("draw", 11) * F.lit(2.0**-53)
        full = active.join(chosen, F.col("key") == F.col("c_key")).where((F.col("comp") != F.col("main")) & ((F.col("draw") == F.col("least")) | (drawn < F.col("share"))))
        leaders = scratch.keep(full.select("key", F.col("vid").alias("l_vid"), F.col("n").alias("l_n"), F.col("sig").alias("l_sig"), F.col("comp").alias("l_comp"), F.col("fine").alias("l_fine"), F.col("bands").alias("l_bands")), "leaders")
        active = active.drop("draw")
    scratch.drop(members, sets, reps)
    return _result(feats, classes, labels)


def _choice(active: DataFrame, wanted: int, scratch: Scratch) -> DataFrame:
    """(c_key, main, share, least): for each bucket its largest component, the share of the others' members to draw as leaders, and their least draw.

    About ``wanted`` members are drawn and at least one. Sums and minima are combined before each shuffle, so no task sees the members of a bucket.
    """
    sizes = scratch.keep(active.groupBy("key", "comp").agg(F.count("*").alias("size"), F.min("draw").alias("low")), "sizes")
    largest = sizes.groupBy(F.col("key").alias("g_key")).agg(F.max(F.struct("size", "comp")).alias("top"))
    minor = sizes.join(largest, F.col("key") == F.col("g_key")).where(F.col("comp") != F.col("top.comp"))
    chosen = minor.groupBy(F.col("key").alias("c_key")).agg(F.first("top.comp").alias("main"), (F.lit(float(wanted)) / F.sum("size")).alias("share"), F.min("low").alias("least"))
    return scratch.keep(chosen, "chosen")


def _repeats(feats: DataFrame) -> bool:
    return feats.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _links(active: DataFrame, leaders: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): components of which a member and a leader share a bucket and are confirmed on the full sets."""
    near = (
        (active["key"] == leaders["key"])
        & (F.col("vid") != F.col("l_vid"))
        & (F.col("comp") != F.col("l_comp"))
        & (100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n"))
        & (_estimate("sig", "l_sig") >= percent / 100 - 0.23)
    )
    if "fine" in active.columns:
        # Two documents share many buckets: they meet in the first of them, where one or the other leads some time.
        meet = near & (active["key"] == F.array_min(F.array_intersect("bands", "l_bands")))
        near = F.when(meet, _fine_estimate("fine", "l_fine") >= percent / 100 - 0.06).otherwise(F.lit(False)) & (active["key"] == leaders["key"])
    met = active.join(leaders, near)
    pairs = met.select(F.col("vid").alias("a"), F.col("l_vid").alias("b"), F.col("comp").alias("ca"), F.col("l_comp").alias("cb")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    first = pairs.join(sets.select(F.col("vid").alias("va"), F.col("shingles").alias("sa")), F.col("a") == F.col("va"))
    both = first.select("b", "ca", "cb", "sa").join(sets.select(F.col("vid").alias("vb"), F.col("shingles").alias("sb")), F.col("b") == F.col("vb"))
    common = F.size(F.array_intersect("sa", "sb"))
    linked = both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common")))
    return scratch.keep(linked.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")


def _relabel(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """The labels after some components have joined others; ``joined`` maps former roots, which had no label so far."""
    moved = labels.join(joined, F.col("label") == F.col("v"), "left").select("vid", F.coalesce("root", "label").alias("label"))
    return moved.unionByName(joined.select(F.col("v").alias("vid"), F.col("root").alias("label")))


def _result(feats: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    c = classes.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "vid")
    if labels is not None:
        c = c.join(labels.withColumnRenamed("vid", "b_vid"), F.col("vid") == F.col("b_vid"), "left").select("c1", "c2", F.coalesce("label", "vid").alias("vid"))
        c = Scratch(feats.sparkSession, "neardup").keep(c, "roots")
    out = feats.join(c, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("vid", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have a smaller doc_id in their component; rows that repeat a doc_id go down to one."""
    scratch = Scratch(documents.sparkSession, "neardup")
    judged = scratch.keep(near_duplicates(documents, k, percent), "judged")
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_qs_gone")).distinct()
    left = documents.join(gone, F.col("doc_id") == F.col("_qs_gone"), "left_anti")
    if _repeats(judged):
        left = left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))
    return left
