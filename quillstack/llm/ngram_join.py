"""Jaccard join of documents by blocked products of the document by n-gram incidence.

A column of the incidence matrix is a word shingle (a 64-bit hash), a row a class of documents with equal sets. Two sets that reach
the threshold share a column among the first n - ceil(n * t) + 1 of each in any common order, so only these entries of a row are
posted. Rows meet in a column they share there, if their sizes allow the threshold: n and m by 100 * min >= t * max, and by the
columns that are left after the one they meet in; and by parities of their columns, ``BITS`` and then two for each column, which differ in no
more places than the sets do. What the bounds leave is multiplied exactly: rows of leaders are dealt to blocks of about
``BLOCK`` entries, rows that meet a leader of a block to parts of it of about as many, and each task sums the overlaps of its two
blocks column by column and discards every pair below ceil(t * (n + m) / (1 + t)).

Order. All columns are counted in ``SLOTS`` slots of their hashes, in the pass that makes the rows; a column whose slot holds
clearly more than the mean comes behind all that hold less, by doublings, and by hash among its like, so passages that many documents share are left to
documents that hold little else. The slots are a megabyte at every size; the order changes the work, never the result.

Scale and skew. Entries are dealt once by column, those of crowded slots also by row, and a column of one class goes before anything else
is moved. Copies are one class. In a column of many classes pairs are not all made: classes meet its leaders, links unite
components, and only columns with more than one component left go on, with more leaders from all but the largest component. A leader that
has met its column leaves it, so when a column is done each two of its classes are in one component or have met there; the first column that a
linked pair shares is one of them. Counts, minima and maxima are combined before the shuffle, joins are equi-joins that Spark splits.

Defined cases: null and blank texts have an empty set and are linked with nothing; a null doc_id is linked with nothing and gets a
null component; rows that repeat a doc_id are documents of their own under one id; an empty table gives no rows; long texts are used
whole; other columns are ignored.
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
from .near_dup import _choice, _relabel
from .shingles import shingle_sets

BLOCK, SLOTS, SLICE, SALTS, BITS, FEW = 1 << 20, 1 << 20, 1 << 14, 64, 1024, 200_000


def ngram_join(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each document."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "ngrams")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = scratch.keep(texts.mapInArrow(_rows(k), "doc_id long, n int, d1 long, d2 long, bits array<long>, more array<long>, slice int, counts binary"), "rows")
    rows = both.where("slice is null").drop("slice", "counts")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("low"), F.min("bits").alias("bits"), F.min("more").alias("more"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    members = _posted(texts.where("doc_id is not null"), _crowding(both), classes, k, percent, scratch)
    labels = _united(members, texts, classes, k, percent, scratch)
    found = classes
    if labels is not None:
        found = classes.join(labels.withColumnRenamed("vid", "l_vid"), F.col("cid") == F.col("l_vid"), "left").withColumn("comp", F.coalesce("label", "cid"))
        lowest = scratch.keep(found.groupBy(F.col("comp").alias("c")).agg(F.min("low").alias("lowest")), "lowest")
        found = found.join(lowest, F.col("comp") == F.col("c")).withColumn("low", F.col("lowest"))
    found = found.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "low")
    out = rows.join(found, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))


def _crowding(rows: DataFrame) -> np.ndarray:
    """For each slot 0 if its count is within four standard deviations of the mean, else 1 and one more for each doubling of what is beyond; a byte each."""
    slices = rows.where("slice is not null").select("slice", "counts", F.spark_partition_id().alias("salt"))
    for by in (["slice", F.pmod("salt", F.lit(32))], ["slice"]):
        dealt = slices.select("slice", "counts", "salt").repartition(*by).sortWithinPartitions("slice")
        slices = dealt.mapInArrow(_summed, "slice int, counts binary, salt int")
    total = np.zeros(SLOTS, np.int64)
    for r in slices.collect():
        total[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    mean = total.mean()
    beyond = (total - mean) / (4 * np.sqrt(mean) + 1)
    return np.where(beyond > 1, 1 + np.floor(np.log2(np.maximum(beyond, 1))), 0).astype(np.uint8)


def _posted(texts: DataFrame, crowding: np.ndarray, classes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(key, vid, n, at): the posted entries of columns that two and more classes may share; ``at``: place in the row's order."""
    posted = texts.mapInArrow(_postings(k, percent, crowding), "key long, salt int, d1 long, n int, at int")
    dealt = posted.repartition("key", "salt").sortWithinPartitions("key", "salt", "d1")
    shared = dealt.mapInArrow(_shared, "key long, d1 long, n int, at int")
    known = classes.select(F.col("d1").alias("c1"), F.col("n").alias("cn"), F.col("cid").alias("vid"))
    return scratch.keep(shared.join(known, (F.col("d1") == F.col("c1")) & (F.col("n") == F.col("cn"))).select("key", "vid", "n", "at"), "members")


def _united(members: DataFrame, texts: DataFrame, classes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """(vid, label) of every class that is linked with another; none at all gives None."""
    first = members.groupBy(F.col("key").alias("f_key")).agg(F.min("vid").alias("f_vid"), F.max("vid").alias("last")).where("f_vid <> last")
    leaders = scratch.keep(members.join(first, (F.col("key") == F.col("f_key")) & (F.col("vid") == F.col("f_vid"))).select(*_led("vid")), "leaders")
    active, labels, turn = members.withColumn("comp", F.col("vid")), None, 0
    while True:
        pairs = scratch.keep(_met(active, leaders, percent), "met")
        for parities in ("more",) if turn else ("bits", "more"):
            last, pairs = pairs, scratch.keep(_close(pairs, classes, parities, percent), "pairs")
            scratch.drop(last)
        if turn == 0 and pairs.limit(1).count() == 0:
            return None
        wanted = pairs.select(F.col("a").alias("vid")).unionByName(pairs.select(F.col("b").alias("vid"))).distinct()
        sets = _sets(texts, classes, wanted, k, scratch)
        joined = components(_product(pairs, sets, percent, scratch), scratch)
        labels = scratch.keep(joined.select(F.col("v").alias("vid"), F.col("root").alias("label")) if labels is None else _relabel(labels, joined), "labels")
        gone = leaders.select(F.col("key").alias("l_key"), "l_vid")
        rest = active.join(gone, (F.col("key") == F.col("l_key")) & (F.col("vid") == F.col("l_vid")), "left_anti").drop("comp")
        rest = rest.join(labels.withColumnRenamed("vid", "b_vid"), F.col("vid") == F.col("b_vid"), "left").withColumn("comp", F.coalesce("label", "vid")).drop("b_vid", "label")
        rest = scratch.keep(rest, "rest")
        open_keys = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("key").alias("o_key"))
        again = scratch.keep(rest.join(open_keys, F.col("key") == F.col("o_key"), "left_semi"), "active")
        scratch.drop(rest, leaders, active, pairs, sets)
        if again.limit(1).count() == 0:
            scratch.drop(again)
            return labels
        active, turn = again, turn + 1
        if turn == 1:  # from here on a column has several leaders, and the parities are compared where they meet
            known = classes.select(F.col("cid").alias("k_cid"), "bits")
            active = scratch.keep(active.join(known, F.col("vid") == F.col("k_cid")).drop("k_cid"), "active")
            scratch.drop(again)
        drawn = active.withColumn("draw", F.xxhash64(F.lit(turn), "vid"))
        chosen = _choice(drawn, 16 * 4**turn, scratch)
        share = F.shiftrightunsigned("draw", 11) * F.lit(2.0**-53)
        full = drawn.join(chosen, F.col("key") == F.col("c_key")).where((F.col("comp") != F.col("main")) & ((F.col("draw") == F.col("least")) | (share < F.col("share"))))
        leaders = scratch.keep(full.select(*_led("comp"), F.col("bits").alias("l_bits")), "leaders")
        scratch.drop(chosen)


def _led(comp: str) -> list:
    return ["key", F.col("vid").alias("l_vid"), F.col("n").alias("l_n"), F.col("at").alias("l_at"), F.col(comp).alias("l_comp")]


def _met(active: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb, na, nb): rows and leaders of other components that share a column and that the size bounds leave."""
    # The column they meet in and those behind it; exact for the first that they share, which is the one that counts.
    left = F.least(F.col("n") - F.col("at"), F.col("l_n") - F.col("l_at"))
    near = (
        (active["key"] == leaders["key"])
        & (F.col("comp") != F.col("l_comp"))
        & (100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n"))
        & (left * (100 + percent) >= percent * (F.col("n") + F.col("l_n")))
    )
    if "bits" in active.columns:
        # Sizes first: the parities are counted only for pairs that these leave.
        near = (active["key"] == leaders["key"]) & F.when(near, _alike("bits", "l_bits", "n", "l_n", percent)).otherwise(F.lit(False))
    met = active.join(leaders, near)
    return met.select(F.col("vid").alias("a"), F.col("l_vid").alias("b"), F.col("comp").alias("ca"), F.col("l_comp").alias("cb"), F.col("n").alias("na"), F.col("l_n").alias("nb")).distinct()


def _alike(a: str, b: str, n: str, m: str, percent: int) -> F.Column:
    """Whether the parities a and b differ in no more places than two sets of sizes n and m at the threshold do."""
    # Of twice as many places the halves are laid on each other: sizes within the threshold differ by one doubling at most.
    width = F.least(F.size(a), F.size(b))
    folded = lambda c: F.when(F.size(c) > width, F.zip_with(F.slice(c, F.lit(1), width), F.slice(c, width + 1, width), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    differing = F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    needed = F.ceil(percent * (F.col(n) + F.col(m)) / (100 + percent))
    return F.coalesce(differing <= F.col(n) + F.col(m) - 2 * needed, F.lit(True))


def _close(pairs: DataFrame, classes: DataFrame, parities: str, percent: int) -> DataFrame:
    """The pairs that their parities leave."""
    a, b = (classes.select(F.col("cid").alias(f"{x}_cid"), F.col(parities).alias(f"{x}_bits")) for x in "ab")
    both = pairs.join(a, F.col("a") == F.col("a_cid")).join(b, F.col("b") == F.col("b_cid"))
    return both.where(_alike("a_bits", "b_bits", "na", "nb", percent)).select(*pairs.columns)


def _sets(texts: DataFrame, classes: DataFrame, wanted: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(vid, columns): the whole rows of the classes in ``wanted``."""
    ids = scratch.keep(classes.join(wanted, F.col("cid") == F.col("vid")).select("vid", "low", F.col("d1").alias("w1"), F.col("d2").alias("w2")), "wanted")
    if ids.count() <= FEW:  # their 32 bytes a row go to all tasks, so that texts stay where they are
        ids = F.broadcast(ids)
    rows = texts.join(ids, F.col("doc_id") == F.col("low")).select("vid", "text", "w1", "w2")
    return scratch.keep(rows.mapInArrow(_whole_rows(k), "vid long, columns array<long>"), "sets")


def _product(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): components linked by pairs whose overlap, summed over all columns, reaches the bound."""
    heads = pairs.select("b", "cb", "nb").distinct()
    # The number of blocks follows from the entries of all leaders; a block of many rows is cut into parts, by entries too.
    blocks = max(1, (heads.agg(F.sum("nb")).first()[0] or 0) // BLOCK)
    block = F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int").alias("block")
    lines = scratch.keep(pairs.select("a", "ca", "na", block).distinct(), "lines")
    cuts = scratch.keep(lines.groupBy(F.col("block").alias("c_block")).agg(F.ceil(F.sum("na") / BLOCK).cast("int").alias("parts")), "cuts")
    s = sets.select(F.col("vid").alias("s_vid"), "columns")
    left = lines.join(cuts, F.col("block") == F.col("c_block")).join(s, F.col("a") == F.col("s_vid"))
    left = left.select("block", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("vid"), F.col("ca").alias("comp"), F.col("columns").alias("columns"))
    right = heads.withColumn("block", block).join(cuts, F.col("block") == F.col("c_block")).join(s, F.col("b") == F.col("s_vid"))
    right = right.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("vid"), F.col("cb").alias("comp"), F.col("columns").alias("columns"))
    linked = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_multiplied(percent), "a long, b long")
    links = scratch.keep(linked.distinct(), "links")
    scratch.drop(lines, cuts)
    return links


def _multiplied(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _Rows(left), _Rows(right)
        out = []
        if a.n and b.n:
            # Entries of the right block by column; a column's rows are a stretch of it.
            order = np.argsort(b.columns, kind="stable")
            columns, holders = b.columns[order], b.row[order]
            for lo, hi in a.stretches(1 << 16):
                at = slice(a.starts[lo], a.starts[hi])
                first, last = (np.searchsorted(columns, a.columns[at], side) for side in ("left", "right"))
                count = last - first
                overlap = np.zeros((hi - lo) * b.n, np.int32)
                for x, y in _cuts(count, 1 << 22):
                    c = count[x:y]
                    place = np.repeat(first[x:y] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
                    overlap += np.bincount(np.repeat(a.row[at][x:y] - lo, c) * b.n + holders[place], minlength=len(overlap)).astype(np.int32)
                both = a.sizes[lo:hi, None] + b.sizes[None, :]
                i, j = np.nonzero(overlap.reshape(hi - lo, b.n) * (100 + percent) >= percent * both)
                out.append(np.unique(np.stack([a.comp[lo + i], b.comp[j]], 1), axis=0))
        links = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        links = links[links[:, 0] != links[:, 1]]
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return run


class _Rows:
    """A block of rows: entries (row, columns) in row order, sizes and components of the rows."""

    def __init__(self, table: pa.Table):
        lists = table.column("columns").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
        self.n = table.num_rows
        self.comp = table.column("comp").to_numpy()
        self.columns = lists.flatten().to_numpy() if self.n else np.empty(0, np.int64)
        self.sizes = lists.value_lengths().to_numpy().astype(np.int64) if self.n else np.empty(0, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.row = np.repeat(np.arange(self.n), self.sizes)

    def stretches(self, cells: int) -> Iterator[tuple[int, int]]:
        """Rows in stretches of about ``cells`` entries, at least one row each."""
        lo = 0
        while lo < self.n:
            hi = int(np.searchsorted(self.starts, self.starts[lo] + cells, side="right")) - 1
            hi = min(max(hi, lo + 1), self.n, lo + 256)
            yield lo, hi
            lo = hi


def _cuts(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Entries in stretches of at most about ``most`` products."""
    sums, lo = np.concatenate(([0], np.cumsum(count))), 0
    while lo < len(count):
        hi = min(max(int(np.searchsorted(sums, sums[lo] + most, side="right")) - 1, lo + 1), len(count))
        yield lo, hi
        lo = hi


def _digest(values: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _rows(k: int):
    """A row for each text, and after the last one the slots of all columns as counts, a slice each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "d1", "d2", "bits", "more", "slice", "counts"]
        slots = np.zeros(SLOTS, np.int64)
        for batch in batches:
            sizes, marks, bits, more, at, held = [], [], [], [], [np.empty(0, np.int64)], 0
            for values in shingle_sets(batch.column(1), k):
                sizes.append(len(values))
                marks.append(_digest(values) if len(values) else (None, None))
                bits.append(_parities(values, BITS))
                more.append(_parities(values, 1 << (2 * len(values) - 1).bit_length()) if 2 * len(values) > BITS else None)
                at.append(_slot(values))
                held += len(values)
                if held > 1 << 20:
                    slots += np.bincount(np.concatenate(at), minlength=SLOTS)
                    at, held = [np.empty(0, np.int64)], 0
            slots += np.bincount(np.concatenate(at), minlength=SLOTS)
            cells = [batch.column(0), pa.array(sizes, pa.int32()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cells, pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], names=names)
        full = [i for i in range(SLOTS // SLICE) if slots[i * SLICE : (i + 1) * SLICE].any()]
        none = [pa.nulls(len(full), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
        counts = [slots[i * SLICE : (i + 1) * SLICE].tobytes() for i in full]
        yield pa.RecordBatch.from_arrays([*none, pa.array(full, pa.int32()), pa.array(counts, pa.binary())], names=names)

    return run


def _slot(values: np.ndarray) -> np.ndarray:
    # Not the high bits, by which columns are ordered.
    return (values & np.uint64(SLOTS - 1)).astype(np.int64)


def _parities(values: np.ndarray, places: int) -> np.ndarray:
    """Whether an odd number of columns falls in each of so many places, packed."""
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) & (places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the counts of each slice; slices come sorted."""

    def row(at: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([at], pa.int32())], names=["slice", "counts", "salt"])

    at, sums = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            counts = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
            if batch.column(0)[i].as_py() == at:
                sums += counts
                continue
            if at is not None:
                yield row(at, sums)
            at, sums = batch.column(0)[i].as_py(), counts.copy()
    if at is not None:
        yield row(at, sums)


def _postings(k: int, percent: int, crowding: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for values in shingle_sets(batch.column(1), k):
                n = len(values)
                if not n:
                    continue
                first = n - -(-n * percent // 100) + 1
                crowd = crowding[_slot(values)]
                taken = np.argsort(crowd, kind="stable")[:first]
                out.append((values[taken].view(np.int64), crowd[taken], _digest(values)[0], n))
                held += first
                if held > 1 << 17:
                    yield _entries(out)
                    out, held = [], 0
            if out:
                yield _entries(out)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (key, salt, d1) without repeats and without those of a column with one row; columns dealt by row as well stay."""
    names = ["key", "d1", "n", "at"]
    held, alone = None, True  # the last entry so far, and whether it has met none of its column
    for batch in batches:
        cells = {name: batch.column(name).to_numpy() for name in ("key", "salt", "d1", "n", "at")}
        if not batch.num_rows:
            continue
        if held is not None:
            cells = {name: np.concatenate((held[name], c)) for name, c in cells.items()}
        new = np.ones(len(cells["key"]), bool)
        new[1:] = (np.diff(cells["key"]) != 0) | (np.diff(cells["salt"]) != 0) | (np.diff(cells["d1"]) != 0)
        cells = {name: c[new] for name, c in cells.items()}
        like = (np.diff(cells["key"]) == 0) & (np.diff(cells["salt"]) == 0)
        met = np.concatenate(([not alone], like)) | np.concatenate((like, [False])) | (cells["salt"] > 0)
        kept = met[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(cells[c][:-1][kept]) for c in names], names=names)
        held, alone = {name: c[-1:] for name, c in cells.items()}, not met[-1]
    if held is not None and not alone:
        yield pa.RecordBatch.from_arrays([pa.array(held[c]) for c in names], names=names)


def _entries(rows: list[tuple[np.ndarray, np.ndarray, int, int]]) -> pa.RecordBatch:
    lengths = [len(r[0]) for r in rows]
    crowd, d1 = np.concatenate([r[1] for r in rows]), np.repeat(np.array([r[2] for r in rows], np.int64), lengths)
    salt = np.where(crowd > 0, d1 % SALTS + 1, 0).astype(np.int32)
    cells = [np.concatenate([r[0] for r in rows]), salt, d1, np.repeat(np.array([r[3] for r in rows], np.int32), lengths), np.concatenate([np.arange(x, dtype=np.int32) for x in lengths])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["key", "salt", "d1", "n", "at"])


def _whole_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # In small pieces: a set takes about twice the bytes of its text.
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                wanted = zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)
                sets = list(shingle_sets(piece.column(1), k))
                same = [len(s) > 0 and _digest(s) == w for s, w in zip(sets, wanted, strict=True)]
                kept = [s for s, ok in zip(sets, same, strict=True) if ok]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
                values = np.concatenate(kept).view(np.int64) if kept else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(pa.array(same)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["vid", "columns"])
            pa.default_memory_pool().release_unused()

    return run
