"""Prefix trie over conversations, built level by level.

Every conversation is rebuilt with the opening turns it shares (``rebuild``): the first h turns of conversation c - c % 20, then its own
turns after its first h, h = crc32(c) % 4. Per depth the live conversations are grouped by (parent node, next turn); a node is
named by its depth and its smallest conversation. Joins from the deepest level upwards then sum leaves and saved tokens.

Scale and skew. Equal conversations are one class with a weight before the first level, so thousands of copies move as one row. A
class that is alone in its node leaves the loop: below that node lies one path, whose nodes follow from its turns without
further levels, so there are as many levels as different conversations share turns. Positions and running sums of words come from
range partitions (a count and a sum for each are all that the driver sees), so one very long conversation is spread over tasks; a
shared first turn is grouped with partial minima and joined back in an equi-join that Spark splits. The ids that end in a node are
joined in pieces of a batch, sorted, and hashed in a stream: a task holds a piece, never a list. Levels are tables in the shared folder.

Defined cases: null role or text is empty; a null turn comes first, ties in turn are ordered by role and text (code points), repeated rows
are turns of their own; rows without conv_id are no conversation; a conversation without turns is a member of the root; an empty
table gives no rows; texts count whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width, word_count

#: Conversations of a block of so many share openings of their first one, of fewer than so many turns.
BLOCK, OPENINGS = 20, 4
EMPTY = hashlib.sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    whole, turns = rebuild(conversations, scratch)
    members, classes = _classes(whole, turns, scratch)
    # Sorted by position: a level reads the row groups of its depth only.
    own = turns.join(classes.select("cls"), F.col("conv_id") == F.col("cls"), "left_semi").withColumnRenamed("conv_id", "cls")
    own = scratch.keep(own.repartitionByRange(shuffle_width(spark), "pos", "cls").sortWithinPartitions("pos"), "class_turns")
    scratch.drop(whole, turns)

    root = classes.agg(F.min("cls").alias("conv_id"), F.count("*").alias("classes"), F.sum("weight").alias("n_convs"), F.max(F.when(F.col("length") == 0, F.col("cls"))).alias("end_cls"))
    root = root.where("classes > 0").select("conv_id", F.lit(None).cast("long").alias("parent"), F.lit(2).cast("long").alias("classes"), "n_convs", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("rest"), F.lit(0).cast("long").alias("length"), "end_cls")
    levels = [scratch.keep(root, "level")]
    live = classes.where("length > 0").crossJoin(F.broadcast(levels[0].select(F.col("conv_id").alias("parent"))))  # one row
    live = scratch.keep(live, "live")
    while live.limit(1).count():
        depth = len(levels)
        step = live.join(own.where(F.col("pos") == depth).withColumnRenamed("cls", "t_cls"), F.col("cls") == F.col("t_cls")).drop("t_cls", "pos")
        node = step.groupBy("parent", "key").agg(
            F.min("cls").alias("conv_id"),
            F.count("*").alias("classes"),
            F.sum("weight").alias("n_convs"),
            F.min("words").alias("words"),
            F.min("rest").alias("rest"),
            F.max("length").alias("length"),
            F.max(F.when(F.col("length") == depth, F.col("cls"))).alias("end_cls"),
        )
        node = scratch.keep(node, "level")
        levels.append(node.drop("key"))
        shared = node.where("classes > 1").select(F.col("parent").alias("n_parent"), F.col("key").alias("n_key"), "conv_id")
        ahead = step.where(F.col("length") > depth).join(shared, (F.col("parent") == F.col("n_parent")) & (F.col("key") == F.col("n_key")))
        last, live = live, scratch.keep(ahead.select("cls", "length", "weight", F.col("conv_id").alias("parent")), "live")
        scratch.drop(last)

    nodes = _rolled(levels, scratch)
    nodes = nodes.unionByName(_paths(levels, own))
    out = nodes.join(_digests(members).withColumnRenamed("cls", "d_cls"), F.col("end_cls") == F.col("d_cls"), "left")
    out = out.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"))
    return out


def rebuild(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation, and its turns (conv_id, pos, key, words, rest); rest: words from this turn to the end."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    ranged = rows.repartitionByRange(shuffle_width(spark), *order).withColumn("part", F.spark_partition_id())
    place = Window.partitionBy("part").orderBy(*order)
    numbered = ranged.withColumn("words", word_count("text")).withColumn("row", F.row_number().over(place))
    numbered = numbered.withColumn("upto", F.sum("words").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = scratch.keep(numbered.select("conv_id", key.alias("key"), "words", "part", "row", "upto"), "numbered")
    starts, rows_before, words_before = [], 0, 0
    for r in sorted(numbered.groupBy("part").agg(F.max("row").alias("n"), F.sum("words").alias("w")).collect()):  # a row for each range
        starts.append((r["part"], rows_before, words_before))
        rows_before, words_before = rows_before + r["n"], words_before + r["w"]
    starts = F.broadcast(spark.createDataFrame(starts, "s_part int, s_row long, s_words long"))
    placed = numbered.join(starts, F.col("part") == F.col("s_part")).select("conv_id", "key", "words", (F.col("row") + F.col("s_row")).alias("row"), (F.col("upto") + F.col("s_words")).alias("upto"))
    ends = scratch.keep(placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("row").alias("first"), F.count("*").alias("n"), F.max("upto").alias("end")), "ends")
    original = placed.join(ends, F.col("conv_id") == F.col("c")).select("conv_id", "key", "words", (F.col("row") - F.col("first") + 1).alias("pos"), (F.col("end") - F.col("upto") + F.col("words")).alias("rest"))
    original = scratch.keep(original, "original")

    c = F.col("c")
    plan = ends.select("c", "n", (c - c % BLOCK).alias("base"), (F.crc32(c.cast("string")) % OPENINGS).alias("h"))
    plan = plan.join(ends.select(F.col("c").alias("b"), F.col("n").alias("b_n")), F.col("base") == F.col("b"), "left")
    plan = plan.select("c", "base", "h", F.least("h", F.coalesce("b_n", F.lit(0))).alias("p"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("after"))
    plan = scratch.keep(plan, "plan")
    kept = original.join(plan, F.col("conv_id") == F.col("c")).where(F.col("pos") > F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("p")).alias("pos"), "key", "words", "rest")
    # Openings have at most three turns; the words after them are the rest of the first turn that the conversation keeps of its own.
    tail = original.join(plan.select("c", "h"), F.col("conv_id") == F.col("c")).where(F.col("pos") == F.col("h") + 1).select(F.col("c").alias("t_c"), F.col("rest").alias("tail"))
    opening = original.where(F.col("pos") < OPENINGS).select(F.col("conv_id").alias("b"), "key", "words", "pos")
    opening = opening.join(plan, F.col("b") == F.col("base")).where(F.col("pos") <= F.col("h")).select("c", "pos", "key", "words")
    on = Window.partitionBy("c").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    opening = opening.withColumn("rest", F.sum("words").over(on)).join(tail, F.col("c") == F.col("t_c"), "left")
    opening = opening.select(F.col("c").alias("conv_id"), "pos", "key", "words", (F.col("rest") + F.coalesce("tail", F.lit(0))).alias("rest"))
    turns = scratch.keep(kept.unionByName(opening), "rebuilt")
    whole = scratch.keep(plan.select(F.col("c").alias("conv_id"), (F.col("p") + F.col("after")).alias("length")), "whole")
    scratch.drop(numbered, original, plan, ends)
    return whole, turns


def _classes(whole: DataFrame, turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(cls, conv_id) and (cls, length, weight): equal conversations, named by the smallest. Turns are combined, not gathered: 128 bits of their hashes with positions."""
    mark = [F.bit_xor(F.xxhash64(F.lit(seed), "pos", "key")).alias(f"x{seed}") for seed in (1, 2)]
    prints = turns.groupBy(F.col("conv_id").alias("c")).agg(*mark)
    marked = whole.join(prints, F.col("conv_id") == F.col("c"), "left").select("conv_id", "length", *[F.coalesce(f"x{s}", F.lit(0)).alias(f"x{s}") for s in (1, 2)])
    marked = scratch.keep(marked, "marked")
    named = scratch.keep(marked.groupBy("length", "x1", "x2").agg(F.min("conv_id").alias("cls"), F.count("*").alias("weight")), "named")
    n = named.select(F.col("length").alias("n_length"), F.col("x1").alias("n1"), F.col("x2").alias("n2"), "cls")
    members = marked.join(n, (F.col("length") == F.col("n_length")) & (F.col("x1") == F.col("n1")) & (F.col("x2") == F.col("n2"))).select("cls", "conv_id")
    return members, named.select("cls", "length", "weight")


def _rolled(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """The nodes of all levels with children, leaves and savings summed from the deepest level upwards."""
    below, out = None, None
    alone = F.col("classes") == 1
    for depth in range(len(levels) - 1, -1, -1):
        node = levels[depth].withColumn("depth", F.lit(depth))
        own = (F.col("n_convs") - 1) * F.when(alone, F.col("rest")).otherwise(F.col("words"))
        if below is None:
            kids = [F.lit(0).cast("long").alias(c) for c in ("k_n", "k_leaves", "k_saved")]
            node = node.select("*", *kids)
        else:
            sums = below.groupBy(F.col("parent").alias("k_parent")).agg(F.count("*").alias("k_n"), F.sum("n_leaves").alias("k_leaves"), F.sum("saved_tokens").alias("k_saved"))
            node = node.join(sums, F.col("conv_id") == F.col("k_parent"), "left")
        path = F.when(alone & (F.col("length") > depth), 1).otherwise(0)
        rolled = node.select(
            "conv_id",
            "depth",
            "parent",
            "n_convs",
            (F.coalesce("k_n", F.lit(0)) + path).alias("n_children"),
            F.greatest(F.coalesce("k_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"),
            (own + F.coalesce("k_saved", F.lit(0))).alias("saved_tokens"),
            F.when(alone & (F.col("length") > depth), None).otherwise(F.col("end_cls")).alias("end_cls"),
        )
        below = scratch.keep(rolled, "rolled")
        out = below if out is None else out.unionByName(below)
    return out


def _paths(levels: list[DataFrame], own: DataFrame) -> DataFrame:
    """The nodes below those that a class has for itself: one for each further turn."""
    alone = None
    for depth, level in enumerate(levels):
        here = level.where((F.col("classes") == 1) & (F.col("length") > depth)).select(F.col("conv_id").alias("a_cls"), F.lit(depth).alias("a_depth"), "length", "n_convs")
        alone = here if alone is None else alone.unionByName(here)
    turns = own.join(alone, (F.col("cls") == F.col("a_cls")) & (F.col("pos") > F.col("a_depth")))
    last = F.col("pos") == F.col("length")
    return turns.select(
        F.col("cls").alias("conv_id"),
        F.col("pos").cast("int").alias("depth"),
        F.col("cls").alias("parent"),
        "n_convs",
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("rest")).alias("saved_tokens"),
        F.when(last, F.col("cls")).alias("end_cls"),
    )


def _digests(members: DataFrame) -> DataFrame:
    """(cls, digest): SHA-256 of the sorted, comma-joined conversations of each class, from pieces of one batch each."""
    spark = members.sparkSession
    ranged = members.repartitionByRange(shuffle_width(spark), "cls", "conv_id").sortWithinPartitions("cls", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "cls long, first long, ids string")
    return pieces.repartition(shuffle_width(spark), "cls").sortWithinPartitions("cls", "first").mapInArrow(_hashed, "cls long, digest string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        cls, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        at = np.flatnonzero(np.diff(cls, prepend=cls[0] - 1))
        texts = [",".join(map(str, run.tolist())) for run in np.split(ids, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(ids[at]), pa.array(texts)], names=["cls", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cls, state = None, None

    def rows(done: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["cls", "digest"])

    for batch in batches:
        done = []
        for c, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if c == cls:
                state.update(b"," + text.encode())
                continue
            if state:
                done.append((cls, state.hexdigest()))
            cls, state = c, hashlib.sha256(text.encode())
        yield rows(done)
    if state:
        yield rows([(cls, state.hexdigest())])
