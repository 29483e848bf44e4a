"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size in words. All words of the corpus are shared out by weight; a source that would be
repeated more than ``max_epochs`` times is clamped there and what it cannot take is shared again among the others, until
no source is above its clamp. A document is then taken ``floor(target / size of its source)`` whole times, and a seeded
choice of the source's documents once more, so that the source's words come to its target within its smallest document.

Scale: the corpus is read once for the sizes. The water level is found from aggregates per source, a few scalars a round.
A source may hold any share of the rows: its documents are spread over hash bins, only aggregates of bins meet, and just
the one bin in which the target falls is looked at document by document (about ``bin_docs`` rows).

Defined cases: null or blank texts have size 0, so 0 of their words are taken; a null source is a source of its own, ordered
last; repeated rows share a draw but are counted and taken one by one; an empty table gives an empty mix; other columns are
carried along untouched by ``mix`` and ignored by ``mix_plan``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ordinals, word_count

DEFAULT_WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, scratch: Scratch, weights=DEFAULT_WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, n_docs, weight, target) from rows (source, size). The driver holds scalars only."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per_source = ordinals(scratch.keep(per_source, "sources"), [F.col("source").asc_nulls_last()], "_qs_ord")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_qs_ord") % len(weights) + 1).cast("int"))
    per_source = scratch.keep(per_source.select("source", "source_size", "n_docs", weight.cast("long").alias("weight"), F.lit(False).alias("clamped")), "weighted")
    total = per_source.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    cap = F.col("source_size") * F.lit(max_epochs)
    while True:
        state = per_source.agg(
            F.sum(F.when(F.col("clamped"), cap).otherwise(0)).alias("fixed"),
            F.sum(F.when(~F.col("clamped"), F.col("weight")).otherwise(0)).alias("free"),
        ).first()
        rest, free = total - (state["fixed"] or 0), state["free"] or 0
        share = (F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(free))) if free else F.lit(0.0)
        if not free or not per_source.where(~F.col("clamped") & (share > cap)).limit(1).count():
            break
        per_source = scratch.keep(per_source.withColumn("clamped", F.col("clamped") | (share > cap)), "clamped")
    target = F.when(F.col("clamped"), cap.cast("double")).otherwise(share)
    return scratch.keep(per_source.select("source", "source_size", "n_docs", "weight", target.alias("target")), "targets")


def mix_plan(documents: DataFrame, weights=DEFAULT_WEIGHTS, max_epochs: int = 3, seed: int = 17, bin_docs: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, plus the columns of ``carry`` (as ``_qs_<name>``)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    extra = [F.col(c).alias(f"_qs_{c}") for c in carry]
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.crc32("text")).alias("draw"), *extra)
    narrow = scratch.keep(sized.select("doc_id", "source", "size", "draw"), "sized")
    rows = sized if carry else narrow
    targets = source_targets(narrow.select("source", "size"), scratch, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("remainder", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = targets.withColumn("bins", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(bin_docs))).cast("long"))

    # Hash bins of about bin_docs documents; the sums of all bins before one give where the target falls.
    targets = targets.withColumnRenamed("source", "t_source").drop("n_docs", "weight")

    def deal(df: DataFrame) -> DataFrame:
        return df.join(targets, df["source"].eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("bin", F.pmod(F.col("draw"), F.col("bins")))

    per_bin = scratch.keep(deal(narrow).groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("remainder").alias("remainder")), "bins")
    ranked = ordinals(per_bin, [F.col("source").asc_nulls_last(), F.col("bin")], "ord")
    edges = scratch.keep(_crossing_bins(ranked, scratch), "edges")
    dealt = deal(rows).join(edges.select(F.col("source").alias("e_source"), "edge_bin", "edge_words"), F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    kept = ["doc_id", "source", "size", "draw", "source_size", "target", "whole", *[f"_qs_{c}" for c in carry]]
    plain = dealt.where((F.col("edge_bin").isNull()) | (F.col("bin") != F.col("edge_bin"))).select(*kept, F.when(F.coalesce(F.col("bin") < F.col("edge_bin"), F.lit(False)), 1).otherwise(0).cast("long").alias("extra"))
    at_edge = dealt.where(F.col("bin") == F.col("edge_bin")).select(*kept, "edge_words")
    schema = T.StructType([*at_edge.drop("edge_words").schema.fields, T.StructField("extra", T.LongType())])

    def fill(group: pa.Table) -> pa.Table:
        """In seeded order, each document that still fits in what the source lacks."""
        group = group.sort_by([("draw", "ascending"), ("size", "ascending")])
        sizes, left, chosen = group["size"].to_pylist(), group["edge_words"][0].as_py(), []
        for size in sizes:
            fits = 0 < size <= left
            left -= size if fits else 0
            chosen.append(int(fits))
        # Then one more, the smallest left, if the words come nearer to the target with it than without it.
        spare = [(size, i) for i, size in enumerate(sizes) if size > 0 and not chosen[i]]
        if spare and min(spare)[0] < 2 * left:
            chosen[min(spare)[1]] = 1
        return group.drop_columns("edge_words").append_column("extra", pa.array(chosen, pa.int64()))

    resolved = at_edge.groupBy("source").applyInArrow(fill, schema)
    taken = (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken")
    out = plain.unionByName(resolved)
    return out.select("doc_id", "size", "source_size", "target", taken, (F.col("whole") + F.col("extra")).alias("copies"), "source", *[f"_qs_{c}" for c in carry])


def _crossing_bins(ranked: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, edge_bin, edge_words): the bin in which the remainder of each source's target falls, and the words wanted there."""
    from pyspark.sql import Window

    # Two levels: blocks of bins, then bins of one block, so that a source with very many bins is never one window.
    block = F.floor(F.col("ord") / 1024)
    ranked = ranked.withColumn("block", block)
    blocks = ranked.groupBy("source", "block").agg(F.sum("bin_size").alias("block_size"))
    before = F.sum("block_size").over(Window.partitionBy("source").orderBy("block")) - F.col("block_size")
    blocks = blocks.withColumn("block_before", before)
    joined = ranked.join(blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "block_before"), (F.col("block") == F.col("b_block")) & F.col("source").eqNullSafe(F.col("b_source")))
    inner = F.sum("bin_size").over(Window.partitionBy("source", "block").orderBy("bin")) - F.col("bin_size")
    placed = joined.withColumn("before", F.col("block_before") + inner)
    # A remainder of exactly nothing has no crossing bin before its first one: then bin 0 is the edge with 0 words wanted.
    lacks = F.col("remainder") - F.col("before")
    crossing = placed.where((F.col("before") <= F.col("remainder")) & (F.col("remainder") < F.col("before") + F.col("bin_size")))
    full = placed.groupBy("source").agg(F.max("bin").alias("last"), F.first("remainder").alias("remainder"), F.sum("bin_size").alias("sum"))
    rounding = full.where(F.col("remainder") >= F.col("sum")).select("source", (F.col("last") + 1).alias("edge_bin"), F.lit(0.0).alias("edge_words"))
    return crossing.select("source", F.col("bin").alias("edge_bin"), lacks.alias("edge_words")).unionByName(rounding)


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``documents``, each document as often as the plan takes it."""
    columns = documents.columns
    plan = mix_plan(documents, carry=tuple(columns), **options)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return plan.where(F.col("copies") > 0).withColumn("_qs_copy", copies).select(*[F.col(f"_qs_{c}").alias(c) for c in columns])
