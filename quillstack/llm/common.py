"""Shared plumbing of the training-data operators: scratch tables and a distributed ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, delete_path, shared_root  # noqa: F401

#: Words of the mixing and near-duplicate contracts are separated by these ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"

def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> F.Column:
    """Number of maximal runs of characters other than ASCII blanks; null counts as 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, BLANKS), F.lit(""))), F.lit(0)).cast("long")


def ascii_lower(text) -> F.Column:
    """Lower-cases A-Z only; ``lower`` would also fold accented capitals."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def utf8_len(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def ordinals(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds a gapless ordinal from 0 in the given order without a single-partition window.

    Range-partitions by the order, counts each partition, and adds the sum of the counts before it. The driver sees
    one number per partition. ``df`` has to be a scratch table or another input whose rows do not change between runs.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    scratch = Scratch(spark, "ordinals")
    ranged = df.repartitionByRange(shuffle_width(spark), *order).withColumn("_qs_part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "ranged")
    counts = {r["_qs_part"]: r["n"] for r in ranged.groupBy("_qs_part").agg(F.count("*").alias("n")).collect()}
    offset, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, offset))
        offset += counts[part]
    starts = F.broadcast(spark.createDataFrame(offsets, "_qs_part int, _qs_start long"))
    inner = F.row_number().over(Window.partitionBy("_qs_part").orderBy(*order)) - 1
    return ranged.withColumn("_qs_row", inner).join(starts, "_qs_part").withColumn(name, F.col("_qs_row") + F.col("_qs_start")).drop("_qs_part", "_qs_row", "_qs_start")
