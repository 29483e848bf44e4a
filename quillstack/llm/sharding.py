"""Sharding by fixed virtual slots.

Records are hashed into ``n_slots`` virtual slots, a number that never changes. Bytes are summed per slot, and a versioned
slot-to-shard map says where each slot lives. A rebalance edits that map, moving or swapping as few slots as it needs to
bring the bytes of the shards together, and writes the edited map as the next version; records are never hashed anew.

Scale: one pass over the text for its size, then only (doc_id, size, checksum, slot) moves. The map and the sums per slot
have ``n_slots`` rows whatever the input, so the driver may hold and broadcast them. A record's position in its shard is the
start of its slot there plus its position in the slot, so no task orders more than one slot.

Equal texts are spread like others: a group of copies that holds a third of all bytes cannot live in one of 24 equal shards, and the
law kept here is that the shards' bytes are near equal.

Defined cases: a null text has 0 bytes and checksum null, an empty one 0 bytes; a null doc_id is spread by its text;
repeated rows go to the same slot at different positions; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, utf8_len

N_SLOTS = 8192
OVERHEAD = 8


def slot_of(n_slots: int = N_SLOTS) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int")


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Version 0: slots in turn."""
    return [slot % n_shards for slot in range(n_slots)]


def rebalance(slot_to_shard: list[int], slot_bytes: list[int], n_shards: int, close: float = 0.0005) -> list[int]:
    """The edited map. Moves a slot from the heaviest shard to the lightest, or swaps two, while that narrows their gap.

    Stops when the gap is below ``close`` of a mean shard or no edit narrows it. Works on ``n_slots`` numbers, a fixed count.
    """
    shard_of, load = list(slot_to_shard), [0] * n_shards
    held: list[set[int]] = [set() for _ in range(n_shards)]
    for slot, shard in enumerate(shard_of):
        load[shard] += slot_bytes[slot]
        if slot_bytes[slot]:
            held[shard].add(slot)
    mean = sum(load) / n_shards
    for _ in range(20 * len(shard_of)):
        heavy, light = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[heavy] - load[light]
        if gap <= close * mean:
            break
        best, edit = gap, None
        for slot in held[heavy]:
            left = abs(gap - 2 * slot_bytes[slot])
            if left < best:
                best, edit = left, (slot, None)
        if edit is None or best > close * mean:
            # A swap changes the gap by twice the difference of two slots.
            ours, theirs = sorted(held[heavy], key=slot_bytes.__getitem__), sorted(held[light], key=slot_bytes.__getitem__)
            at = 0
            for slot in ours:
                while at + 1 < len(theirs) and abs(gap - 2 * (slot_bytes[slot] - slot_bytes[theirs[at + 1]])) <= abs(gap - 2 * (slot_bytes[slot] - slot_bytes[theirs[at]])):
                    at += 1
                if theirs and (left := abs(gap - 2 * (slot_bytes[slot] - slot_bytes[theirs[at]]))) < best:
                    best, edit = left, (slot, theirs[at])
        if edit is None:
            break
        for slot, source, goal in ((edit[0], heavy, light), (edit[1], light, heavy)):
            if slot is not None:
                shard_of[slot] = goal
                held[source].discard(slot)
                held[goal].add(slot)
                load[source] -= slot_bytes[slot]
                load[goal] += slot_bytes[slot]
    return shard_of


def grow(slot_to_shard: list[int], slot_bytes: list[int], n_shards: int) -> list[int]:
    """The map for one more shard: slots move only into it, from the heaviest shards, until it has its share of bytes."""
    shard_of, load = list(slot_to_shard), [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shard_of):
        load[shard] += slot_bytes[slot]
        held[shard].append(slot)
    for slots in held:
        slots.sort(key=slot_bytes.__getitem__)
    share, got = sum(load) / (n_shards + 1), 0
    heaviest = [(-total, shard) for shard, total in enumerate(load)]
    heapq.heapify(heaviest)
    while got < share and heaviest:
        _, shard = heapq.heappop(heaviest)
        if not held[shard]:
            continue
        slot = held[shard].pop()
        if got + slot_bytes[slot] > share * 1.0005 and slot_bytes[slot] > 0:
            heapq.heappush(heaviest, (-load[shard], shard)) if held[shard] else None
            continue
        shard_of[slot], got, load[shard] = n_shards, got + slot_bytes[slot], load[shard] - slot_bytes[slot]
        heapq.heappush(heaviest, (-load[shard], shard))
    return shard_of


def map_frame(spark, slot_to_shard: list[int], version: int) -> DataFrame:
    rows = [(version, slot, shard) for slot, shard in enumerate(slot_to_shard)]
    return spark.createDataFrame(rows, "version int, vslot int, shard int")


def shard_documents(documents: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, maps_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot (position in the shard, gapless from 0), map_version.

    ``maps_path``: where the versioned map is kept, one row for each version and virtual slot; a new run with the same path
    edits its latest version. Without it the map starts at version 0 in a scratch folder.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "sharding")
    sized = documents.select("doc_id", (utf8_len(F.col("text")) + OVERHEAD).alias("size"), F.crc32("text").alias("text_crc32"))
    sized = scratch.keep(sized.withColumn("vslot", slot_of(n_slots)), "sized")
    sums = sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    slot_bytes, slot_rows = [0] * n_slots, [0] * n_slots
    for row in sums:
        slot_bytes[row["vslot"]], slot_rows[row["vslot"]] = row["bytes"], row["n"]

    maps_path = maps_path or scratch.path("slot-maps")
    version, current = latest_map(spark, maps_path, n_slots)
    if current is None:
        version, current = 0, first_map(n_shards, n_slots)
        map_frame(spark, current, version).coalesce(1).write.mode("append").parquet(maps_path)
    edited = rebalance(current, slot_bytes, n_shards)
    if edited != current:
        version += 1
        map_frame(spark, edited, version).coalesce(1).write.mode("append").parquet(maps_path)

    starts, filled = [], [0] * n_shards
    for slot, shard in enumerate(edited):
        starts.append((slot, shard, filled[shard]))
        filled[shard] += slot_rows[slot]
    placed = F.broadcast(spark.createDataFrame(starts, "vslot int, shard int, _qs_start long"))
    inner = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return sized.withColumn("_qs_at", inner).join(placed, "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("_qs_start") + F.col("_qs_at")).alias("slot"), F.lit(version).alias("map_version"))


def latest_map(spark, maps_path: str, n_slots: int) -> tuple[int, list[int] | None]:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(maps_path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return -1, None
    maps = spark.read.parquet(maps_path)
    version = maps.agg(F.max("version")).first()[0]
    rows = maps.where(F.col("version") == version).collect()
    if len(rows) != n_slots:
        raise ValueError(f"the map in {maps_path} has {len(rows)} slots, not {n_slots}: virtual slots are fixed")
    current = [0] * n_slots
    for row in rows:
        current[row["vslot"]] = row["shard"]
    return version, current
