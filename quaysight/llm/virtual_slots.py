"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; bytes are summed per slot, and a
versioned map says which shard holds which slot.  Rebalancing edits the map
(a new version that moves single slots), never the hash, so most records stay
where they are.  The map can be kept at a named place, for the next run to edit.  Only the slot table, of fixed size, ever reaches the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaysight.llm.common import stored

SLOTS = 4096
SHARDS = 16
# The fullest and the emptiest shard may differ by this share of the mean.
TOLERANCE = 0.001
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long"


def first_map(slot_bytes: Sequence[int], shards: int) -> list[int]:
    """Version 1: slots dealt out in turn, whatever they hold."""
    return [slot % shards for slot in range(len(slot_bytes))]


def rebalanced(slot_bytes: Sequence[int], current: Sequence[int], shards: int,
               tolerance: float = TOLERANCE) -> list[int]:
    """The next version: slots move, one at a time, from the fullest shard to
    the emptiest while that narrows the gap between the two; if single moves
    no longer help, two slots are exchanged.  Shards that the current map
    doesn't know start empty."""
    shard_of = list(current)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        load[shard] += slot_bytes[slot]
        held[shard].append((slot_bytes[slot], slot))
    mean = sum(slot_bytes) / shards
    for _ in range(4 * len(shard_of)):
        full = max(range(shards), key=lambda s: (load[s], -s))
        low = min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[low]
        if gap <= max(1, tolerance * mean):
            break
        # the move or exchange that comes nearest to half the gap
        give = min((b for b in held[full] if 0 < b[0] < gap), key=lambda b: (abs(gap - 2 * b[0]), b), default=None)
        best = (abs(gap - 2 * give[0]), give, None) if give else (gap, None, None)
        if best[0] > tolerance * mean:
            back = sorted(held[low])
            sizes = [b[0] for b in back]
            for out in held[full]:
                at = _nearest(sizes, out[0] - gap / 2)
                if at is not None and 0 < out[0] - sizes[at] < gap:
                    best = min(best, (abs(gap - 2 * (out[0] - sizes[at])), out, back[at]), key=lambda x: x[0])
        if best[1] is None:
            break
        _, out, back = best
        for b, a, z in ((out, full, low), (back, low, full)):
            if b:
                held[a].remove(b)
                held[z].append(b)
                load[a] -= b[0]
                load[z] += b[0]
                shard_of[b[1]] = z
    return shard_of


def _nearest(sizes: Sequence[int], wanted: float) -> int | None:
    from bisect import bisect_left

    if not sizes:
        return None
    at = bisect_left(sizes, wanted)
    return min((i for i in (at - 1, at) if 0 <= i < len(sizes)), key=lambda i: abs(sizes[i] - wanted))


def packed(slot_bytes: Sequence[int], shards: int) -> list[int]:
    """A map made from nothing: largest slot first, to the emptiest shard."""
    out = [0] * len(slot_bytes)
    heap = [(0, s) for s in range(shards)]
    for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + slot_bytes[slot], shard))
    return out


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, whole: bool = False) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)`` per row: size is the
    UTF-8 bytes of the text (null: none) plus 1; the slot hashes id and text,
    so repeated ids or null ids with different texts do not share one.  With
    ``whole`` a struct ``record`` holds all columns of the row."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(slots)).cast("int").alias("virtual_slot"),
        *([F.struct(*docs.columns).alias("record")] if whole else []))


def slot_loads(records: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every slot; at most ``slots`` rows reach the driver."""
    found = {r[0]: r[1] for r in records.groupBy("virtual_slot").agg(F.sum("size")).collect()}
    return [int(found.get(slot, 0)) for slot in range(slots)]


def map_table(spark: SparkSession, versions: Sequence[Sequence[int]], slot_bytes: Sequence[int], first: int = 1) -> DataFrame:
    """Versions of the slot-to-shard map, numbered from ``first``, as a table of
    one row per version and slot."""
    return spark.createDataFrame(
        [(v, slot, shard, slot_bytes[slot]) for v, shards in enumerate(versions, first) for slot, shard in enumerate(shards)],
        MAP_SCHEMA)


def newest_map(spark: SparkSession, path: str, slots: int = SLOTS) -> tuple[int, list[int]] | None:
    """Number and shards by slot of the newest version stored at ``path``; None
    if there is none.  ``slots`` rows reach the driver."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    stored_map = spark.read.schema(MAP_SCHEMA).parquet(path)
    newest = stored_map.agg(F.max("version")).first()[0]
    if newest is None:
        return None
    shard_of = {r.virtual_slot: r.shard for r in stored_map.where(F.col("version") == newest).collect()}
    if sorted(shard_of) != list(range(slots)):
        raise ValueError(f"the map at {path} has {len(shard_of)} slots, not {slots}")
    return newest, [shard_of[slot] for slot in range(slots)]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          slots: int = SLOTS, map_path: str | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, map): every row's shard under the newest version of the map,
    and the stored map.  Records: ``doc_id, size, text_crc32, virtual_slot,
    shard, slot, map_version``, with ``whole`` also ``record``, the row with
    all its columns; ``slot`` numbers the rows of a shard from 0 without gaps.

    Without ``map_path`` a map is made from nothing: version 1 deals the slots
    out in turn, version 2 evens the bytes.  With it the newest map stored
    there is read and edited - slots move only as far as new rows or more
    shards ask for it - and the edit is stored as the next version, if it
    moves a slot; the first run stores versions 1 and 2.

    Null texts have size 1, null ids hash like any value, repeated rows each
    take a place, an empty table gives no records and an even map; very long
    texts travel whole, once; columns may have any names.
    """
    spark = docs.sparkSession
    records = stored(slotted(docs, id_col, text_col, slots, whole), "slotted")
    loads = slot_loads(records, slots)
    known = newest_map(spark, map_path, slots) if map_path else None
    if known is None:
        start = first_map(loads, shards)
        number, versions, moved = 1, [start, rebalanced(loads, start, shards)], True
    else:
        if max(known[1]) >= shards:
            raise ValueError(f"the map at {map_path} knows {max(known[1]) + 1} shards, more than {shards}")
        after = rebalanced(loads, known[1], shards)
        moved = after != known[1]
        number, versions = known[0] + moved, [after]
    made = map_table(spark, versions, loads, number)
    if map_path and moved:
        made.write.mode("append").parquet(map_path)
    slot_map = spark.read.schema(MAP_SCHEMA).parquet(map_path) if map_path else stored(made, "slot-map")
    number += len(versions) - 1
    newest = slot_map.where(F.col("version") == number).select("virtual_slot", "shard", F.col("version").alias("map_version"))
    # places: offset of the slot within its shard, then the row within its slot
    counts = records.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(F.broadcast(newest), "virtual_slot")
    offsets = counts.withColumn("offset", F.sum("n").over(
        Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)))
    placed = stored(offsets.select("virtual_slot", "shard", "map_version", F.coalesce("offset", F.lit(0)).alias("offset")), "slot-offsets")
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    out = records.withColumn("within", within).join(F.broadcast(placed), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard",
        (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"), "map_version", *(["record"] if whole else []))
    return out, slot_map
