"""Sharding over fixed virtual slots, DataFrame functions only.

A record's key is hashed into one of `n_slots` virtual slots for good. Bytes and rows are summed by slot (a few
thousand rows, whatever the corpus), and a small versioned map says which shard holds each slot. Rebalancing never
re-hashes records: it edits the map, moving as few slots as are needed, and stores the edit as a new version.

Defined cases: a null key is hashed by the text instead; a null text has no bytes (size 1); repeated rows stay, each
with a place of its own; texts of any length count whole; an empty table gives no rows and the first map; further
input columns are ignored by `place`, whatever their names, unless listed in `keep`, under which they pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slots stay few enough for the driver (one row each) and many enough that one slot is a small part of a shard.
N_SLOTS = 4096


def slot_of(key, text, n_slots: int = N_SLOTS):
    hashed = F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key.cast("string")))
    return F.pmod(hashed, F.lit(n_slots)).cast("int")


def size_of(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_totals(slotted: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of each slot in use; at most n_slots rows reach the driver."""
    rows = slotted.groupBy("__slot").agg(F.sum("__size").alias("b"), F.count("*").alias("n")).collect()
    return sorted((r["__slot"], r["b"], r["n"]) for r in rows)


def first_map(n_slots: int, n_shards: int) -> list[int]:
    return [s % n_shards for s in range(n_slots)]


def rebalance(slot_map: list[int], weights: dict[int, int], n_shards: int, only_into: int | None = None) -> list[int]:
    """An edited map: slots move from the heaviest to the lightest shard (or into `only_into`) while that narrows the gap.

    When no single move helps, two slots are exchanged. Ties go to the lower slot, so the edit is a function of its
    arguments. Every step lowers the sum of squared loads, so it ends.
    """
    out = list(slot_map)
    held: list[dict[int, int]] = [{} for _ in range(n_shards)]
    for s, shard in enumerate(out):
        if weights.get(s, 0):
            held[shard][s] = weights[s]
    load = [sum(h.values()) for h in held]
    for _ in range(16 * len(out)):
        hi = max(range(n_shards), key=lambda k: (load[k], -k))
        lo = only_into if only_into is not None else min(range(n_shards), key=lambda k: (load[k], k))
        gap = load[hi] - load[lo]
        if hi == lo or gap <= 1:
            break
        moves = [(abs(gap - 2 * w), s, None, w) for s, w in held[hi].items() if w < gap]
        best = min(moves, default=None, key=lambda m: m[:2])
        if only_into is None and (best is None or best[0] > gap // 8):
            light = sorted(held[lo].items(), key=lambda x: (x[1], x[0]))
            j = 0
            for s, w in sorted(held[hi].items(), key=lambda x: (x[1], x[0])):
                while j < len(light) and 2 * (w - light[j][1]) > gap:
                    j += 1
                for t, v in light[max(0, j - 1) : j + 1]:
                    if 0 < w - v < gap and (best is None or abs(gap - 2 * (w - v)) < best[0]):
                        best = (abs(gap - 2 * (w - v)), s, t, w - v)
        if best is None:
            break
        _, s, t, w = best
        held[lo][s] = held[hi].pop(s)
        out[s] = lo
        if t is not None:
            held[hi][t] = held[lo].pop(t)
            out[t] = hi
        load[hi] -= w
        load[lo] += w
    return out


def map_frame(spark: SparkSession, slot_map: list[int], version: int) -> DataFrame:
    """The map as rows (version, slot, shard)."""
    shards = F.split(F.lit(",".join(map(str, slot_map))), ",").cast("array<int>")
    return spark.range(len(slot_map)).select(F.lit(version).alias("version"), F.col("id").cast("int").alias("slot"), F.get(shards, F.col("id").cast("int")).alias("shard"))


def store_map(spark: SparkSession, path: str, slot_map: list[int], version: int) -> None:
    map_frame(spark, slot_map, version).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    """At most n_slots rows."""
    rows = spark.read.parquet(f"{path}/version={version}").select("slot", "shard").collect()
    return [r["shard"] for r in sorted(rows, key=lambda r: r["slot"])]


def place(spark: SparkSession, df: DataFrame, key: str, text: str, n_shards: int, n_slots: int = N_SLOTS, map_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Shard and gapless place of every record, sizes near equal.

    Returns the key, `keep`, size, text_crc32, shard, slot (place in the shard from 0) and virtual_slot. Two passes
    over narrow columns: the first sums bytes by slot; the second numbers rows inside each slot and adds the slot's
    offset in its shard, so no task ever holds a shard.
    """
    t = F.col(text)
    narrow = df.select(*dict.fromkeys([key, *(keep or [])]), size_of(t).alias("__size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("__crc"), slot_of(F.col(key), t, n_slots).alias("__slot"))
    totals = slot_totals(narrow)
    weights = {s: b for s, b, _ in totals}
    base = first_map(n_slots, n_shards)
    edited = rebalance(base, weights, n_shards)
    if map_path:
        store_map(spark, map_path, base, 1)
        store_map(spark, map_path, edited, 2)
        edited = load_map(spark, map_path, 2)
    offsets, filled = [0] * n_slots, [0] * n_shards
    for s, _, n in totals:
        offsets[s] = filled[edited[s]]
        filled[edited[s]] += n
    pick = lambda xs, kind: F.get(F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>"), F.col("__slot"))
    within = F.row_number().over(Window.partitionBy("__slot").orderBy(key, "__crc", "__size")).cast("long")
    return narrow.select(
        *dict.fromkeys([key, *(keep or [])]), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), pick(edited, "int").alias("shard"), (pick(offsets, "bigint") + within - 1).alias("slot"), F.col("__slot").alias("virtual_slot")
    )
