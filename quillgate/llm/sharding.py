"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has SLOTS equal key ranges; a hash of doc_id, size, text and, of rows equal in all these, their number decides a row's slot, so that neither one doc_id
nor one text of very many rows is a hot slot. Each shard stands at `vnodes` places of the ring. Slots,
heaviest first, go to the first virtual node clockwise whose shard still has room for them, so keys that meet a full shard
continue clockwise: no shard holds more than (1 + slack) of its share while a slot fits anywhere. Only per-slot totals (SLOTS
numbers, whatever the input) reach the driver, which walks the ring and hands the slots' shards back as an SQL literal.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, stored

SLOTS = 16384
COPIES = 4096
_MASK = (1 << 64) - 1


def _place(*parts: int) -> int:
    """A ring position from small integers: a 64-bit finaliser over their mix."""
    x = 0x243F6A8885A308D3
    for p in parts:
        x = ((x ^ p) * 0x9E3779B97F4A7C15) & _MASK
        x ^= x >> 29
        x = (x * 0xBF58476D1CE4E5B9) & _MASK
        x ^= x >> 32
    return x


def walk(loads: dict[int, int], shards: int, vnodes: int = 128, slack: float = 0.0005) -> dict[int, int]:
    """slot -> shard. A slot that fits nowhere goes to the least loaded shard (the first clockwise among equals)."""
    nodes = sorted((_place(1, s, v), s) for s in range(shards) for v in range(vnodes))
    places = [p for p, _ in nodes]
    room = [sum(loads.values()) * (1 + slack) / shards] * shards
    out = {}
    for slot in sorted(loads, key=lambda s: (-loads[s], s)):
        at = bisect.bisect_left(places, _place(2, slot))
        order = list(dict.fromkeys(nodes[(at + k) % len(nodes)][1] for k in range(min(len(nodes), 4 * shards))))
        if not any(room[s] >= loads[slot] for s in order):
            order = list(dict.fromkeys(nodes[(at + k) % len(nodes)][1] for k in range(len(nodes))))
        shard = next((s for s in order if room[s] >= loads[slot]), None)
        if shard is None:
            shard = max(order, key=lambda s: room[s])
        room[shard] -= loads[slot]
        out[slot] = shard
    return out


def _literal(values: list[int]):
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def shard_rows(docs: DataFrame, shards: int = 8, vnodes: int = 128, slack: float = 0.0005) -> DataFrame:
    """(doc_id, size, text_crc32, law, ring_slot, shard, slot) per row of docs(doc_id, text, ...).

    size is the text's UTF-8 bytes (null: none) plus 1; the law is `bytes`: sizes near equal. slot counts a shard's
    rows from 0 without gaps, by ring slot, then doc_id (nulls first), size and text_crc32. Groups of equal texts, and rows of one doc_id or of none, are spread
    like other rows, as they may be more than a shard holds. Rows equal in doc_id, size and text_crc32 stay as many as they are. An empty table gives
    an empty result. Other columns are ignored.

    Equal rows cross the first shuffle as one with their number, are stored so, and come apart again in lots of COPIES.
    """
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    rows = stored(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "rows")
    lots = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES)), lambda k: k * COPIES)
    many = rows.where("n > 1").withColumn("lot", F.explode(lots)).repartition("doc_id", "size", "text_crc32", "lot")
    copies = F.sequence(F.col("lot"), F.least(F.col("lot") + COPIES, F.col("n")) - 1)
    rows = rows.where("n = 1").select("doc_id", "size", "text_crc32", F.lit(0).cast("bigint").alias("copy")).unionByName(many.select("doc_id", "size", "text_crc32", F.explode(copies).alias("copy")))
    rows = rows.withColumn("ring_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "copy"), F.lit(SLOTS)))
    totals = rows.groupBy("ring_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # at most SLOTS rows
    chosen = walk({r["ring_slot"]: r["size"] for r in totals}, shards, vnodes, slack)
    shard, base, used = [0] * SLOTS, [0] * SLOTS, [0] * shards
    for r in sorted(totals, key=lambda r: r["ring_slot"]):
        s = chosen[r["ring_slot"]]
        shard[r["ring_slot"]], base[r["ring_slot"]] = s, used[s]
        used[s] += r["n"]
    here = (F.col("ring_slot") + 1).cast("int")
    order = Window.partitionBy("ring_slot").orderBy("doc_id", "size", "text_crc32", "copy")
    return rows.withColumn("rank", F.row_number().over(order)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "ring_slot",
        F.element_at(_literal(shard), here).cast("int").alias("shard"),
        (F.element_at(_literal(base), here) + F.col("rank") - 1).alias("slot"),
    )
