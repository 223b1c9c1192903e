"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's rows, in a seeded order, form one line of words that is cut into blocks of equal length. Seats go one by one
to the source with the highest quotient target / (2 seats + 1); seat t belongs to output shard t mod shards, so each
(source, shard) has an integer quota. The blocks of a source stand in a seeded order, and the shards, one after the other, take as many
from it as their quota says, going round again where a source gives more than it has. So a block is taken by a list of shards,
and what a document gives is the sum over its blocks: words are counted exactly.

Rows alike in every column are one entry with a count until the end, so copies of one row never meet as rows. Only entries (hashes,
sizes, counts) are sorted; texts are joined to their places by hash, once, without a sort.
"""

from __future__ import annotations

import heapq
import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, release, stored

BLOCKS = 1 << 16
SPACES = "[\\x20\\x09-\\x0D]+"
ORDER_BUCKETS = 1024
COPIES = 4096


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> dict[str | None, float]:
    """Targets by weight (repeating, sources by code point, null last) that share the sum of all sizes; none above limit times
    its size, what is over being shared again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    open_, left = set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in names if s in open_)
        over = [s for s in names if s in open_ and left * weight[s] / total > limit * sizes[s]]
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = float(limit * sizes[s])
            open_.discard(s)
        left -= sum(target[s] for s in over)
    return target


def apportion(targets: dict[str | None, float], most: dict[str | None, int], seats: int, shards: int = 8) -> dict[str | None, list[int]]:
    """Sainte-Lague: seats to sources by highest quotient, at most most[s] each; per source the quota of each shard."""
    names = list(targets)
    quota = {s: [0] * shards for s in names}
    held = dict.fromkeys(names, 0)
    heap = [(-targets[s], i) for i, s in enumerate(names) if targets[s] > 0 and most[s] > 0]
    heapq.heapify(heap)
    for t in range(seats):
        if not heap:
            break
        _, i = heap[0]
        s = names[i]
        held[s] += 1
        quota[s][t % shards] += 1
        if held[s] < most[s]:
            heapq.heapreplace(heap, (-targets[s] / (2 * held[s] + 1), i))
        else:
            heapq.heappop(heap)
    return quota


def block_takers(n: int, quota: list[int], name: str | None, seed: int) -> list[list[int]]:
    """Per block of a source, the shards that take it: shard by shard the next quota[shard] blocks of a seeded order of all n."""
    key = f"{seed}|{'' if name is None else 's' + name}|"
    order = sorted(range(n), key=lambda b: (zlib.crc32(f"{key}{b * 2654435761 % (1 << 32)}".encode()), b))
    takers: list[list[int]] = [[] for _ in range(n)]
    picks = 0
    for shard, q in enumerate(quota):
        for _ in range(q):
            takers[order[picks % n]].append(shard)
            picks += 1
    return takers


def _size(text):
    """How many words a text has."""
    bare = F.regexp_replace(text, f"^{SPACES}|{SPACES}\\z", "")
    return F.when(text.rlike("[^\\x20\\x09-\\x0D]"), F.size(F.split(bare, SPACES))).otherwise(0).cast("bigint")


def _hashed(docs: DataFrame):
    """Two hashes of a whole row, 128 bits; columns that can't be hashed (maps) are left out."""
    from pyspark.sql.types import MapType

    named = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    parts = [*named, *(c.isNull() for c in named)]
    return F.xxhash64(F.lit("line"), *parts), F.xxhash64(F.lit("tie"), *parts)


def _placed(docs: DataFrame, weights: tuple[int, ...], shards: int, seed: int, blocks: int) -> tuple[DataFrame, int, int, list[list[int]]]:
    """((h1, h2, doc_id, size, n, start, source_size, target, offset), most copies of a row, words a block, takers by offset and block): each distinct row of docs with its
    place on its source's line, its n copies one behind the other."""
    spark = docs.sparkSession
    one, two = _hashed(docs)
    rows = docs.select(
        one.alias("h1"), two.alias("h2"), column(docs, "doc_id", "bigint").alias("doc_id"),
        _size(F.coalesce(column(docs, "text", "string"), F.lit(""))).alias("size"),
        F.coalesce(F.concat(F.lit("s"), column(docs, "source", "string")), F.lit("n")).alias("key"),
    )
    entries = rows.groupBy("h1", "h2", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    entries = stored(entries.withColumn("at", F.xxhash64(F.lit(seed), "h1")).withColumn("bucket", F.pmod(F.shiftright("at", 40), F.lit(ORDER_BUCKETS))), "entries")
    sums = stored(entries.groupBy("key", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.max("n").alias("most")), "sums")
    per_source = sums.groupBy("key").agg(F.sum("words").alias("words"), F.max("most").alias("most")).orderBy("key").collect()  # one row a source
    sizes = {None if r["key"] == "n" else r["key"][1:]: r["words"] for r in per_source}
    targets = source_targets(sizes, weights)
    length = max(1, -(-sum(sizes.values()) // blocks))
    count = {s: -(-n // length) for s, n in sizes.items()}
    quota = apportion(targets, {s: 3 * n for s, n in count.items()}, round(sum(targets.values()) / length), shards)
    takers, sources = [], []
    for s, n in sizes.items():
        sources.append(("n" if s is None else "s" + s, n, targets[s], len(takers)))
        takers += block_takers(count[s], quota[s], s, seed)
    known = spark.createDataFrame(sources, "key string, source_size long, target double, offset long")
    known = F.broadcast(known) if len(sources) <= 10_000 else known
    line = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("key", "bucket", F.coalesce(F.sum("words").over(line), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "bucket").orderBy("at", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0))
    placed = entries.withColumn("run", run).join(bases, ["key", "bucket"]).join(known, "key")
    placed = placed.select("h1", "h2", "doc_id", "size", "n", (F.col("base") + F.col("run")).alias("start"), "source_size", "target", "offset")
    return placed, max((r["most"] for r in per_source), default=1), length, takers


def _copies(placed: DataFrame, most: int) -> DataFrame:
    """A row for each of an entry's n copies, `start` moved on; many copies are made by many tasks, COPIES at a time."""
    if most <= 1:
        return placed
    upto = F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1
    parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES))))
    if most > COPIES:
        parts = parts.repartition("h1", "h2", "part")
    return parts.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, upto))).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("part", "copy")


def _pieces(length: int, takers: list[list[int]]):
    """(first word, end word, shards) over the blocks that a row of `size` words from `start` on touches; null for one of no words."""
    by_block = F.from_json(F.lit(json.dumps(takers, separators=(",", ":"))), "array<array<int>>")
    block = lambda p: F.floor(p / length)
    start, end = F.col("start"), F.col("start") + F.col("size")
    pieces = F.transform(F.sequence(block(start), block(end - 1)), lambda b: F.struct(
        (F.greatest(start, b * length) - start).alias("first"), (F.least(end, (b + 1) * length) - start).alias("end"), F.get(by_block, (F.col("offset") + b).cast("int")).alias("shards")
    ))
    return F.when(F.col("size") > 0, pieces)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), shards: int = 8, seed: int = 17, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, pieces) per row of docs(doc_id, text, source, ...).

    size: words of the text (null: 0). taken: words the mix takes, repeats counted. pieces: (first word, end word, shards that take it)
    over the document's blocks, null for a document of no words, which takes nothing. A null source is a source of its own, after all others. Rows go by a
    hash of all their columns, so neither null nor repeated doc_ids gather anywhere; equal rows are interchangeable. An empty table gives an empty
    result. The driver gathers one row a source, and plans at most `blocks` + one block a source, whatever the size of the input.
    """
    placed, most, length, takers = _placed(docs, weights, shards, seed, blocks)
    out = _copies(placed, most).withColumn("pieces", _pieces(length, takers))
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda t, p: t + (p["end"] - p["first"]) * F.size(p["shards"]))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("bigint").alias("taken"), "pieces")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), shards: int = 8, seed: int = 17, blocks: int = BLOCKS, shard_column: str | None = None) -> DataFrame:
    """The mix itself: rows of docs with the columns of docs, each document as often as its words are taken.

    Copy c of a document holds the pieces taken at least c times: the whole text unchanged if that is all of it, else those words, each with the
    white space behind it, so line breaks stay. A document none of whose words are taken is out; n_chars, where docs has it, follows the text.
    `shard_column` names a further column: the shard that takes the copy's first piece (a copy is not torn where shards change).
    Nulls, repeated rows and empty tables: as `mixed` says.
    """
    placed, most, length, takers = _placed(docs, weights, shards, seed, blocks)
    one, two = _hashed(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), one.alias("h1"), two.alias("h2"))
    # the list of all takers stands in the plan of one pass over small rows, not in the one with the texts, of which Spark notes every stage in words
    placed = stored(placed, "placed")
    once = placed.where("n = 1").select("h1", "h2", _pieces(length, takers).alias("pieces"))
    found = rows.join(stored(once, "pieces").hint("shuffle_hash"), ["h1", "h2"])
    release(docs.sparkSession)
    if most > 1:  # of rows that are repeated, one comes with its text, and is copied after its places are known
        again = rows.join(placed.where("n > 1").select("h1", "h2").hint("shuffle_hash"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("row").alias("row"))
        copies = _copies(again.join(placed.where("n > 1"), ["h1", "h2"]), most)
        found = found.unionByName(copies.select("row", "h1", "h2", _pieces(length, takers).alias("pieces")))
    found = found.where(F.exists("pieces", lambda p: F.size(p["shards"]) > 0))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.array_max(F.transform("pieces", lambda p: F.size(p["shards"]))) - 1)))
    taken = F.filter("pieces", lambda p: F.size(p["shards"]) > F.col("copy"))
    words = F.split(F.regexp_replace(F.col("row.text"), f"^{SPACES}", ""), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")  # each with what follows it
    part = F.flatten(F.transform(taken, lambda p: F.slice(words, (p["first"] + 1).cast("int"), (p["end"] - p["first"]).cast("int"))))
    whole = F.size(taken) == F.size("pieces")
    text = F.when(whole, F.col("row.text")).otherwise(F.regexp_replace(F.array_join(part, ""), f"{SPACES}\\z", ""))
    found = found.select("row", text.alias("text"), F.get(F.get(taken, F.lit(0))["shards"], F.col("copy")).alias("shard"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("text")
    shard = [F.col("shard").alias(shard_column)] if shard_column else []
    return found.select(*[out[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns], *shard)
