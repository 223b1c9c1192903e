"""Exact deduplication by 128-bit content hash, with the bytes of each group compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, stored

BROADCAST_KEYS = 200_000
WHITE = "[\\x20\\x09-\\x0D]+"


def _groups(hashed: DataFrame) -> DataFrame:
    """(key, group_size, best) of the groups of several rows; best is the row that stays."""
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("row").alias("row")))
    return stored(hashed.groupBy("key").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1"), "groups")


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of docs(doc_id, text, ...).

    Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts one row stays: one with the
    most code points, of these one with the smallest doc_id (null last), of equal rows any one. keep_id is that row's doc_id, null if it has none. Other rows of that
    doc_id go like all the rest. An empty table gives an empty result; other columns are ignored.

    Rows are grouped by MD5; only groups of several rows have their texts read again, and the least and greatest text of a
    group, found by pre-aggregation, must agree. Groups where they don't are split by the SHA-256 of the text. Rows get their group's choice from a
    broadcast of up to BROADCAST_KEYS groups of several rows; more are joined.
    """
    texts = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    plain = texts.withColumn("plain", F.regexp_replace("text", WHITE, ""))
    hashed = stored(
        plain.select("doc_id", F.unhex(F.md5("plain")).alias("key"), F.unhex(F.sha2("plain", 256)).alias("sha"), F.length("text").alias("points"), F.monotonically_increasing_id().alias("row")), "hashes"
    )
    groups = _groups(hashed)
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    unequal = (
        plain.select("plain", F.unhex(F.md5("plain")).alias("key")).join(small(groups.select("key")), "key", "left_semi")
        .groupBy("key").agg(F.min("plain").alias("a"), F.max("plain").alias("b")).where("a <> b").select("key", F.lit(True).alias("split"))
    )
    unequal = stored(unequal, "collisions")
    if unequal.limit(1).count():
        hashed = hashed.join(unequal, "key", "left").withColumn("key", F.when(F.col("split"), F.concat("key", "sha")).otherwise(F.col("key"))).drop("split")
        groups = _groups(hashed)
    alone = F.col("best").isNull()
    kept = F.coalesce(F.col("row") == F.col("best.row"), F.lit(False))
    return hashed.join(small(groups), "key", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | kept).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
