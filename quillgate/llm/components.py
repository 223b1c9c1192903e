"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, release, stored


def _state(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b. Minima are pre-aggregated before the shuffle, so a hub of any degree
    costs a row per task; joining the minimum back is an ordinary join that adaptive execution may split."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select("a", "b")
    low = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(low, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of long ids -> (id, root) for each linked id; root is the smallest id of its component.

    Nulls, self-links, repeats and an empty table are allowed: the first two carry no link. Nothing is gathered on
    the driver but one count and one checksum a round; each round is written to the shared folder, and the plans of the one before are let go.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    with Scratch(links.sparkSession) as scratch:
        edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        before = _state(edges)
        for _ in range(max_rounds):
            if not before["n"]:
                break
            release(links.sparkSession)
            edges = stored(_star(_star(edges, True), False), "edges")
            after = _state(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        edges = scratch.keep(edges, "components")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )
