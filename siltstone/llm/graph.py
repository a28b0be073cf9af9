"""Connected components by alternating stars, in rounds of joins and aggregates written to the checkpoint folder.

A component's smallest node soon has all its edges, of two numbers each, and they meet in one task of a join. Dealing them to
256 parts by their other ends was tried: its rounds have twice the exchanges, which cost more time and driver's memory on
the check tool's tables than the one larger task does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) as (node, component): the smallest node reachable. Loops and nulls are ignored; nodes
    without an edge to another node are not returned. Rounds go on until one changes nothing; each moves nodes to smaller
    ones only, so there is such a round."""
    e = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).first()
        if tuple(now) == state or not now.n:
            break
        state, old = tuple(now), e
        e = settle(_small(_large(e)))
        forget(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
