"""Joins, frames and orders that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def semi(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """EXISTS."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """NOT EXISTS."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, value: str, right: DataFrame, other: str) -> DataFrame:
    """NOT IN (subquery): nothing at all if the subquery has a null; a null on the left only passes an empty one.

    An equi-join and one aggregate of the right side: Spark's own null-aware anti join must broadcast that side."""
    seen = right.agg(F.count("*").alias("__rows"), F.count(other).alias("__full"))
    kept = left.join(right.select(F.col(other).alias("__v")).distinct(), F.col(value) == F.col("__v"), "left_anti")
    kept = kept.crossJoin(F.broadcast(seen))  # one row
    return kept.where((F.col("__rows") == 0) | ((F.col("__rows") == F.col("__full")) & F.col(value).isNotNull())).drop("__rows", "__full")


def host_order(*keys: tuple[str, bool]) -> list[Column]:
    """Sort keys as (column, descending) with the host's places for nulls: last ascending, first descending."""
    return [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in keys]


def top_k(df: DataFrame, k: int, *keys: tuple[str, bool], offset: int = 0) -> DataFrame:
    out = df.orderBy(*host_order(*keys))
    return (out.offset(offset) if offset else out).limit(k)


def groups_frame(df: DataFrame, partition: Sequence[str], order: Sequence[Column], start: int, end: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over GROUPS BETWEEN start AND end: frames counted in groups of peers.

    Spark has no such frame; peers get their dense rank, over which the frame is a range."""
    ranked = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy("__peer").rangeBetween(start, end)
    return ranked.select(*df.columns, *(a.over(w).alias(n) for n, a in aggregates.items()))


def window(partition: Sequence[str] = (), order: Sequence[Column] = (), rows: tuple[int, int] | None = None, range_: tuple[int, int] | None = None) -> WindowSpec:
    w = Window.partitionBy(*partition)
    if order:
        w = w.orderBy(*order)
    if rows:
        w = w.rowsBetween(*rows)
    if range_:
        w = w.rangeBetween(*range_)
    return w
