"""Helpers for registered queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, args: dict | None = None) -> DataFrame:
    """``text`` with {table} for each table it reads."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, args=args, **used)


def both(name: str, text: str, duck: str | None = None) -> None:
    """A query that both engines take as it is, or but for ``duck``."""
    query(name, (duck or text).replace("{", "").replace("}", ""))(lambda spark, sf_dir: run_sql(spark, sf_dir, text))


def scalar(name: str, source: str, keys: str, value: Callable[[], Column], sql: str, where: str | None = None, kind: str | None = None) -> None:
    """A function of the columns of a table: its keys and the function's value as ``result``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        if where:
            df = df.where(where)
        v = value()
        return df.select(*re.split(r",\s*", keys), (v.cast(kind) if kind else v).alias("result"))

    query(name, f"SELECT {keys}, {sql} AS result FROM {source}" + (f" WHERE {where}" if where else ""))(run)


def grouped(name: str, source: str, by: str, values: dict[str, tuple[Callable[[], Column], str]], where: str | None = None) -> None:
    """Aggregates by keys (none: over everything): name -> (Spark, SQL)."""
    keys = [k for k in re.split(r",\s*", by) if k]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        if where:
            df = df.where(where)
        return df.groupBy(*keys).agg(*(v().alias(n) for n, (v, _) in values.items()))

    select = ", ".join([*keys, *(f"{s} AS {n}" for n, (_, s) in values.items())])
    query(name, f"SELECT {select} FROM {source}" + (f" WHERE {where}" if where else "") + (f" GROUP BY {', '.join(keys)}" if keys else ""))(run)


def framed(name: str, source: str, keep: str, values: dict[str, tuple[Callable[[], Column], str]], where: str | None = None) -> None:
    """Window functions: the columns ``keep`` and the functions' values."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        if where:
            df = df.where(where)
        return df.select(*re.split(r",\s*", keep), *(v().alias(n) for n, (v, _) in values.items()))

    query(name, f"SELECT {keep}, " + ", ".join(f"{s} AS {n}" for n, (_, s) in values.items()) + f" FROM {source}" + (f" WHERE {where}" if where else ""))(run)


lit = F.lit
col = F.col
