"""Reading, writing and statements."""

from __future__ import annotations

import contextlib
import io
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

T = TypeVar("T")
CODECS = {"lz4": "lz4_raw", "zstd": "zstd", "none": "uncompressed", "snappy": "snappy"}


class NotSupported(Exception):
    """A statement that tables do not support."""


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns is not None else df


#: Escapes of text cells but that of the backslash itself. Fixed values.
ESCAPES = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\b": "\b", "\\f": "\f", "\\0": "\0", "\\'": "'"}
_BACKSLASH = "\ue000"  # stands for an escaped backslash meanwhile


def _unescaped(x: Column) -> Column:
    x = F.replace(x, F.lit("\\\\"), F.lit(_BACKSLASH))
    for written, meant in ESCAPES.items():
        x = F.replace(x, F.lit(written), F.lit(meant))
    return F.replace(x, F.lit(_BACKSLASH), F.lit("\\"))


def _array(cell: Column, kind: ArrayType) -> Column:
    """``[1,NULL]``, ``['a','it\\'s']`` and nested ones: each quoted part becomes a JSON string."""
    parts = F.regexp_extract_all(cell, F.lit(r"'(?:[^'\\]|\\.)*'|[^']+|'"), F.lit(0))
    quoted = lambda p: F.substring(F.to_json(F.array(_unescaped(F.substring(p, F.lit(2), F.length(p) - 2)))), F.lit(2), F.length(F.to_json(F.array(_unescaped(F.substring(p, F.lit(2), F.length(p) - 2))))) - 2)
    json = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("'"), quoted(p)).otherwise(F.regexp_replace(p, "NULL", "null"))), "")
    return F.from_json(json, kind, {"mode": "FAILFAST"})


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text with ``\\N`` for null and backslash escapes. Arrays are written ``[1,2]`` or ``['a','b']``."""
    want = StructType.fromDDL(schema)
    raw = StructType([StructField(f.name, StringType() if isinstance(f.dataType, ArrayType) else f.dataType) for f in want.fields])
    df = spark.read.csv(path, sep="\t", nullValue="\\N", schema=raw, quote="", escape="", mode="FAILFAST", emptyValue="")

    def value(f: StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return _array(c, f.dataType) if isinstance(f.dataType, ArrayType) else _unescaped(c) if isinstance(f.dataType, StringType) else c

    return df.select(*(value(f).alias(f.name) for f in want.fields))


def batches(df: DataFrame, prefetch: bool = True) -> Iterator:
    """Rows to a client partition by partition: its memory holds one partition, or two with ``prefetch``."""
    return df.toLocalIterator(prefetchPartitions=prefetch)


def insert(df: DataFrame, path: str, columns: Sequence[str] | None = None, defaults: Mapping[str, Column] | None = None, compression: str = "zstd") -> None:
    """Appends rows to the table at ``path``. Columns that are not given are null, or their default."""
    spark = df.sparkSession
    target = spark.read.parquet(path).schema
    given = df if columns is None else df.toDF(*columns)
    if unknown := set(given.columns) - set(target.names):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    defaults = defaults or {}
    rows = given.select(*((F.col(f.name) if f.name in given.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in target.fields))
    rows.write.mode("append").option("compression", CODECS[compression]).parquet(path)


def create(spark: SparkSession, path: str, schema: str, compression: str = "zstd") -> None:
    """An empty table; an error if it exists."""
    spark.createDataFrame([], schema).write.mode("errorifexists").option("compression", CODECS[compression]).parquet(path)


def copy_from(spark: SparkSession, source: str, path: str, columns: Sequence[str] | None = None, sep: str = "\t", null: str = "\\N", header: bool = False) -> None:
    """COPY FROM a text file."""
    target = spark.read.parquet(path).schema
    names = list(columns or target.names)
    rows = spark.read.csv(source, sep=sep, nullValue=null, header=header, schema=StructType([target[n] for n in names]), mode="FAILFAST")
    insert(rows, path)


def update(*_: object, **__: object) -> None:
    raise NotSupported("tables do not support updates/deletes")


delete = update


def raw_query(spark: SparkSession, text: str, args: Mapping[str, object] | None = None) -> str:
    """A statement's result as one text: tabs between values, a line for each row, ``\\N`` for null. The rows are brought
    to the driver, as the caller asks for one value."""

    def cell(x: object) -> str:
        if x is None:
            return "\\N"
        if isinstance(x, bool):
            return str(x).lower()
        return str(x).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")

    return "".join("\t".join(map(cell, r)) + "\n" for r in spark.sql(text, args=dict(args or {})).toLocalIterator())


def explain(df: DataFrame, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of a catalog table; nothing for a view."""
    if spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType != "TEMPORARY":
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def cancellable(spark: SparkSession, tag: str) -> contextlib.AbstractContextManager:
    """Jobs started inside can be stopped by ``cancel(spark, tag)`` from any thread."""
    sc = spark.sparkContext

    @contextlib.contextmanager
    def tagged() -> Iterator[None]:
        sc.addJobTag(tag)
        try:
            yield
        finally:
            sc.removeJobTag(tag)

    return tagged()


def cancel(spark: SparkSession, tag: str) -> list[int]:
    """Stops the running jobs with the tag; their numbers. A session's own tags are known to the thread that set them only,
    so the tag is one of the context."""
    sc = spark.sparkContext
    tracker = sc._jsc.sc().statusTracker()
    running = set(tracker.getActiveJobIds())
    jobs = sorted(j for j in tracker.getJobIdsForTag(tag) if j in running)
    if jobs:
        sc.cancelJobsWithTag(tag)
    return jobs


def retry(call: Callable[[], T], attempts: int = 3, on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), wait: float = 0.1) -> T:
    """A driver-side call, again after a passing failure, each time after twice the wait. Failed tasks are Spark's to retry."""
    for k in range(attempts):
        try:
            return call()
        except on:
            if k + 1 == attempts:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("retry: no attempts")


def version() -> str:
    from .. import __version__

    return __version__
