"""Event-time windows; the same functions take batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, length: str, keys: Sequence[str], aggregates: Mapping[str, Column], *, slide: str | None = None, late: str | None = None, time: str = "ts") -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``: start, end, the keys, the aggregates. On a stream, rows that come
    more than ``late`` after the latest time seen are dropped and a window's row is final once it has passed."""
    if late is not None and df.isStreaming:
        df = df.withWatermark(time, late)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return df.groupBy(w.alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items())).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sessions(df: DataFrame, gap: str, keys: Sequence[str], aggregates: Mapping[str, Column], *, late: str | None = None, time: str = "ts") -> DataFrame:
    """Sessions: rows of a key that follow each other by less than ``gap``."""
    if late is not None and df.isStreaming:
        df = df.withWatermark(time, late)
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items())).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there now, in the append mode, and returns the windows that the watermark has made final.
    They are written to ``folder``/rows, which all executors share, by the tasks; nothing of them comes to the driver."""
    q = stream.writeStream.outputMode("append").trigger(availableNow=True).format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
