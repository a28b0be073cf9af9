"""Session construction with the settings the engine's semantics rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC and ANSI are part of the semantics (time zones, overflow, bad casts); AQE sizes the shuffles.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "siltstone", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's settings. ``master`` and ``conf`` are for local runs; a cluster's own settings stay."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (BASE_CONF | (conf or {})).items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_session(cpus: int | None = None, app: str = "siltstone") -> SparkSession:
    """local[n] for tests and the bench: as many shuffle partitions as cores, no UI."""
    n = cpus or os.cpu_count() or 8
    return build_session(
        app,
        f"local[{n}]",
        {
            "spark.sql.shuffle.partitions": str(n),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
