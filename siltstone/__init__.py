"""siltstone: a Spark-first analytics engine over Parquet tables."""

__version__ = "0.1.0"
