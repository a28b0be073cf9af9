"""Tables over Parquet folders: options, renames, engines, and import of a whole folder."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.collapsing import Collapsing
from .types import aggregate_of, arguments, schema

TABLE_OPTIONS = frozenset({"database", "table_name", "engine", "fetch_size"})


@dataclass(frozen=True)
class Engine:
    """How a table's rows are to be aggregated: ``default``, ``collapsing`` by a sign column, or ``aggregating`` states."""

    kind: str = "default"
    sign: str | None = None

    @staticmethod
    def parse(text: str | None) -> Engine:
        name, _, rest = (text or "").partition("(")
        name = name.strip().lower()  # engines are named in any case
        if name.endswith("aggregatingmergetree"):
            return Engine("aggregating")
        if name.endswith("collapsingmergetree"):
            # a path and a replica may come before the sign, a version after it
            args = [a.strip().strip('`"') for a in arguments(rest.rpartition(")")[0])]
            sign = args[-2 if "versioned" in name else -1] if len(args) > ("versioned" in name) else ""
            if not re.fullmatch(r"\w+", sign):
                raise ValueError(f"engine {text!r}: not a column name: {sign!r}")
            return Engine("collapsing", sign)
        return Engine()


@dataclass(frozen=True)
class TableSpec:
    """A table: its place, its columns' types where they are declared, its renames and its engine."""

    name: str
    path: str
    columns: Mapping[str, str] = field(default_factory=dict)
    #: our column name -> the name in the files
    column_names: Mapping[str, str] = field(default_factory=dict)
    engine: Engine = Engine()
    format: str = "parquet"
    reader: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def of(name: str, base: str, options: Mapping[str, str], columns: Mapping[str, str] | None = None, column_names: Mapping[str, str] | None = None) -> TableSpec:
        o = validate(options)
        folder = f"{base}/{o['database']}" if o.get("database") else base
        return TableSpec(name, f"{folder}/{o.get('table_name', name)}.parquet", columns or {}, column_names or {}, Engine.parse(o.get("engine")))

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.options(**self.reader)
        if self.columns:
            reader = reader.schema(schema({self.column_names.get(n, n): t for n, t in self.columns.items()}))
        df = reader.format(self.format).load(self.path)
        return df.withColumnsRenamed({theirs: ours for ours, theirs in self.column_names.items()})

    @property
    def aggregates(self) -> Collapsing | None:
        return Collapsing(self.engine.sign) if self.engine.kind == "collapsing" else None

    @property
    def states(self) -> dict[str, str]:
        """Columns that hold aggregate states, and their functions."""
        return {n: f for n, t in self.columns.items() if (f := aggregate_of(t))}


def validate(options: Mapping[str, str], allowed: frozenset[str] = TABLE_OPTIONS) -> dict[str, str]:
    """Unknown options and wrong values are errors."""
    for k, v in options.items():
        if k not in allowed:
            raise ValueError(f"invalid option {k!r}; valid options are: {', '.join(sorted(allowed))}")
        if k == "fetch_size" and not re.fullmatch(r"\d+", str(v)):
            raise ValueError(f"invalid value for fetch_size: {v!r}")
        if k in ("database", "table_name") and not str(v):
            raise ValueError(f"option {k} must not be empty")
        if k in ("database", "table_name") and re.search(r"[\r\n\0/]|\.\.", str(v)):
            raise ValueError(f"invalid value for {k}: {v!r}")
    return {k: str(v) for k, v in options.items()}


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path))


def import_schema(spark: SparkSession, folder: str, only: Sequence[str] | None = None, exclude: Sequence[str] = (), prefix: str = "") -> dict[str, T.StructType]:
    """Registers a view for each Parquet file or folder in ``folder``; returns the schemas. Names keep their case."""
    out = {}
    for child in _children(spark, folder):
        name = child.removesuffix(".parquet")
        if child == name or (only is not None and name not in only) or name in exclude:
            continue
        df = spark.read.parquet(f"{folder}/{child}")
        df.createOrReplaceTempView(prefix + name)
        out[name] = df.schema
    if only is not None and (missing := set(only) - set(out)):
        raise ValueError(f"no such tables: {', '.join(sorted(missing))}")
    return out


def attach(spark: SparkSession, *specs: TableSpec) -> None:
    for s in specs:
        s.read(spark).createOrReplaceTempView(s.name)
