"""Columns that hold partial aggregate states, and how they are written, merged and finalised.

A state is a struct (or a sketch) that a later, coarser aggregation merges: sums of sums, counts of counts, unions of
sketches. ``State.write`` makes it from rows, ``State.merge`` a coarser state from states, ``State.finish`` the value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import Str, col


@dataclass(frozen=True)
class State:
    write: Callable[..., Column]
    merge: Callable[[Str], Column]
    finish: Callable[[Str], Column]


def _field(x: Str, name: str) -> Column:
    return col(x).getField(name)


def _quantile(p: float) -> State:
    return State(
        lambda x: F.kll_sketch_agg_double(col(x).cast("double")),
        lambda x: F.kll_merge_agg_double(col(x)),
        lambda x: F.kll_sketch_get_quantile_double(col(x), F.lit(p)),
    )


STATES: dict[str, State] = {
    "sum": State(lambda x: F.sum(col(x)), lambda x: F.sum(col(x)), col),
    "count": State(lambda x=None: F.count(F.lit(1) if x is None else col(x)), lambda x: F.sum(col(x)), lambda x: F.coalesce(col(x), F.lit(0))),
    "min": State(lambda x: F.min(col(x)), lambda x: F.min(col(x)), col),
    "max": State(lambda x: F.max(col(x)), lambda x: F.max(col(x)), col),
    "avg": State(
        lambda x: F.struct(F.sum(col(x).cast("double")).alias("sum"), F.count(col(x)).alias("n")),
        lambda x: F.struct(F.sum(_field(x, "sum")).alias("sum"), F.sum(_field(x, "n")).alias("n")),
        lambda x: F.when(_field(x, "n") > 0, _field(x, "sum") / _field(x, "n")),
    ),
    "uniq": State(lambda x: F.hll_sketch_agg(F.xxhash64(col(x))), lambda x: F.hll_union_agg(col(x)), lambda x: F.hll_sketch_estimate(col(x))),
    "uniqTheta": State(lambda x: F.theta_sketch_agg(F.xxhash64(col(x))), lambda x: F.theta_union_agg(col(x)), lambda x: F.theta_sketch_estimate(col(x))),
    "uniqExact": State(lambda x: F.collect_set(col(x)), lambda x: F.array_distinct(F.flatten(F.collect_list(col(x)))), lambda x: F.size(col(x)).cast("long")),
    "quantile": _quantile(0.5),
}


def state(name: str, p: float | None = None) -> State:
    """The state of an aggregate function by its name."""
    if name == "quantile" and p is not None:
        return _quantile(p)
    if name not in STATES:
        raise ValueError(f"no aggregate state for {name!r}")
    return STATES[name]


def merged(name: str, x: Str, p: float | None = None) -> Column:
    """The aggregate over a column of states: merged and finalised (sumMerge, avgMerge, ...)."""
    s = state(name, p)
    return s.finish(s.merge(x))


def sum_map(df: DataFrame, group: list[str], keys: str, values: str, alias: str = "sums") -> DataFrame:
    """Sums of values by key over two parallel arrays, as a map in order of the keys. Keys are dealt out like any group's."""
    zipped = df.select(*group, F.explode(F.arrays_zip(F.col(keys).alias("k"), F.col(values).alias("v"))).alias("kv"))
    sums = zipped.groupBy(*group, F.col("kv.k").alias("k")).agg(F.sum("kv.v").alias("v"))
    return sums.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(alias))
