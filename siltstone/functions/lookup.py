"""Dictionary lookup: a join, with the type's default where a key is missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"string": "", "boolean": False, "date": "1970-01-01", "timestamp": "1970-01-01"}


def default(kind: str) -> Column:
    for k, v in DEFAULTS.items():
        if kind.startswith(k):
            return F.lit(v).cast(kind)
    return F.lit(0).cast(kind)


def dict_get(df: DataFrame, dictionary: DataFrame, keys: Mapping[str, str | Column], attributes: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """``df`` with attributes of ``dictionary`` looked up by ``keys`` (dictionary column: value in df).

    Whether the dictionary is broadcast is left to Spark, which knows its size. Of repeated keys one row counts."""
    names = attributes if isinstance(attributes, Mapping) else {a: a for a in attributes}
    wanted = dictionary.select(*(F.col(k).alias(f"__key_{n}") for n, k in enumerate(keys)), *(F.col(a).alias(f"__at_{a}") for a in names)).dropDuplicates([f"__key_{n}" for n in range(len(keys))])
    kinds = dict(dictionary.dtypes)
    on = None
    for n, value in enumerate(keys.values()):
        c = F.col(f"__key_{n}") == (df[value] if isinstance(value, str) else value)
        on = c if on is None else on & c
    out = df.join(wanted, on, "left")
    return out.select(*df.columns, *(F.coalesce(F.col(f"__at_{a}"), default(kinds[a])).alias(alias) for a, alias in names.items()))
