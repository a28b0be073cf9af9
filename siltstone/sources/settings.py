"""Session settings given as one string: ``name value, name 'value'``."""

from __future__ import annotations

from pyspark.sql import SparkSession


def parse_settings(text: str) -> dict[str, str]:
    """Names and values, separated by a blank or ``=``; entries by commas. A quoted value may hold anything, with ``\\``
    before a quote or backslash, or a doubled quote."""
    out: dict[str, str] = {}
    k, n = 0, len(text)

    def blank(k: int) -> int:
        while k < n and text[k].isspace():
            k += 1
        return k

    k = blank(0)
    while k < n:
        start = k
        while k < n and not text[k].isspace() and text[k] not in ",='":
            k += 1
        name = text[start:k]
        if not name:
            raise ValueError(f"settings: a name is missing at {text[start:]!r}")
        k = blank(k)
        if k < n and text[k] == "=":
            k = blank(k + 1)
        if k >= n or text[k] == ",":
            raise ValueError(f"settings: {name} has no value")
        if text[k] == "'":
            value, k = [], k + 1
            while True:
                if k >= n:
                    raise ValueError(f"settings: the value of {name} does not end")
                if text[k] == "\\" and k + 1 < n:
                    value.append(text[k + 1])
                    k += 2
                elif text[k] == "'" and text[k + 1 : k + 2] == "'":
                    value.append("'")
                    k += 2
                elif text[k] == "'":
                    k += 1
                    break
                else:
                    value.append(text[k])
                    k += 1
            out[name] = "".join(value)
        else:
            start = k
            while k < n and text[k] != "," and not text[k].isspace():
                k += 1
            out[name] = text[start:k]
        k = blank(k)
        if k < n:
            if text[k] != ",":
                raise ValueError(f"settings: a comma is missing at {text[k:]!r}")
            k = blank(k + 1)
    return out


#: Settings that change nothing here, since Spark behaves so anyway or evaluates everything itself.
ACCEPTED = frozenset({"join_use_nulls", "group_by_use_nulls", "final", "pushdown_regex", "connect_timeout", "fetch_size"})


def apply_settings(spark: SparkSession, text: str) -> dict[str, str]:
    """Sets what names a Spark setting; returns all that was given. Names that nobody knows are an error."""
    given = parse_settings(text)
    for name, value in given.items():
        if name.startswith("spark."):
            spark.conf.set(name, value)
        elif name not in ACCEPTED:
            raise ValueError(f"unknown setting {name!r}")
    return given
