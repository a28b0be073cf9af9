"""JSON held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import Str, col


def path(*keys: str | int) -> str:
    """A JSON path; a key may hold anything but both kinds of quotes."""

    def part(k: str | int) -> str:
        if isinstance(k, int):
            return f"[{k}]"
        if "'" in k and '"' in k:
            raise ValueError(f"JSON key with both kinds of quotes: {k!r}")
        return f'["{k}"]' if "'" in k else f"['{k}']"

    return "$" + "".join(map(part, keys))


def get_text(j: Str, *keys: str | int) -> Column:
    """j ->> key, json_extract_path_text: the value as text, null if absent."""
    value = F.try_variant_get(F.try_parse_json(col(j)), path(*keys), "variant")
    text = F.to_json(value)
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).when(text != "null", text)


def get_json(j: Str, *keys: str | int) -> Column:
    """j -> key, j[key], json_extract_path: the value as JSON text, null if absent."""
    return F.to_json(F.try_variant_get(F.try_parse_json(col(j)), path(*keys), "variant"))


def get_text_by(j: Str, key: Column) -> Column:
    """j ->> key for a key that differs by row."""
    return F.call_function("get_json_object", col(j), F.concat(F.lit("$['"), key, F.lit("']")))


def map_get(m: Str, key: str | Column) -> Column:
    """hstore -> key: null if absent."""
    return F.try_element_at(col(m), key if isinstance(key, Column) else F.lit(key))
