"""String functions with the host dialect's semantics, as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

Str = Column | str


def col(x: Str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower(x: Str) -> Column:
    return F.lower(col(x))


def upper(x: Str) -> Column:
    return F.upper(col(x))


def substr(x: Str, start: int | Column, length: int | Column | None = None) -> Column:
    """Positions count from 1; a start before 1 uses up the length, as in SQL's SUBSTRING."""
    c, start = col(x), start if isinstance(start, Column) else F.lit(start)
    first = F.greatest(start, F.lit(1))
    if length is None:
        return c.substr(first, F.length(c))
    length = length if isinstance(length, Column) else F.lit(length)
    return c.substr(first, F.greatest(start + length - first, F.lit(0)))


def length(x: Str) -> Column:
    """Characters of a string, bytes of a binary."""
    return F.length(col(x))


def octet_length(x: Str) -> Column:
    return F.octet_length(col(x))


def strpos(x: Str, needle: str | Column) -> Column:
    needle = needle if isinstance(needle, Column) else F.lit(needle)
    return F.when(F.length(needle) == 0, F.lit(1)).otherwise(F.position(needle, col(x)))


def btrim(x: Str, chars: str | None = None) -> Column:
    return F.btrim(col(x)) if chars is None else F.btrim(col(x), F.lit(chars))


def ltrim(x: Str, chars: str | None = None) -> Column:
    return F.ltrim(col(x)) if chars is None else F.ltrim(col(x), F.lit(chars))


def rtrim(x: Str, chars: str | None = None) -> Column:
    return F.rtrim(col(x)) if chars is None else F.rtrim(col(x), F.lit(chars))


def concat_ws(sep: str, *xs: Str) -> Column:
    """Nulls are skipped."""
    return F.concat_ws(sep, *(col(x) for x in xs))


def reverse(x: Str) -> Column:
    return F.reverse(col(x))


def reverse_bytes(x: Str) -> Column:
    """A binary's bytes in reverse, as binary."""
    h = F.hex(col(x))
    n = F.length(col(x))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(h, 2 * (n - i) + 1, F.lit(2)))
    return F.when(n == 0, col(x)).otherwise(F.unhex(F.array_join(pairs, "")))


def md5(x: Str) -> Column:
    return F.md5(col(x).cast("binary"))


def split_part(x: Str, sep: str, n: int) -> Column:
    """The n-th part from 1, from the end if negative; the empty string beyond. n = 0 is an error."""
    if n == 0:
        raise ValueError("field position must not be zero")
    return F.split_part(col(x), F.lit(sep), F.lit(n))


def string_to_array(x: Str, sep: str) -> Column:
    """The empty string has no parts."""
    c = col(x)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, re.escape(sep)))


def bit_count_bytes(x: Str) -> Column:
    """Set bits of all bytes of a binary."""
    c = col(x)
    h = F.hex(c)
    digits = F.transform(F.sequence(F.lit(1), F.greatest(F.length(h), F.lit(1))), lambda i: F.bit_count(F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int")))
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.aggregate(digits, F.lit(0), lambda a, b: a + b)).cast("long")


def soundex(x: Str) -> Column:
    return F.soundex(col(x))


def levenshtein(a: Str, b: Str) -> Column:
    return F.levenshtein(col(a), col(b))


def levenshtein_costs(a: Str, b: Str, insert: int, delete: int, substitute: int) -> Column:
    """Edit distance with costs of its own, by rows of the usual table, each made for many pairs at once. Characters are
    code points. Spark's own function has no costs, and its array expressions take milliseconds for a pair of short texts.
    Nested, so that workers without this package get the function itself."""

    def distances(a, b):
        import numpy as np
        import pyarrow as pa

        def points(column):
            """Code points of all texts, and n+1 offsets."""
            texts = ["" if x is None else x for x in column.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
            return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), offsets

        (source, begin), (target, start) = points(a), points(b)
        n, m = np.diff(begin), np.diff(start)
        order = np.lexsort((n, m))[::-1]
        out = np.zeros(len(n), np.int64)
        at = 0
        while at < len(order):
            width = int(m[order[at]]) + 1
            pick = order[at : at + max(1, (1 << 15) // width)]  # a row of the table for each of these pairs at once
            at += len(pick)
            pick = pick[np.argsort(-n[pick], kind="stable")]
            k = np.arange(width - 1)
            other = target[np.minimum(start[pick, None] + k, max(len(target) - 1, 0))] if width > 1 else np.zeros((len(pick), 0), "<u4")
            slope = np.arange(width, dtype=np.int64) * insert
            row = np.repeat(slope[None], len(pick), 0)
            size = n[pick]
            for i in range(int(size[0])):
                live = int(np.searchsorted(-size, -i))  # pairs that have an i-th character
                above = row[:live]
                made = above + delete
                own = source[begin[pick[:live]] + i]
                np.minimum(made[:, 1:], above[:, :-1] + np.where(other[:live] == own[:, None], 0, substitute), out=made[:, 1:])
                made -= slope  # the cell to the left costs an insertion more: the least so far, but for the slope
                np.minimum.accumulate(made, axis=1, out=made)
                made += slope
                row[:live] = made
            out[pick] = row[np.arange(len(pick)), m[pick]]
        missing = [x.is_null().to_numpy(zero_copy_only=False) for x in (a, b)]
        return pa.array(out, pa.int64(), mask=missing[0] | missing[1])

    return F.arrow_udf(distances, "long", ArrowUDFType.SCALAR)(col(a), col(b)).cast("int")
