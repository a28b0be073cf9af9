"""Mathematical functions and casts. Overflow and division by zero raise (ANSI)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import Str, col

#: Widest signed type for each unsigned one; the largest exact decimal for 128 bits.
UNSIGNED = {8: "smallint", 16: "int", 32: "bigint", 64: "bigint", 128: "decimal(38,0)"}


def div(a: Str, b: Str) -> Column:
    """Division of integers or decimals, towards zero; exact."""
    return F.call_function("div", col(a), col(b))


def mod(a: Str, b: Str | int) -> Column:
    """The sign is that of the dividend."""
    return col(a) % (col(b) if isinstance(b, str) else b)


def factorial(x: Str) -> Column:
    """An error beyond 20, where the result leaves 64 bits."""
    c = col(x)
    return F.when(c > 20, F.raise_error(F.lit("factorial: value out of range"))).otherwise(F.factorial(c.cast("int")))


def in_range(x: Column, low: float | None, high: float | None, name: str) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (x < low)
    if high is not None:
        bad = bad | (x > high)
    return F.when(bad, F.raise_error(F.lit(f"{name}: input is out of range"))).otherwise(x)


def asin(x: Str) -> Column:
    return F.asin(in_range(col(x), -1, 1, "asin"))


def acos(x: Str) -> Column:
    return F.acos(in_range(col(x), -1, 1, "acos"))


def acosh(x: Str) -> Column:
    return F.acosh(in_range(col(x), 1, None, "acosh"))


def atanh(x: Str) -> Column:
    return F.atanh(in_range(col(x), -1, 1, "atanh"))


def to_uint(x: Str, bits: int) -> Column:
    """A cast to an unsigned integer; negative values and values beyond the width raise."""
    c = col(x).cast("decimal(38,0)")
    most = F.lit(str(2**bits - 1 if bits < 128 else 10**38 - 1)).cast("decimal(38,0)")
    return F.when((c < 0) | (c > most), F.raise_error(F.lit(f"toUInt{bits}: value out of range"))).otherwise(c).cast(UNSIGNED[bits])
