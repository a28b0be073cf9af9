"""Array functions. Positions count from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import Str, col


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def subscript(a: Str, i: int | Column) -> Column:
    """arr[i]; null outside the array. A negative i counts from the end."""
    return F.try_element_at(col(a), lit(i)) if not isinstance(i, int) or i else F.get(col(a), -1)


def slice_(a: Str, low: int | None, high: int | None) -> Column:
    """arr[low:high], either end open."""
    c, low = col(a), 1 if low is None else max(1, low)
    if high is None:
        return F.slice(c, lit(low), F.greatest(F.size(c) - low + 1, F.lit(0)))
    return F.slice(c, lit(low), lit(max(0, high - low + 1)))


def array_cat(a: Str, b: Str) -> Column:
    return F.concat(col(a), col(b))


def array_append(a: Str, x) -> Column:
    return F.array_append(col(a), lit(x))


def array_prepend(x, a: Str) -> Column:
    return F.array_prepend(col(a), lit(x))


def array_remove(a: Str, x) -> Column:
    return F.array_remove(col(a), x)


def array_position(a: Str, x) -> Column:
    """Null if absent."""
    return F.nullif(F.array_position(col(a), x), F.lit(0).cast("long"))


def idx(a: Str, x) -> Column:
    """0 if absent."""
    return F.array_position(col(a), x)


def cardinality(a: Str) -> Column:
    return F.size(col(a))


def array_to_string(a: Str, sep: str, null: str | None = None) -> Column:
    c = F.transform(col(a), lambda x: x.cast("string"))
    return F.array_join(c, sep) if null is None else F.array_join(c, sep, null)


def array_reverse(a: Str) -> Column:
    return F.reverse(col(a))


def array_sort(a: Str, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """Nulls last ascending and first descending unless said otherwise."""
    c = col(a)
    nulls_first = descending if nulls_first is None else nulls_first
    full, nulls = F.sort_array(F.filter(c, lambda x: x.isNotNull()), not descending), F.filter(c, lambda x: x.isNull())
    return F.concat(nulls, full) if nulls_first else F.concat(full, nulls)


def array_shuffle(a: Str) -> Column:
    return F.shuffle(col(a))


def array_sample(a: Str, n: int) -> Column:
    return F.slice(F.shuffle(col(a)), 1, n)


def trim_array(a: Str, n: int) -> Column:
    """Without the last n elements; an error if there are fewer."""
    c = col(a)
    return F.when(F.size(c) < n, F.raise_error(F.lit("trim_array: too few elements"))).otherwise(F.slice(c, F.lit(1), F.greatest(F.size(c) - n, F.lit(0))))


def array_fill(x, n: int | Column) -> Column:
    return F.array_repeat(lit(x), n)


def contains_all(a: Str, b: Str) -> Column:
    """a @> b"""
    left = col(a)
    return F.forall(col(b), lambda x: F.array_contains(left, x))


def contained_by(a: Str, b: Str) -> Column:
    """a <@ b"""
    return contains_all(b, a)


def overlaps(a: Str, b: Str) -> Column:
    """a && b"""
    return F.arrays_overlap(col(a), col(b))


def any_equal(x, a: Str) -> Column:
    """x = ANY(a)"""
    return F.array_contains(col(a), lit(x))


def all_differ(x, a: Str) -> Column:
    """x <> ALL(a)"""
    return ~F.array_contains(col(a), lit(x))


def all_equal(x, a: Str) -> Column:
    """x = ALL(a)"""
    x = lit(x)
    return F.forall(col(a), lambda y: y == x)


def array_lower(a: Str) -> Column:
    return F.when(F.size(col(a)) > 0, F.lit(1))


def array_upper(a: Str) -> Column:
    return F.when(F.size(col(a)) > 0, F.size(col(a)))


def array_ndims(a: Str) -> Column:
    return F.when(F.size(col(a)) > 0, F.lit(1))


def array_dims(a: Str) -> Column:
    return F.when(F.size(col(a)) > 0, F.concat(F.lit("[1:"), F.size(col(a)).cast("string"), F.lit("]")))


def array_replace(a: Str, old, new) -> Column:
    old, new = lit(old), lit(new)
    return F.transform(col(a), lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def array_positions(a: Str, x) -> Column:
    x = lit(x)
    every = F.transform(col(a), lambda y, i: F.when(y.eqNullSafe(x), i + 1))
    return F.filter(every, lambda i: i.isNotNull())
