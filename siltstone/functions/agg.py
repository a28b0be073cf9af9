"""Aggregate functions of the dialect. Each takes ``where``, a FILTER condition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import Str, col


def only(x: Column, where: Column | None) -> Column:
    """``x`` where the filter holds, else null, which aggregates skip."""
    return x if where is None else F.when(where, x)


def count(x: Str | None = None, *, distinct: bool = False, where: Column | None = None) -> Column:
    if x is None:
        return F.count(F.lit(1)) if where is None else F.count_if(where)
    c = only(col(x), where)
    return F.count_distinct(c) if distinct else F.count(c)


def sum_(x: Str, *, distinct: bool = False, where: Column | None = None) -> Column:
    c = only(col(x), where)
    return F.sum_distinct(c) if distinct else F.sum(c)


def avg(x: Str, *, where: Column | None = None) -> Column:
    return F.avg(only(col(x), where))


def min_(x: Str, *, where: Column | None = None) -> Column:
    return F.min(only(col(x), where))


def max_(x: Str, *, where: Column | None = None) -> Column:
    return F.max(only(col(x), where))


def bool_and(x: Str, *, where: Column | None = None) -> Column:
    return F.bool_and(only(col(x), where))


every = bool_and


def bool_or(x: Str, *, where: Column | None = None) -> Column:
    return F.bool_or(only(col(x), where))


def bit_and(x: Str) -> Column:
    return F.bit_and(col(x))


def bit_or(x: Str) -> Column:
    return F.bit_or(col(x))


def bit_xor(x: Str) -> Column:
    return F.bit_xor(col(x))


def array_agg(x: Str, *, distinct: bool = False, where: Column | None = None) -> Column:
    """Nulls are skipped; the order is that of the input, which a shuffle does not keep."""
    c = only(col(x), where)
    return F.collect_set(c) if distinct else F.collect_list(c)


def string_agg(x: Str, sep: str, *, distinct: bool = False, order_by: Column | None = None, where: Column | None = None) -> Column:
    """With ``order_by`` the values are joined in that order, which must be a sortable expression."""
    c = only(col(x).cast("string"), where)
    if order_by is not None:
        rows = F.collect_list(F.when(c.isNotNull(), F.struct(order_by.alias("k"), c.alias("v"))))
        return F.when(F.count(c) > 0, F.array_join(F.transform(F.sort_array(rows), lambda r: r["v"]), sep))
    return F.listagg_distinct(c, F.lit(sep)) if distinct else F.listagg(c, F.lit(sep))


def string_agg_bytes(x: Str, sep: bytes) -> Column:
    return F.listagg(col(x), F.lit(sep))


REGRESSION = {
    "regr_count": F.regr_count,
    "regr_sxx": F.regr_sxx,
    "regr_syy": F.regr_syy,
    "regr_sxy": F.regr_sxy,
    "regr_avgx": F.regr_avgx,
    "regr_avgy": F.regr_avgy,
    "regr_r2": F.regr_r2,
    "regr_slope": F.regr_slope,
    "regr_intercept": F.regr_intercept,
}


def json_agg_strict(x: Str, *, where: Column | None = None) -> Column:
    """A JSON array of the values that are not null."""
    return F.to_json(F.collect_list(only(col(x), where)))


def quantile(x: Str, p: float = 0.5, *, where: Column | None = None, descending: bool = False) -> Column:
    """Interpolated, as percentile_cont within an order."""
    return F.percentile(only(col(x), where), 1 - p if descending else p)


percentile_cont = quantile


#: How far a share is moved up so that ``percentile_disc``, the first element whose cumulative share reaches it, becomes the
#: first one whose cumulative share exceeds it.
STRICTLY = 1e-12
#: Types that are counted by a number: there and back.
BY_NUMBER = {"date": (F.unix_date, F.date_from_unix_date), "timestamp": (F.unix_micros, F.timestamp_micros)}


def quantile_exact(x: Str, p: float = 0.5, kind: str | None = None, *, where: Column | None = None) -> Column:
    """An element of the sample: the one at floor(p * n), the last one at most. Kept as counts of values, not as a list of
    all elements. kind: the values' type; dates and timestamps need it."""
    there, back = BY_NUMBER.get(kind or "", (lambda c: c, lambda c: c))
    out = percentile_disc(only(there(col(x)), where), min(1.0, p + STRICTLY))
    return back(out.cast("long" if kind == "timestamp" else "int")) if kind in BY_NUMBER else out if kind is None else out.cast(kind)


def _sql(x: Column) -> str:
    """An expression as SQL text."""
    from pyspark.sql import SparkSession

    return SparkSession.active()._jsparkSession.expression(x._jc).sql()


def percentile_disc(x: Str, p: float) -> Column:
    """The first element whose cumulative share reaches p; Spark keeps counts of values, and has the function in SQL only."""
    return F.expr(f"percentile_disc({p!r}D) WITHIN GROUP (ORDER BY {x if isinstance(x, str) else _sql(x)})")


def arg_min(value: Str, by: Str) -> Column:
    return F.min_by(col(value), col(by))


def arg_max(value: Str, by: Str) -> Column:
    return F.max_by(col(value), col(by))


def _one(xs: tuple[Str, ...]) -> Column:
    return col(xs[0]) if len(xs) == 1 else F.struct(*(col(x) for x in xs))


def uniq(*xs: Str, rsd: float = 0.02) -> Column:
    """Approximate number of distinct values or tuples; tuples with nulls count."""
    return F.approx_count_distinct(_one(xs), rsd)


def uniq_exact(*xs: Str, where: Column | None = None) -> Column:
    """Exact; nulls do not count, tuples with nulls do."""
    return F.count_distinct(only(_one(xs), where))


def uniq_combined(*xs: Str) -> Column:
    return uniq(*xs, rsd=0.01)


def uniq_combined64(*xs: Str) -> Column:
    return uniq(*xs, rsd=0.01)


def _hashed(xs: tuple[Str, ...]) -> Column:
    c = _one(xs)
    return F.when(c.isNotNull(), F.xxhash64(c))


def uniq_hll12(*xs: Str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(_hashed(xs), F.lit(12))), F.lit(0).cast("long"))


def uniq_theta(*xs: Str) -> Column:
    return F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(_hashed(xs))), F.lit(0).cast("long"))
