"""Date and time functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import Str, col

TRUNC_FIELDS = frozenset({"second", "minute", "hour", "day", "week", "month", "quarter", "year"})
PARTS = {
    "day": F.dayofmonth,
    "doy": F.dayofyear,
    "dow": lambda c: F.weekday(c) + 1,  # Monday is 1, Sunday 7
    "year": F.year,
    "month": F.month,
    "hour": F.hour,
    "minute": F.minute,
    "quarter": F.quarter,
    "second": F.second,
    "isoyear": lambda c: F.extract(F.lit("YEAROFWEEK"), c),
    "week": F.weekofyear,
    "epoch": lambda c: F.unix_timestamp(c.cast("timestamp")),
}
#: Keywords of to_char that have an exact equivalent, longest first. Fixed values of the host's formats.
TO_CHAR = {
    "YYYY": "yyyy",
    "HH24": "HH",
    "HH12": "hh",
    "DDD": "DDD",
    "Mon": "MMM",
    "YY": "yy",
    "MM": "MM",
    "DD": "dd",
    "HH": "hh",
    "MI": "mm",
    "SS": "ss",
    "Dy": "E",
    "AM": "a",
    "PM": "a",
    "Q": "q",
}


def date_trunc(field: str, x: Str) -> Column:
    """Weeks begin on Monday."""
    if field.lower() not in TRUNC_FIELDS:
        raise ValueError(f"date_trunc: field {field!r} is not supported")
    return F.date_trunc(field.lower(), col(x))


def date_part(field: str, x: Str) -> Column:
    if field.lower() not in PARTS:
        raise ValueError(f"date_part: field {field!r} is not supported")
    return PARTS[field.lower()](col(x)).cast("long")


def to_date(x: Str) -> Column:
    return F.to_date(col(x))


def at_time_zone(x: Str, zone: str) -> Column:
    """The wall clock time in ``zone`` of an instant in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(x).cast("timestamp_ntz"))


def now() -> Column:
    return F.current_timestamp()


def current_date() -> Column:
    return F.current_date()


def current_time() -> Column:
    return F.expr("current_time()")


def local_timestamp() -> Column:
    return F.localtimestamp()


def to_timestamp(x: Str) -> Column:
    """Seconds since 1970; a fraction is dropped."""
    return F.timestamp_seconds(col(x).cast("long"))


def to_char(x: Str, fmt: str) -> Column:
    """Keywords with an exact equivalent and quoted text only; anything else alphabetic is refused."""
    out, k = [], 0
    while k < len(fmt):
        if fmt[k] == '"':
            end = fmt.index('"', k + 1)
            text = fmt[k + 1 : end]
            out.append("'" + text.replace("'", "''") + "'" if text else "")
            k = end + 1
            continue
        word = next((w for w in TO_CHAR if fmt.startswith(w, k)), None)
        if word:
            out.append(TO_CHAR[word])
            k += len(word)
        elif re.match(r"[A-Za-z]", fmt[k]):
            raise ValueError(f"to_char: format {fmt!r} is not supported at {fmt[k:]!r}")
        else:
            out.append(f"'{fmt[k]}'" if fmt[k] in "[]{}#" else "''" if fmt[k] == "'" else fmt[k])
            k += 1
    return F.date_format(col(x), "".join(out))


def plus(x: Str, *, years: int = 0, months: int = 0, weeks: int = 0, days: int | Column = 0, hours: int = 0, minutes: int = 0, seconds: float = 0) -> Column:
    """A timestamp and an interval: first months, then days, then seconds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    seconds = lit(seconds).cast("decimal(18,6)")
    return col(x) + F.make_interval(lit(years), lit(months), lit(weeks), lit(days), lit(hours), lit(minutes), seconds)


def minus(x: Str, **parts: int) -> Column:
    return plus(x, **{k: -v for k, v in parts.items()})


def clock_timestamp() -> Column:
    """The clock as each row is computed; unlike ``now`` it moves on during a query."""
    return F.timestamp_millis(F.java_method(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("bigint"))
