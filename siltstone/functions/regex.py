"""Regular expressions: the host dialect's operators and functions, and the RE2 function set, on Java patterns.

Flags are those of the host: i ignores case; of m, n, p, s and w the last one decides what dots, ^ and $ see; t is the
default; g is for replacing. Operators do not let a dot match a newline, functions do. ``$`` without a line flag is the
very end of the text, which Java writes ``\\z``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import Str, col

FLAGS = frozenset("imnpstwg")


def pieces(pattern: str) -> Iterator[tuple[str, str]]:
    """The pattern's parts in order: ("class", a whole bracket expression), ("escape", backslash and what it escapes) or
    ("char", any other character). A ``]`` that comes first in a class is one of its characters."""
    k = 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            digits = re.match(r"[1-9][0-9]*", pattern[k + 1 :])
            n = 1 + (len(digits[0]) if digits else 1)
            yield "escape", pattern[k : k + n]
            k += n
        elif c == "[":
            end = k + 1 + pattern.startswith("^", k + 1)
            end += pattern.startswith("]", end)
            while end < len(pattern) and pattern[end] != "]":
                named = re.match(r"\[:\^?[a-z]+:\]", pattern[end:])
                end += len(named[0]) if named else 2 if pattern[end] == "\\" else 1
            yield "class", pattern[k : end + 1]
            k = end + 1
        else:
            yield "char", c
            k += 1


#: Named classes of bracket expressions. Fixed values.
NAMED = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}


def bracket(text: str) -> str:
    """A bracket expression in Java's notation, in which classes may be nested and intersected."""
    head = 2 if text.startswith("[^") else 1
    out, k, end = [text[:head]], head, len(text) - 1
    while k < end:
        named = re.match(r"\[:(\^?)([a-z]+):\]", text[k:])
        if named:
            if named[2] != "word" and named[2] not in NAMED:
                raise ValueError(f"invalid character class: {named[2]!r}")
            out.append(("\\W" if named[1] else "\\w") if named[2] == "word" else f"\\{'P' if named[1] else 'p'}{{{NAMED[named[2]]}}}")
            k += len(named[0])
        elif text[k] == "\\":
            out.append(text[k : k + 2])
            k += 2
        else:
            out.append("\\" + text[k] if text[k] in "[]&" else text[k])
            k += 1
    return "".join(out) + "]"


def host(pattern: str, lines: bool = False) -> str:
    """``pattern`` for Java: bracket expressions, and ``$`` without a line flag as the very end of the text."""
    return "".join(bracket(t) if kind == "class" else "\\z" if t == "$" and not lines else t for kind, t in pieces(pattern))


def java(pattern: str, flags: str = "", base: str = "s") -> str:
    """The Java pattern of a host pattern with flags. base: ``s`` if a dot matches a newline by default."""
    if set(flags) - FLAGS:
        raise ValueError(f"invalid regular expression flags: {flags!r}")
    dots, lines = base == "s", False
    for f in flags:
        if f in "mnpsw":
            dots, lines = {"m": (False, True), "n": (False, True), "p": (False, False), "s": (True, False), "w": (True, True)}[f]
    mode = "i" * ("i" in flags) + "s" * dots + "m" * lines
    return (f"(?{mode})" if mode else "") + host(pattern, lines)


def groups(pattern: str) -> int:
    """Capturing groups of a pattern."""
    rest = "".join("[]" if kind == "class" else "\\." if kind == "escape" else t for kind, t in pieces(pattern))
    return len(re.findall(r"(?<!\\)\((?!\?)|\(\?P?<[A-Za-z]", rest))


def shifted(pattern: str, by: int) -> str:
    """The pattern with its backreferences' numbers moved; digits beyond the last group are characters of their own."""
    n, out = groups(pattern), []
    for kind, t in pieces(pattern):
        if kind == "escape" and t[1:].isdigit() and t[1] != "0":
            digits = t[1:]
            while len(digits) > 1 and int(digits) > n:
                digits = digits[:-1]
            out.append(f"(?:\\{int(digits) + by}){t[1 + len(digits) :]}")
        else:
            out.append(t)
    return "".join(out)


def replacement(text: str, shift: int = 0) -> str:
    """The host's ``\\1`` and ``\\0`` (or ``\\&``) in Java's notation, with group numbers moved by ``shift``."""
    out, k = [], 0
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            d = text[k + 1]
            if d.isdigit() or d == "&":
                out.append(f"${(0 if d == '&' else int(d)) + shift}")
            else:
                out.append("\\\\" if d == "\\" else f"\\{d}" if d == "$" else d)
            k += 2
            continue
        out.append("\\$" if c == "$" else c)
        k += 1
    return "".join(out)


# operators: a dot does not match a newline


def matches(x: Str, pattern: str) -> Column:
    """x ~ pattern"""
    return F.rlike(col(x), F.lit(java(pattern, base="")))


def matches_i(x: Str, pattern: str) -> Column:
    """x ~* pattern"""
    return F.rlike(col(x), F.lit(java(pattern, "i", base="")))


# functions


def regexp_like(x: Str, pattern: str, flags: str = "") -> Column:
    return F.rlike(col(x), F.lit(java(pattern, flags)))


def _captured(x: Column, p: str, n: int) -> Column:
    return F.array(*(F.regexp_extract(x, p, k) for k in range(1, n + 1)))


def regexp_match(x: Str, pattern: str, flags: str = "") -> Column:
    """The groups of the first match, or the match itself if there are none; no match gives an empty array."""
    c, p, n = col(x), java(pattern, flags), groups(pattern)
    if not n:
        return F.slice(F.regexp_extract_all(c, F.lit(p), F.lit(0)), 1, 1)
    return F.when(F.rlike(c, F.lit(p)), _captured(c, p, n)).when(c.isNotNull(), F.array().cast("array<string>"))


def regexp_split_to_array(x: Str, pattern: str, flags: str = "") -> Column:
    return F.split(col(x), java(pattern, flags))


def regexp_replace(x: Str, pattern: str, by: str, flags: str = "") -> Column:
    """The first match is replaced, with the flag g all of them."""
    c = col(x)
    if "g" in flags:
        return F.regexp_replace(c, java(pattern, flags), replacement(by))
    p, by = first_match(pattern, by, flags)
    return F.regexp_replace(c, p, by)


def first_match(pattern: str, by: str, flags: str = "") -> tuple[str, str]:
    """Java's pattern and replacement for the first match only: what comes before it is group 1 and the match group 2, so the
    user's groups move by two."""
    p = java(pattern, flags)
    mode = re.match(r"\(\?([ism]+)\)", p)
    inner = shifted(p[mode.end() :] if mode else p, 2)
    inner = f"(?{mode[1]}:{inner})" if mode else inner
    return rf"\A((?s:.*?))({inner})", "$1" + replacement(by, 2)


# RE2 functions


def re2_match(x: Str, pattern: str) -> Column:
    return F.rlike(col(x), F.lit(java(pattern)))


def re2_extract(x: Str, pattern: str) -> Column:
    """The first group of the first match, or the match; the empty string without one."""
    return F.regexp_extract(col(x), java(pattern), min(1, groups(pattern)))


def re2_extract_all(x: Str, pattern: str) -> Column:
    return F.regexp_extract_all(col(x), F.lit(java(pattern)), F.lit(min(1, groups(pattern))))


def re2_regexp_extract(x: Str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(col(x), java(pattern), group)


def re2_extract_groups(x: Str, pattern: str) -> Column:
    c, p = col(x), java(pattern)
    return F.when(F.rlike(c, F.lit(p)), _captured(c, p, groups(pattern))).when(c.isNotNull(), F.array().cast("array<string>"))


def re2_extract_all_groups_horizontal(x: Str, pattern: str) -> Column:
    """For each group the array of what it matched."""
    return F.array(*(F.regexp_extract_all(col(x), F.lit(java(pattern)), F.lit(k)) for k in range(1, groups(pattern) + 1)))


def re2_extract_all_groups_vertical(x: Str, pattern: str) -> Column:
    """For each match the array of its groups."""
    p, n = F.lit(java(pattern)), groups(pattern)
    every = [F.regexp_extract_all(col(x), p, F.lit(k)) for k in range(1, n + 1)]
    return F.transform(F.arrays_zip(*(e.alias(f"g{k}") for k, e in enumerate(every))), lambda m: F.array(*(m[f"g{k}"] for k in range(n))))


def re2_replace_one(x: Str, pattern: str, by: str) -> Column:
    return regexp_replace(x, pattern, by)


def re2_replace_all(x: Str, pattern: str, by: str) -> Column:
    return regexp_replace(x, pattern, by, "g")


def re2_count_matches(x: Str, pattern: str) -> Column:
    return F.regexp_count(col(x), F.lit(java(pattern)))


def re2_count_matches_i(x: Str, pattern: str) -> Column:
    return F.regexp_count(col(x), F.lit(java(pattern, "i")))


def re2_multi_match_any(x: Str, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | re2_match(x, p)
    return out


def re2_multi_match_any_index(x: Str, patterns: Sequence[str]) -> Column:
    """The number from 1 of the first pattern that matches, 0 if none does."""
    return F.coalesce(*(F.when(re2_match(x, p), F.lit(k)) for k, p in enumerate(patterns, 1)), F.lit(0))


def re2_multi_match_all_indices(x: Str, patterns: Sequence[str]) -> Column:
    return F.filter(F.array(*(F.when(re2_match(x, p), F.lit(k)) for k, p in enumerate(patterns, 1))), lambda k: k.isNotNull())


#: Characters with a meaning in patterns, which quoting puts a backslash before; a zero byte is written \\0. Fixed values.
META = r"\|()^$.[]?*+{:-"


def re2_quote_meta(x: Str) -> Column:
    quoted = F.regexp_replace(col(x), "([" + "".join("\\" + c for c in META) + "])", r"\\$1")
    return F.replace(quoted, F.lit("\0"), F.lit("\\0"))


def re2_split(pattern: str, x: Str, n: int | None = None) -> Column:
    """The parts between matches, the first n of them if n is given."""
    parts = F.split(col(x), java(pattern))
    return parts if not n else F.slice(parts, 1, n)
