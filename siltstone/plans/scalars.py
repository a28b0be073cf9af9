"""Scalar functions: strings (F), regular expressions (R), dates (D), mathematics (M), arrays (Y), JSON and lookup (K)."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import functions as F

from ..functions import arrays as Y
from ..functions import dates as D
from ..functions import jsons as J
from ..functions import maths as M
from ..functions import regex as R
from ..functions import strings as S
from ..functions.lookup import dict_get
from .common import both, col, lit, scalar, table
from .registry import query

C, P, O, L, E, V, G = "customer", "part", "orders", "lineitem", "events", "embeddings", "documents"
NAME = "p_name || ' ' || p_brand"
name = lambda: F.concat_ws(" ", "p_name", "p_brand")


def s(id_: str, value, sql: str, source: str = P, keys: str = "p_partkey", **more) -> None:
    scalar(id_, source, keys, value, sql, **more)


# F: strings
s("f01_lower", lambda: S.lower("p_brand"), "lower(p_brand)")
s("f02_upper", lambda: S.upper(name()), f"upper({NAME})")
s("f03_substr", lambda: F.concat_ws("|", S.substr("p_name", 2, 3), S.substr("p_name", 4), S.substr("p_name", 0, 3)), "substr(p_name, 2, 3) || '|' || substr(p_name, 4) || '|' || substr(p_name, 1, 2)")
s("f04_substr_bytes", lambda: S.substr(col("p_name").cast("binary"), 2, 3).cast("string"), "substr(p_name, 2, 3)")
s("f05_length", lambda: S.length("text").cast("long"), "length(text)", G, "doc_id")
s("f06_length_bytes", lambda: S.length(col("text").cast("binary")).cast("long"), "strlen(text)", G, "doc_id")
s("f07_octet_length", lambda: S.octet_length("text").cast("long"), "strlen(text)", G, "doc_id")
s("f08_strpos", lambda: S.strpos("p_name", "i").cast("long"), "strpos(p_name, 'i')")
s("f09_btrim", lambda: F.concat_ws("|", S.btrim(F.concat(lit("  "), "p_name", lit(" "))), S.btrim("p_name", "gtb")), "trim('  ' || p_name || ' ') || '|' || trim(p_name, 'gtb')")
s("f10_ltrim", lambda: S.ltrim(F.concat(lit("  "), "p_name")), "ltrim('  ' || p_name)")
s("f11_rtrim", lambda: S.rtrim(F.concat("p_name", lit("  "))), "rtrim(p_name || '  ')")
s("f12_concat_ws", lambda: S.concat_ws("-", "p_name", F.nullif("p_type", lit("PROMO")), "p_brand"), "concat_ws('-', p_name, nullif(p_type, 'PROMO'), p_brand)")
s("f13_reverse", lambda: S.reverse("p_name"), "reverse(p_name)")
s("f14_reverse_bytes", lambda: S.reverse_bytes(col("p_name").cast("binary")).cast("string"), "reverse(p_name)")
s("f15_md5", lambda: S.md5("p_name"), "md5(p_name)")
s("f16_split_part", lambda: F.concat_ws("|", S.split_part("p_name", " ", 2), S.split_part("p_name", " ", -1), S.split_part("p_name", " ", 9)), "split_part(p_name, ' ', 2) || '|' || split_part(p_name, ' ', -1) || '|' || split_part(p_name, ' ', 9)")
s("f17_string_to_array", lambda: S.string_to_array(F.concat("p_name", lit("."), "p_brand"), "."), "string_split(p_name || '.' || p_brand, '.')")
s("f18_bit_count", lambda: S.bit_count_bytes(F.unhex(F.hex(col("p_partkey")))), "bit_count(p_partkey)", kind="long")
query("f19_soundex")(lambda spark, d: table(spark, d, P).select("p_partkey", S.soundex("p_name").alias("result")))
s("f20_levenshtein", lambda: S.levenshtein("p_name", "p_type").cast("long"), "levenshtein(p_name, p_type)")
s("f20_levenshtein_costs", lambda: F.concat_ws("|", S.levenshtein_costs("p_name", F.concat("p_name", lit("xyz")), 5, 1, 1), S.levenshtein_costs(F.concat("p_name", lit("xyz")), "p_name", 1, 7, 9), S.levenshtein_costs("p_name", F.upper("p_name"), 4, 4, 1), S.levenshtein_costs("p_name", lit("ring"), 3, 3, 3)), "concat_ws('|', 15, 21, length(regexp_replace(p_name, '[^a-z]', '', 'g')), 3 * levenshtein(p_name, 'ring'))")

# R: regular expressions
s("r01_match", lambda: R.matches("p_name", "^(red|blue).*t$"), "regexp_matches(p_name, '^(red|blue).*t$')")
s("r02_not_match", lambda: ~R.matches("p_name", "i[nd]"), "NOT regexp_matches(p_name, 'i[nd]')")
s("r03_match_i", lambda: R.matches_i("p_brand", "^BRAND#[0-4]$"), "regexp_matches(p_brand, '^BRAND#[0-4]$', 'i')")
s("r04_not_match_i", lambda: ~R.matches_i("p_brand", "^BRAND#[0-4]$"), "NOT regexp_matches(p_brand, '^BRAND#[0-4]$', 'i')")
s("r05_regexp_like", lambda: R.regexp_like("text", "the.*of$", "s"), "regexp_matches(text, 'the.*of$', 's')", G, "doc_id")
s("r06_regexp_match", lambda: R.regexp_match("p_name", r"(\w)(i\w)"), r"CASE WHEN regexp_matches(p_name, '(\w)(i\w)') THEN [regexp_extract(p_name, '(\w)(i\w)', 1), regexp_extract(p_name, '(\w)(i\w)', 2)] ELSE [] END")
s("r06_regexp_match_whole", lambda: R.regexp_match("p_name", "[aeiou]+."), "regexp_extract_all(p_name, '[aeiou]+.')[1:1]")
s("r07_regexp_split", lambda: R.regexp_split_to_array("p_name", "[ aeiou]"), "regexp_split_to_array(p_name, '[ aeiou]')")
s("r08_regexp_replace", lambda: F.concat_ws("|", R.regexp_replace("p_name", "([aeiou])(.)", r"<\2\1>"), R.regexp_replace("p_name", "([aeiou])", r"<\1\0>", "g"), R.regexp_replace("p_brand", "BRAND", r"\&$", "i")), r"regexp_replace(p_name, '([aeiou])(.)', '<\2\1>') || '|' || regexp_replace(p_name, '([aeiou])', '<\1\0>', 'g') || '|' || regexp_replace(p_brand, '(BRAND)', '\1$', 'i')")
s("r08_regexp_replace_classes", lambda: F.concat_ws("|", R.regexp_replace(F.concat(lit("abccd"), "p_name"), r"(.)\1", "X"), R.regexp_replace("p_name", "[[:alpha:]]+", "W"), R.regexp_replace(F.concat("p_name", lit("]$")), "[]$]$", "!")), "concat_ws('|', 'abXd' || p_name, regexp_replace(p_name, '[A-Za-z]+', 'W'), p_name || ']!')")
s("r09_flags", lambda: F.array(R.regexp_like("text", "a.b"), R.regexp_like("text", "e.t", "n"), R.regexp_like("text", "^re", "m"), R.regexp_like("text", "^RE", "wi"), R.regexp_like("text", "o.d", "p")), "[regexp_matches(text, 'a.b', 's'), regexp_matches(text, 'e.t'), regexp_matches(text, '(?m)^re'), regexp_matches(text, '(?mi)^RE'), regexp_matches(text, 'o.d')]", G, "doc_id")
s("r10_re2match", lambda: R.re2_match("p_name", "o+l"), "regexp_matches(p_name, 'o+l')")
s("r11_re2extract", lambda: F.concat_ws("|", R.re2_extract("p_name", "[aeiou]."), R.re2_extract("p_name", "([aeiou])(.)"), R.re2_extract("p_name", "zz")), "regexp_extract(p_name, '[aeiou].') || '|' || regexp_extract(p_name, '([aeiou])(.)', 1) || '|' || ''")
s("r12_re2extractall", lambda: F.concat(R.re2_extract_all("p_name", "[aeiou]."), R.re2_extract_all("p_name", "([aeiou])(.)")), "list_concat(regexp_extract_all(p_name, '[aeiou].'), regexp_extract_all(p_name, '([aeiou])(.)', 1))")
s("r13_re2regexpextract", lambda: R.re2_regexp_extract("p_name", "([aeiou])(.)", 2), "regexp_extract(p_name, '([aeiou])(.)', 2)")
s("r14_re2extractgroups", lambda: R.re2_extract_groups("p_name", "([aeiou])(.)"), "CASE WHEN regexp_matches(p_name, '([aeiou])(.)') THEN [regexp_extract(p_name, '([aeiou])(.)', 1), regexp_extract(p_name, '([aeiou])(.)', 2)] ELSE [] END")
s("r15_re2groups_horizontal", lambda: R.re2_extract_all_groups_horizontal("p_name", "([aeiou])(.)"), "[regexp_extract_all(p_name, '([aeiou])(.)', 1), regexp_extract_all(p_name, '([aeiou])(.)', 2)]")
s("r16_re2groups_vertical", lambda: R.re2_extract_all_groups_vertical("p_name", "([aeiou])(.)"), "list_transform(range(1, len(regexp_extract_all(p_name, '([aeiou])(.)', 1)) + 1), lambda i: [regexp_extract_all(p_name, '([aeiou])(.)', 1)[i], regexp_extract_all(p_name, '([aeiou])(.)', 2)[i]])")
s("r17_re2replace", lambda: F.concat_ws("|", R.re2_replace_one("p_name", "[aeiou]", "*"), R.re2_replace_all("p_name", "([aeiou])", r"[\1]")), r"regexp_replace(p_name, '[aeiou]', '*') || '|' || regexp_replace(p_name, '([aeiou])', '[\1]', 'g')")
s("r18_re2countmatches", lambda: (R.re2_count_matches("p_name", "[aeiou]") * 100 + R.re2_count_matches_i("p_brand", "[A-D]")).cast("long"), "len(regexp_extract_all(p_name, '[aeiou]')) * 100 + len(regexp_extract_all(p_brand, '(?i)[A-D]'))")
s("r19_re2multimatchany", lambda: R.re2_multi_match_any("p_name", ["^red", "ring$"]), "(regexp_matches(p_name, '^red') OR regexp_matches(p_name, 'ring$'))")
s("r20_re2multimatchanyindex", lambda: R.re2_multi_match_any_index("p_name", ["^red", "ring$", "bolt"]), "CASE WHEN regexp_matches(p_name, '^red') THEN 1 WHEN regexp_matches(p_name, 'ring$') THEN 2 WHEN regexp_matches(p_name, 'bolt') THEN 3 ELSE 0 END")
s("r21_re2multimatchallindices", lambda: R.re2_multi_match_all_indices("p_name", ["^red", "ring$", "r"]), "list_filter([CASE WHEN regexp_matches(p_name, '^red') THEN 1 END, CASE WHEN regexp_matches(p_name, 'ring$') THEN 2 END, CASE WHEN regexp_matches(p_name, 'r') THEN 3 END], lambda x: x IS NOT NULL)")
s("r22_re2quotemeta", lambda: R.re2_quote_meta(F.concat(name(), lit(". a-b_c:d#(e)|{f}"))), "regexp_replace(" + NAME + r", '([-.:({)|\[\]^$*+?\\])', '\\\1', 'g') || '\. a\-b_c\:d#\(e\)\|\{f}'")
s("r23_re2split", lambda: F.concat(R.re2_split("[ aeiou]", "p_name"), R.re2_split("[ aeiou]", "p_name", 2)), "list_concat(regexp_split_to_array(p_name, '[ aeiou]'), regexp_split_to_array(p_name, '[ aeiou]')[1:2])")

# D: dates and times
for unit in ("second", "minute", "hour", "day", "week", "month", "quarter", "year"):
    s(f"d01_date_trunc_{unit}", lambda unit=unit: D.date_trunc(unit, "ts"), f"date_trunc('{unit}', ts)::TIMESTAMP", E, "event_id", kind="timestamp_ntz")
for id_, part, sql in (("d02", "day", "day"), ("d03", "doy", "doy"), ("d04", "dow", "isodow"), ("d05", "year", "year"), ("d05", "month", "month"), ("d05", "hour", "hour"), ("d05", "minute", "minute"), ("d05", "quarter", "quarter"), ("d06", "second", "second"), ("d07", "isoyear", "isoyear"), ("d08", "week", "week")):
    s(f"{id_}_{part}", lambda part=part: D.date_part(part, "ts"), f"CAST(extract({sql} FROM ts) AS BIGINT)", E, "event_id")
s("d09_epoch", lambda: D.date_part("epoch", "ts"), "CAST(floor(epoch(ts)) AS BIGINT)", E, "event_id")
s("d11_date", lambda: D.to_date("ts"), "CAST(ts AS DATE)", E, "event_id")
# over a whole year; summer time from the last Sunday of March to that of October, 01:00 UTC
DAY = "(ts + INTERVAL (event_id % 366) DAY)"
sunday = lambda month: f"(make_date(year({DAY}), {month}, 31) - CAST(dayofweek(make_date(year({DAY}), {month}, 31)) AS INTEGER) + INTERVAL 1 HOUR)"
s("d12_at_time_zone", lambda: D.at_time_zone(col("ts") + F.make_dt_interval((col("event_id") % 366).cast("int")), "Europe/Berlin"), f"{DAY} + CASE WHEN {DAY} >= {sunday(3)} AND {DAY} < {sunday(10)} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END", E, "event_id")


def near(x, clock: str):
    """Whether a time is within ten minutes of the driver's clock where the query was made."""
    return F.abs(F.unix_timestamp(x.cast("timestamp")) - lit(int(time.time()))) < 600 if clock == "utc" else x


s("d13_now", lambda: near(D.now(), "utc") & near(D.local_timestamp(), "utc") & (D.now().cast("timestamp_ntz") == D.local_timestamp()), "true", "region", "r_regionkey")
s("d14_clock", lambda: near(D.clock_timestamp(), "utc") & (D.clock_timestamp() >= D.now() - F.expr("INTERVAL 1 MINUTE")) & (F.current_timestamp() == D.now()), "true", "region", "r_regionkey")
s("d15_current_date", lambda: (D.current_date() == D.to_date(D.now())) & near(D.current_date(), "day").isin(*(datetime.datetime.fromtimestamp(time.time() + d, datetime.UTC).date() for d in (-600, 600))), "true", "region", "r_regionkey")
s("d16_current_time", lambda: F.substring(D.current_time().cast("string"), 1, 8) == F.date_format(D.now(), "HH:mm:ss"), "true", "region", "r_regionkey")
s("d17_to_timestamp", lambda: D.to_timestamp(col("event_id") * 1000.75), "make_timestamp(CAST(trunc(event_id * 1000.75) AS BIGINT) * 1000000)", E, "event_id", kind="timestamp_ntz")
s("d18_to_char", lambda: D.to_char("ts", 'YYYY-MM-DD HH24:MI:SS "at" HH12 AM Mon Dy'), "strftime(ts, '%Y-%m-%d %H:%M:%S at %I %p %b %a')", E, "event_id")
s("d20_interval", lambda: D.plus("ts", months=1, days=2, hours=3), "ts + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 3 HOUR", E, "event_id")
s("d20_interval_minus", lambda: D.minus("ts", days=40), "ts - INTERVAL 40 DAY", E, "event_id")
s("d20_interval_by_row", lambda: D.plus("ts", days=(col("user_id") % 10).cast("int")), "ts + to_days(CAST(user_id % 10 AS INTEGER))", E, "event_id")

# M: mathematics
s("m01_abs", lambda: F.abs("c_acctbal"), "abs(c_acctbal)", C, "c_custkey")
s("m02_round", lambda: F.round(F.round(col("c_acctbal").cast("decimal(15,2)"), 1)), "round(round(CAST(c_acctbal AS DECIMAL(15,2)), 1))", C, "c_custkey", kind="double")
s("m03_factorial", lambda: M.factorial(col("c_nationkey") % 20), "CAST(factorial(c_nationkey % 20) AS BIGINT)", C, "c_custkey")
s("m04_mod", lambda: M.mod(col("c_custkey") - 700, 7), "(c_custkey - 700) % 7", C, "c_custkey")
s("m05_power", lambda: F.pow("c_nationkey", lit(3)), "pow(c_nationkey, 3)", C, "c_custkey")
r = lambda f, *a: F.round(f(*a), 9)
angle = lambda: (col("c_custkey") % 990) / 1000.0
s("m06_trigonometry", lambda: F.array(r(F.sin, angle()), r(F.cos, angle()), r(F.tan, angle())), "[round(sin((c_custkey % 990) / 1000.0), 9), round(cos((c_custkey % 990) / 1000.0), 9), round(tan((c_custkey % 990) / 1000.0), 9)]", C, "c_custkey")
s("m07_arc_tangent", lambda: F.array(r(F.atan, angle()), r(F.atan2, angle(), lit(0.5))), "[round(atan((c_custkey % 990) / 1000.0), 9), round(atan2((c_custkey % 990) / 1000.0, 0.5), 9)]", C, "c_custkey")
s("m08_hyperbolic", lambda: F.array(r(F.sinh, angle()), r(F.cosh, angle()), r(F.tanh, angle()), r(F.asinh, angle())), "[round(sinh((c_custkey % 990) / 1000.0), 9), round(cosh((c_custkey % 990) / 1000.0), 9), round(tanh((c_custkey % 990) / 1000.0), 9), round(asinh((c_custkey % 990) / 1000.0), 9)]", C, "c_custkey")
s("m09_degrees_radians_pi", lambda: F.array(r(F.degrees, angle()), r(F.radians, angle()), F.round(F.pi(), 9)), "[round(degrees((c_custkey % 990) / 1000.0), 9), round(radians((c_custkey % 990) / 1000.0), 9), round(pi(), 9)]", C, "c_custkey")
s("m10_inverse_in_range", lambda: F.array(r(M.asin, angle()), r(M.acos, angle()), r(M.atanh, angle()), r(M.acosh, angle() + 1)), "[round(asin((c_custkey % 990) / 1000.0), 9), round(acos((c_custkey % 990) / 1000.0), 9), round(atanh((c_custkey % 990) / 1000.0), 9), round(acosh((c_custkey % 990) / 1000.0 + 1), 9)]", C, "c_custkey")
for bits, kind in ((8, "SMALLINT"), (16, "INTEGER"), (32, "BIGINT"), (64, "BIGINT"), (128, "DECIMAL(38,0)")):
    s(f"m11_to_uint{bits}", lambda bits=bits: M.to_uint(col("c_nationkey"), bits), f"CAST(c_nationkey AS {kind})", C, "c_custkey")

# Y: arrays
A, B = "[l_linenumber, l_suppkey, 3, 7]", "[3, l_suppkey]"
a = lambda: F.array(col("l_linenumber").cast("long"), "l_suppkey", lit(3).cast("long"), lit(7).cast("long"))
b = lambda: F.array(lit(3).cast("long"), "l_suppkey")
n = lambda x: lit(x).cast("long")


def y(id_: str, value, sql: str, kind: str | None = None) -> None:
    scalar(id_, L, "l_orderkey, l_linenumber", value, sql, kind=kind)


y("y01_array_cat", lambda: Y.array_cat(a(), b()), f"list_concat({A}, {B})")
y("y02_array_append", lambda: Y.array_append(a(), n(5)), f"list_append({A}, 5)")
y("y03_array_prepend", lambda: Y.array_prepend(n(5), a()), f"list_prepend(5, {A})")
y("y04_array_remove", lambda: Y.array_remove(a(), n(3)), f"list_filter({A}, lambda x: x <> 3)")
y("y05_array_position", lambda: Y.array_position(a(), n(2)), f"CAST(list_position({A}, 2) AS BIGINT)")
y("y06_idx", lambda: Y.idx(a(), n(2)), f"CAST(coalesce(list_position({A}, 2), 0) AS BIGINT)")
y("y07_cardinality", lambda: Y.cardinality(F.filter(a(), lambda x: x > 3)), f"len(list_filter({A}, lambda x: x > 3))", "long")
y("y08_array_to_string", lambda: Y.array_to_string(a(), "-"), f"array_to_string({A}, '-')")
y("y09_array_to_string_null", lambda: Y.array_to_string(F.array(F.nullif("l_linenumber", lit(1)), lit(2)), "-", "?"), "coalesce(CAST(nullif(l_linenumber, 1) AS VARCHAR), '?') || '-2'")
y("y10_array_reverse", lambda: Y.array_reverse(a()), f"list_reverse({A})")
nulls = lambda: F.array(col("l_linenumber"), F.nullif("l_linenumber", lit(1)), lit(2))
N = "[l_linenumber, nullif(l_linenumber, 1), 2]"
y("y11_array_sort", lambda: Y.array_sort(nulls()), f"list_sort({N}, 'ASC', 'NULLS LAST')")
y("y12_array_sort_descending", lambda: F.concat(Y.array_sort(nulls(), True), Y.array_sort(nulls(), True, False)), f"list_concat(list_sort({N}, 'DESC', 'NULLS FIRST'), list_sort({N}, 'DESC', 'NULLS LAST'))")
y("y13_array_shuffle", lambda: Y.array_sort(Y.array_shuffle(a())), f"list_sort({A})")
y("y14_array_sample", lambda: F.array(Y.cardinality(Y.array_sample(a(), 2)) == 2, Y.contained_by(Y.array_sample(a(), 2), a())), "[true, true]")
y("y15_trim_array", lambda: Y.trim_array(a(), 3), f"({A})[1:1]")
y("y16_array_fill", lambda: Y.array_fill(col("l_suppkey"), 3), "[l_suppkey, l_suppkey, l_suppkey]")
y("y17_contains", lambda: Y.contains_all(a(), F.array(n(3), n(2))), f"list_has_all({A}, [3, 2])")
y("y18_contained_by", lambda: Y.contained_by(F.array(n(3), n(2)), a()), f"list_has_all({A}, [3, 2])")
y("y19_overlaps", lambda: Y.overlaps(a(), F.array(n(1), n(2))), f"list_has_any({A}, [1, 2])")
y("y20_array_more", lambda: F.concat(Y.array_replace(a(), n(3), n(-3)), Y.array_positions(a(), n(3)).cast("array<bigint>"), F.array(Y.array_lower(a()), Y.array_upper(a()), Y.array_ndims(a())).cast("array<bigint>")), f"list_concat(list_concat(list_transform({A}, lambda x: CASE WHEN x = 3 THEN -3 ELSE x END), list_filter(list_transform(range(1, 5), lambda i: CASE WHEN ({A})[i] = 3 THEN i END), lambda i: i IS NOT NULL)), [1, 4, 1])")
y("y20_array_dims", lambda: Y.array_dims(a()), "'[1:4]'")

# K: JSON, maps and lookup
DOC = "'{\"a\": {\"b c\": \"' || event_type || '\", \"n\": ' || user_id || ', \"l\": [1, ' || event_id || ']}, \"k\": null}'"


def doc():
    return F.concat(lit('{"a": {"b c": "'), "event_type", lit('", "n": '), col("user_id").cast("string"), lit(', "l": [1, '), col("event_id").cast("string"), lit(']}, "k": null}'))


def k(id_: str, value, sql: str) -> None:
    scalar(id_, E, "event_id", value, sql)


k("k01_json_text", lambda: F.concat_ws("|", J.get_text("props", "k"), J.get_text("props", "none"), J.get_text(doc(), "k")), "concat_ws('|', props ->> '$.k', props ->> '$.none')")
k("k02_json_value", lambda: J.get_json("props", "k"), "CAST(props -> '$.k' AS VARCHAR)")
k("k03_json_path_text", lambda: F.concat_ws("|", J.get_text(doc(), "a", "b c"), J.get_text(doc(), "a", "n")), "event_type || '|' || user_id")
k("k04_json_path", lambda: J.get_json(doc(), "a", "b c"), "'\"' || event_type || '\"'")
k("k05_json_subscript", lambda: J.get_json(doc(), "a", "n"), "CAST(user_id AS VARCHAR)")
k("k06_json_special_keys", lambda: J.get_text(F.concat(lit('{"x\'y.z[0]": "'), "event_type", lit('"}')), "x'y.z[0]"), "event_type")
k("k07_json_index_and_column_keys", lambda: F.concat_ws("|", J.get_json(doc(), "a", "l", 1), J.get_text_by("props", lit("k"))), "event_id || '|' || (props ->> '$.k')")
k("k08_map_get", lambda: F.concat_ws("|", J.map_get(F.create_map("event_type", col("user_id").cast("string")), "click"), lit("x")), "CASE WHEN event_type = 'click' THEN user_id || '|x' ELSE 'x' END")


@query("k09_dict_get", "SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(n_regionkey, 0) AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey")
def k09(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return dict_get(table(spark, sf_dir, C).select("c_custkey", "c_nationkey"), nations, {"n_nationkey": "c_nationkey"}, {"n_name": "nation", "n_regionkey": "region"}).drop("c_nationkey")


@query("k09_dict_get_by_tuple", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, '') AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def k09_tuple(spark, sf_dir):
    lines = table(spark, sf_dir, L).select("l_orderkey", "l_linenumber").withColumn("status", lit("F"))
    return dict_get(lines, table(spark, sf_dir, O), {"o_orderkey": "l_orderkey", "o_orderstatus": "status"}, {"o_orderpriority": "priority"}).drop("status")


both("u03_table_function", "SELECT n FROM (SELECT explode(sequence(1, 50)) AS n)", "SELECT CAST(n AS INTEGER) AS n FROM range(1, 51) t(n)")


def refused(attempts: dict) -> list[tuple[str]]:
    """The names of the attempts that raise a ValueError."""
    out = []
    for name_, attempt in attempts.items():
        try:
            attempt()
        except ValueError:
            out.append((name_,))
    return out


@query("d10_refused_fields", "SELECT * FROM (VALUES ('century'), ('microseconds'), ('timezone')) t(field)")
def d10(spark, sf_dir):
    return spark.createDataFrame(refused({f: (lambda f=f: D.date_part(f, "ts")) for f in ("century", "microseconds", "timezone", "Hour")}), "field string")


@query("d19_refused_formats", "SELECT * FROM (VALUES ('Month'), ('Y'), ('DDth'), ('FMDD'), ('am'), ('IW'), ('MS'), ('TZ')) t(format)")
def d19(spark, sf_dir):
    return spark.createDataFrame(refused({f: (lambda f=f: D.to_char("ts", f)) for f in ("Month", "Y", "DDth", "FMDD", "am", "IW", "MS", "TZ", "YYYY")}), "format string")


@query("m10_refused_values", "SELECT * FROM (VALUES ('asin'), ('acos'), ('acosh'), ('atanh')) t(name)")
def m10(spark, sf_dir):
    from pyspark.errors import PySparkException

    out = []
    for name_, f, x in (("asin", M.asin, 2.0), ("acos", M.acos, -2.0), ("acosh", M.acosh, 0.5), ("atanh", M.atanh, 3.0), ("asin", M.asin, 0.5)):
        try:
            spark.range(1).select(f(lit(x))).collect()
        except PySparkException:
            out.append((name_,))
    return spark.createDataFrame(out, "name string")
