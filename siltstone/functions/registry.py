"""All functions by the name they have in the dialect."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import functions as F

from . import agg, arrays, dates, jsons, maths, regex, strings

FUNCTIONS: dict[str, Callable] = {
    # aggregates
    "count": agg.count,
    "sum": agg.sum_,
    "avg": agg.avg,
    "min": agg.min_,
    "max": agg.max_,
    "bool_and": agg.bool_and,
    "every": agg.every,
    "bool_or": agg.bool_or,
    "bit_and": agg.bit_and,
    "bit_or": agg.bit_or,
    "bit_xor": agg.bit_xor,
    "array_agg": agg.array_agg,
    "string_agg": agg.string_agg,
    "json_agg_strict": agg.json_agg_strict,
    "percentile_cont": agg.percentile_cont,
    "quantile": agg.quantile,
    "quantileExact": agg.quantile_exact,
    "argMin": agg.arg_min,
    "argMax": agg.arg_max,
    "uniq": agg.uniq,
    "uniqExact": agg.uniq_exact,
    "uniqCombined": agg.uniq_combined,
    "uniqCombined64": agg.uniq_combined64,
    "uniqHLL12": agg.uniq_hll12,
    "uniqTheta": agg.uniq_theta,
    # strings
    "lower": strings.lower,
    "upper": strings.upper,
    "substr": strings.substr,
    "substring": strings.substr,
    "length": strings.length,
    "octet_length": strings.octet_length,
    "strpos": strings.strpos,
    "btrim": strings.btrim,
    "ltrim": strings.ltrim,
    "rtrim": strings.rtrim,
    "concat_ws": strings.concat_ws,
    "reverse": strings.reverse,
    "md5": strings.md5,
    "split_part": strings.split_part,
    "string_to_array": strings.string_to_array,
    "bit_count": strings.bit_count_bytes,
    "soundex": strings.soundex,
    "levenshtein": strings.levenshtein,
    # regular expressions
    "regexp_like": regex.regexp_like,
    "regexp_match": regex.regexp_match,
    "regexp_split_to_array": regex.regexp_split_to_array,
    "regexp_replace": regex.regexp_replace,
    "re2match": regex.re2_match,
    "re2extract": regex.re2_extract,
    "re2extractall": regex.re2_extract_all,
    "re2regexpextract": regex.re2_regexp_extract,
    "re2extractgroups": regex.re2_extract_groups,
    "re2extractallgroupshorizontal": regex.re2_extract_all_groups_horizontal,
    "re2extractallgroupsvertical": regex.re2_extract_all_groups_vertical,
    "re2replaceregexpone": regex.re2_replace_one,
    "re2replaceregexpall": regex.re2_replace_all,
    "re2countmatches": regex.re2_count_matches,
    "re2countmatchescaseinsensitive": regex.re2_count_matches_i,
    "re2multimatchany": regex.re2_multi_match_any,
    "re2multimatchanyindex": regex.re2_multi_match_any_index,
    "re2multimatchallindices": regex.re2_multi_match_all_indices,
    "re2regexpquotemeta": regex.re2_quote_meta,
    "re2splitbyregexp": regex.re2_split,
    # dates
    "date_trunc": dates.date_trunc,
    "date_part": dates.date_part,
    "extract": dates.date_part,
    "date": dates.to_date,
    "timezone": lambda zone, ts: dates.at_time_zone(ts, zone),
    "now": dates.now,
    "statement_timestamp": dates.now,
    "transaction_timestamp": dates.now,
    "clock_timestamp": dates.clock_timestamp,
    "to_timestamp": dates.to_timestamp,
    "to_char": dates.to_char,
    # mathematics
    **{n: getattr(F, n) for n in ("abs", "round", "pow", "power", "sin", "cos", "tan", "atan", "atan2", "sinh", "cosh", "tanh", "asinh", "degrees", "radians", "pi")},
    "factorial": maths.factorial,
    "mod": maths.mod,
    "div": maths.div,
    "asin": maths.asin,
    "acos": maths.acos,
    "acosh": maths.acosh,
    "atanh": maths.atanh,
    **{f"toUInt{b}": partial(maths.to_uint, bits=b) for b in (8, 16, 32, 64, 128)},
    # arrays
    "array_cat": arrays.array_cat,
    "array_append": arrays.array_append,
    "array_prepend": arrays.array_prepend,
    "array_remove": arrays.array_remove,
    "array_position": arrays.array_position,
    "idx": arrays.idx,
    "cardinality": arrays.cardinality,
    "array_length": arrays.cardinality,
    "array_to_string": arrays.array_to_string,
    "array_reverse": arrays.array_reverse,
    "array_sort": arrays.array_sort,
    "array_shuffle": arrays.array_shuffle,
    "array_sample": arrays.array_sample,
    "trim_array": arrays.trim_array,
    "array_fill": arrays.array_fill,
    "array_replace": arrays.array_replace,
    "array_positions": arrays.array_positions,
    "array_dims": arrays.array_dims,
    "array_ndims": arrays.array_ndims,
    "array_lower": arrays.array_lower,
    "array_upper": arrays.array_upper,
    # JSON
    "json_extract_path_text": jsons.get_text,
    "jsonb_extract_path_text": jsons.get_text,
    "json_extract_path": jsons.get_json,
    "jsonb_extract_path": jsons.get_json,
}
