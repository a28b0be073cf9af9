"""Personal data: patterns, and information-theoretic sanitisation of what stands near them. DataFrame functions only.

Base spans are e-mail and IP addresses, card and phone numbers, in code points. A base span's value is a protected
entity. The method then asks which terms disclose entities: over the corpus of N distinct texts, an entity in n_e of them,
a term in c_t, and both in n_te,

    disclosure = PMI / IC = log2(n_te * N / (n_e * c_t)) / log2(N / n_e),

1 for a term that occurs with this entity only, about 0 for a term that is as frequent elsewhere. The context of an entity
is the whole text. Copies of a text count once in all four, so that copying changes no score; texts that differ at all are
different ones. A term and an entity must meet ``support`` times: in a text, as often as the rarer of them is there. An
entity of every text discloses nothing. Terms of at least ``remove`` are removed wherever they are in a text with the
entity, those of at least ``generalise`` replaced by their kind.

How it is distributed. The patterns need one pass, whose spans are written and used from then on. Only distinct texts with entities that occur ``support`` times go on;
entities of the same texts are one class, so that a list of addresses does not meet all its terms address by address.
The corpus's texts are made distinct by a shuffle; their term counts are summed in each task before the next one, and
joined to the candidates by shuffle; nothing is broadcast by hand and no group is collected but the spans of one document.

Nulls and edges: a null text is empty and has no spans; null ids and repeated rows are treated row by row; empty tables
give no rows; further columns are ignored, or kept by ``sanitise``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, settle

#: The kinds and their patterns; as given, but so that no text takes more than linear time: a match can only begin
#: where its run of characters does, and what is not followed by anything is never given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a longest chain of digits with single separators, matched only if it has 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]+"
GAP = r"[^\p{L}\p{N}]+"
BLOCK = 256


@dataclass(frozen=True)
class Settings:
    #: Meetings of a term and an entity, at least.
    support: int = 3
    generalise: float = 0.7
    remove: float = 0.85


def located(text: Column, pattern: str, found: Column) -> Column:
    """``found``, the matches of the pattern in ``text``, as array of (value, s, e): code points, end exclusive.

    A match starts after all gaps and matches before it; the sums are taken over blocks, so that many matches in one
    text do not take quadratic time."""
    gaps = F.split(text, pattern, -1)
    n = F.size(found)
    every = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    step = F.transform(every(n), lambda i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0)))
    blocks = lambda a: F.transform(every(F.ceil(F.size(a) / BLOCK).cast("int")), lambda b: total(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda a: F.transform(every(F.size(a)), lambda b: total(F.slice(a, F.lit(1), b)))
    state = F.array(F.struct(step.alias("step"))), F.array(F.struct(found.alias("m")))
    return F.flatten(
        F.transform(
            state[0],
            lambda x: F.flatten(
                F.transform(
                    F.array(before(blocks(x["step"]))),
                    lambda base: F.transform(
                        x["step"],
                        lambda _, i: F.struct(
                            F.get(state[1][0]["m"], i).alias("value"),
                            (F.get(base, (i / BLOCK).cast("int")) + total(F.slice(x["step"], (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))).alias("s"),
                        ),
                    ),
                )
            ),
        )
    )


def _located(text: Column, pattern: str, found: Column) -> Column:
    at = located(text, pattern, found)
    return F.transform(at, lambda x: F.struct(x["value"].alias("value"), x["s"].alias("s"), (x["s"] + F.length(x["value"])).alias("e")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x["value"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("0"), p), F.lit(3)).cast("int") <= 255)),
    "card": lambda x: _luhn(_digits(x["value"])),
    "phone": lambda x: F.length(_digits(x["value"])).between(9, 15),
}


def base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` (null: empty) in place of its text and, for each kind, ``_<kind>``: the array of its (value, s, e)."""
    none = F.array().cast("array<string>")
    hint = {"email": "@", "phone": "+"}
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).drop("text")
    found = {k: F.regexp_extract_all("_text", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    out = out.select("*", *(F.when(F.contains("_text", F.lit(hint[k])), f).otherwise(none).alias(f"_m_{k}") if k in hint else f.alias(f"_m_{k}") for k, f in found.items()))
    empty = F.array().cast("array<struct<value:string,s:int,e:int>>")
    spans = (F.when(F.size(f"_m_{k}") > 0, F.filter(_located(F.col("_text"), p, F.col(f"_m_{k}")), VALID[k])).otherwise(empty).alias(f"_{k}") for k, p in PATTERNS.items())
    return out.select(*(c for c in out.columns if not c.startswith("_m_")), *spans)


def _entities() -> Column:
    """The entity of each base span."""
    of = lambda kind: lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x["value"]))
    return F.concat(*(F.transform(f"_{k}", of(k)) for k in PATTERNS))


def _counts(docs: DataFrame) -> DataFrame:
    """(term, c_t): in how many distinct texts each term is; the empty term is in all of them."""
    text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    terms = F.array_union(F.transform(F.split("text", GAP), lambda w: F.lower(w)), F.array(F.lit("")))
    return text.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("c_t"))


def disclosing(found: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """``found`` (_row, _text, the kinds' spans) as (_row, terms): arrays of (s, e, kind), ``term`` or ``quasi``, by s."""
    copy = F.xxhash64("_text").alias("copy")
    held = found.select("_row", copy, F.explode(_entities()).alias("entity")).groupBy("_row", "copy", "entity").agg(F.count("*").alias("n"))
    held = settle(held.groupBy("copy", "entity").agg(F.max("n").alias("n")))
    often = held.groupBy("entity").agg(F.bit_xor(F.xxhash64("copy", "n")).alias("who"), F.count("*").alias("n_e"), F.sum("n").alias("times")).where(F.col("times") >= s.support)
    held = settle(held.join(often, "entity").select("copy", "who", "n_e", F.col("n").alias("n_who")).distinct())
    text = settle(found.select(copy, "_text").dropDuplicates(["copy"]).join(held.select("copy").distinct(), "copy", "left_semi"))
    words = text.select("copy", F.explode(F.split("_text", GAP)).alias("term")).where("term != ''")
    words = settle(words.groupBy("copy", F.lower("term").alias("term")).agg(F.count("*").alias("n")))
    meeting = words.join(held, "copy")
    together = meeting.groupBy("who", "n_e", "term").agg(F.count("*").alias("n_te"), F.sum(F.least("n", "n_who")).alias("times")).where(F.col("times") >= s.support)
    candidates = settle(together)
    wanted = candidates.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    counts = settle(_counts(docs).join(wanted, "term", "left_semi").select("term", "c_t"))
    total = float((counts.where("term = ''").first() or {"c_t": 0})["c_t"])
    told = F.log2(F.col("n_te") * F.lit(total) / (F.col("n_e") * F.col("c_t"))) / F.when(F.col("n_e") < total, F.log2(F.lit(total) / F.col("n_e")))
    revealing = candidates.join(counts, "term").withColumn("told", told).where(F.col("told") >= s.generalise)
    kinds = settle(revealing.select("who", "n_e", "term", F.when(F.col("told") >= s.remove, "term").otherwise("quasi").alias("kind")))
    hits = settle(meeting.join(kinds, ["who", "n_e", "term"]).groupBy("copy", "term").agg(F.max("kind").alias("kind")))
    # few bytes, but work for each word: not to be joined into one task (a plain repartition by copy would be left out, as the
    # join deals by it already, to few tasks)
    placed = text.join(hits.select("copy").distinct(), "copy", "left_semi").repartition(partitions(docs), F.xxhash64("copy", F.lit(1)))
    placed = placed.select("copy", F.explode(_located(F.col("_text"), TERM, F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)))).alias("w"))
    placed = placed.select("copy", F.lower("w.value").alias("term"), "w.s", "w.e").join(hits, ["copy", "term"])
    placed = placed.groupBy("copy").agg(F.sort_array(F.collect_list(F.struct("s", "e", "kind"))).alias("terms"))
    return found.select("_row", copy).join(placed, "copy").select("_row", "terms")


def _any() -> Column:
    return F.greatest(*(F.size(f"_{k}") for k in PATTERNS)) > 0


def _with_terms(docs: DataFrame, s: Settings, texts_too: bool) -> tuple[DataFrame, DataFrame]:
    """Rows that have spans, with ``_terms``; and the others. The patterns go over each text once: their spans are settled,
    with ``texts_too`` and all texts, else those that have spans."""
    marked = base(docs).withColumn("_row", F.monotonically_increasing_id())
    if not texts_too:
        marked = marked.withColumn("_text", F.when(_any(), F.col("_text")))
    marked = settle(marked)
    found = marked.where(_any())
    none = F.array().cast("array<struct<s:int,e:int,kind:string>>")
    # a term inside a base span, as of two neighbouring entities, is no span of its own
    inside = lambda x: F.exists(F.concat(*(F.col(f"_{k}") for k in PATTERNS)), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    terms = found.join(disclosing(found, docs, s), "_row", "left").withColumn("_terms", F.filter(F.coalesce("terms", none), lambda x: ~inside(x))).drop("terms")
    return terms, marked.where(~_any()).withColumn("_terms", none)


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): doc_id, n_<kind>, base_sha256, spans."""
    some, others = _with_terms(docs.select("doc_id", "text"), s, False)
    span = lambda kind: lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"])
    of = lambda kind: lambda x: x["kind"] == kind
    named = F.concat(*(F.transform(f"_{k}", span(k)) for k in PATTERNS))
    terms = F.concat(*(F.transform(F.filter("_terms", of(k)), span(k)) for k in ("term", "quasi")))
    text = lambda a: F.array_join(a, ",")
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS]
    some = some.select("doc_id", *counts, F.sha2(text(named), 256).alias("base_sha256"), text(F.concat(named, terms)).alias("spans"))
    zero = [F.lit(0).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return some.union(others.select("doc_id", *zero, F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans")))


def sanitise(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with spans in its text replaced: base spans and generalised terms by ``<kind>``, disclosing terms by
    nothing. Overlapping spans are replaced as one. All other columns and all other texts stay as they are."""
    # the input's columns travel as one, so that none of their names clashes with ours
    others_ = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(F.col("text").isNull().alias("_none"), F.struct(*others_ or [F.lit(0)]).alias("_row")).alias("_all"))
    some, others = _with_terms(packed, s, True)
    by = lambda kind: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind}>").alias("by"))
    named = [F.transform(f"_{k}", by(k)) for k in PATTERNS]
    terms = F.transform("_terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["kind"] == "term", F.lit("")).otherwise(F.lit("<term>")).alias("by")))
    spans = F.sort_array(F.concat(*named, terms))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(a: Column, x: Column) -> Column:
        fresh = x["s"] >= a["at"]
        return F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(fresh, F.concat(a["parts"], F.array(F.substring("_text", a["at"] + 1, x["s"] - a["at"]), x["by"]))).otherwise(a["parts"]).alias("parts"),
        )

    done = F.aggregate(spans, start, add, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring("_text", a["at"] + 1, F.length("_text"))))
    kept = lambda text: [F.when(~F.col("_all._none"), text).alias("text") if c == "text" else F.col("_all").getField("_row").getField(c).alias(c) for c in docs.columns]
    return some.select(*kept(done)).union(others.select(*kept(F.col("_text"))))
