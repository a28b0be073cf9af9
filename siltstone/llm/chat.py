"""Chat formatting with cumulative-snapshot collapse. DataFrame functions only.

Logs often hold a conversation many times, each time a few turns longer. Every turn has a rolling hash of the turns up to
it; a conversation whose last hash is that of an earlier turn of another one is a prefix of that one and is dropped by an
anti-join. Of equal conversations the one with the smallest id stays. What stays is rendered.

How it is distributed. A turn's place in its conversation, and its rolling hash, are found within spans of ``span`` turn
numbers first and then over the spans' totals, so that one endless conversation is spread over many tasks; only the
rendering of a conversation, one text, ends in one. The hashes are two running exclusive ors of 64-bit hashes that cover
place, role and text of each turn. The prefixes of all conversations are made distinct, partly before their shuffle, so
a first turn that a third of all conversations share is one row.

Nulls and edges: rows with a null conv_id belong to no conversation and are left out; a null turn comes first; null roles
and texts are the empty string, as ``unknown`` where rendered; turns of one number follow by role and text; rows that are
equal in all of these are one turn; delimiters of the template inside texts are broken by a space; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


@dataclass(frozen=True)
class Settings:
    span: int = 1024
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", "role", "text")


def placed(conversations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(conv_id, span, pos, role, text, n, h1, h2): each turn with its place from 1, its conversation's length and the
    rolling hashes of the turns up to it."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    turns = turns.distinct().withColumn("span", F.coalesce(F.floor(F.col("turn") / s.span), F.lit(-(2**62))).cast("long"))
    within = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("rn", F.row_number().over(within))
    totals = turns.groupBy("conv_id", "span").agg(F.count("*").alias("size"))
    over = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    totals = totals.select("conv_id", "span", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("before"), F.sum("size").over(every).alias("n"))
    turns = turns.join(totals, ["conv_id", "span"]).withColumn("pos", F.col("before") + F.col("rn"))
    running = Window.partitionBy("conv_id", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("t1", _hash(1)).withColumn("t2", _hash(2))
    turns = turns.withColumn("r1", F.bit_xor("t1").over(running)).withColumn("r2", F.bit_xor("t2").over(running))
    sums = turns.groupBy("conv_id", "span").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    zero = F.lit(0).cast("long")
    sums = sums.select("conv_id", "span", F.coalesce(F.bit_xor("s1").over(over), zero).alias("b1"), F.coalesce(F.bit_xor("s2").over(over), zero).alias("b2"))
    return turns.join(sums, ["conv_id", "span"]).select("conv_id", "span", "pos", "role", "text", "n", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations of ``turns``, as made by ``placed``, that are no prefix of another one, (conv_id, n, copies)."""
    ends = turns.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = turns.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return ends.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", "n", "copies")


def render(turns: DataFrame, kept: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One text for each conversation in ``kept``: conv_id, n_turns, n_copies, text."""
    broken = lambda c: F.replace(F.replace(c, F.lit(s.begin), F.lit(s.begin[:1] + " " + s.begin[1:])), F.lit(s.end), F.lit(s.end[:1] + " " + s.end[1:]))
    role = F.when(F.col("role") == "", "unknown").otherwise(broken(F.col("role")))
    piece = F.concat(F.lit(s.begin), role, F.lit("\n"), broken(F.col("text")), F.lit(s.end), F.lit("\n"))
    pieces = turns.join(kept.select("conv_id", "copies"), "conv_id").select("conv_id", "copies", "span", "pos", "n", piece.alias("piece"))
    in_order = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]), "")
    spans = pieces.groupBy("conv_id", "span").agg(in_order("pos", "piece").alias("piece"), F.max("n").alias("n"), F.max("copies").alias("copies"))
    return spans.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("copies").alias("n_copies"), in_order("span", "piece").alias("text"))


def collapse(conversations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as rendered maximal conversations."""
    turns = settle(placed(conversations, s))
    return render(turns, maximal(turns), s)
