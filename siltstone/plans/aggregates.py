"""Aggregate functions (A) and window functions (W)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import agg as A
from ..operators import relational as rel
from ..operators import states as S
from ..operators.collapsing import Collapsing
from .common import both, col, framed, grouped, lit, table
from .registry import query

L, O, E, C = "lineitem", "orders", "events", "customer"
BIG = lambda c: c.cast("long")


def beside_exact(name: str, xs: tuple[str, ...], value: Callable[..., Column], near: Callable[[Column, Column], Column]) -> None:
    """An approximate count held against the exact one. Each is an aggregation of its own: in one with a distinct count, Spark
    makes a sketch for each distinct value."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, L)
        sketch = df.groupBy("l_returnflag").agg(value(*xs).alias("sketch"))
        exact = df.groupBy(col("l_returnflag").alias("flag")).agg(F.count_distinct(*xs).alias("exact"))
        return sketch.join(exact, col("l_returnflag").eqNullSafe(col("flag"))).select("l_returnflag", near(col("sketch"), col("exact")).alias("near"))

    query(name, f"SELECT l_returnflag, true AS near FROM {L} GROUP BY l_returnflag")(run)


def within(share: float) -> Callable[[Column, Column], Column]:
    return lambda sketch, exact: F.abs(sketch / exact - 1) < share


grouped("a01_count", L, "l_returnflag", {"rows": (lambda: A.count(), "count(*)"), "some": (lambda: A.count(F.nullif(col("l_linenumber"), lit(1))), "count(nullif(l_linenumber, 1))")})
grouped("a02_sum", L, "l_returnflag", {"i": (lambda: A.sum_("l_linenumber"), "CAST(sum(l_linenumber) AS BIGINT)"), "d": (lambda: F.round(A.sum_("l_quantity"), 2), "round(sum(l_quantity), 2)"), "m": (lambda: A.sum_(col("l_extendedprice").cast("decimal(15,2)")).cast("decimal(25,2)"), "CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2))")})
grouped("a03_avg", L, "l_returnflag", {"i": (lambda: A.avg("l_linenumber"), "avg(l_linenumber)"), "d": (lambda: F.round(A.avg("l_quantity"), 6), "round(avg(l_quantity), 6)")})
grouped("a04_min", O, "o_orderstatus", {"n": (lambda: A.min_("o_totalprice"), "min(o_totalprice)"), "t": (lambda: A.min_("o_orderdate"), "min(o_orderdate)"), "s": (lambda: A.min_("o_orderpriority"), "min(o_orderpriority)")})
grouped("a05_max", O, "o_orderstatus", {"n": (lambda: A.max_("o_totalprice"), "max(o_totalprice)"), "t": (lambda: A.max_("o_orderdate"), "max(o_orderdate)"), "s": (lambda: A.max_("o_orderpriority"), "max(o_orderpriority)")})
grouped("a06_bool_and", O, "o_custkey", {"r": (lambda: A.bool_and(col("o_totalprice") > 1000), "bool_and(o_totalprice > 1000)"), "e": (lambda: A.every(col("o_orderstatus") != "P"), "bool_and(o_orderstatus <> 'P')")})
grouped("a07_bool_or", O, "o_custkey", {"r": (lambda: A.bool_or(col("o_orderstatus") == "P"), "bool_or(o_orderstatus = 'P')")})
grouped("a08_bit", L, "l_suppkey", {"a": (lambda: A.bit_and("l_orderkey"), "bit_and(l_orderkey)"), "o": (lambda: A.bit_or("l_orderkey"), "bit_or(l_orderkey)"), "x": (lambda: A.bit_xor("l_orderkey"), "bit_xor(l_orderkey)")})
grouped("a09_array_agg", O, "o_custkey", {"r": (lambda: F.array_sort(A.array_agg(F.nullif("o_orderstatus", lit("P")))), "list_sort(coalesce(list(o_orderstatus) FILTER (WHERE o_orderstatus <> 'P'), []))")})
grouped("a10_array_agg_of_arrays", "embeddings", "label", {"r": (lambda: F.array_sort(A.array_agg(F.slice("embedding", 1, 2))), "list_sort(list(embedding[1:2]))")})
grouped("a11_string_agg", O, "o_custkey", {"r": (lambda: F.array_join(F.array_sort(F.split(A.string_agg("o_orderstatus", ","), ",")), ","), "string_agg(o_orderstatus, ',' ORDER BY o_orderstatus)"), "d": (lambda: F.array_join(F.array_sort(F.split(A.string_agg("o_orderstatus", ",", distinct=True), ",")), ","), "string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus)")})
grouped("a12_string_agg_ordered", O, "o_custkey", {"r": (lambda: A.string_agg("o_orderpriority", "|", order_by=col("o_orderkey")), "string_agg(o_orderpriority, '|' ORDER BY o_orderkey)")})
in_order = lambda c, sep=",": F.array_join(F.array_sort(c), sep)
grouped("a13_string_agg_bytes", O, "o_custkey", {"parts": (lambda: in_order(F.split(F.decode(A.string_agg_bytes(col("o_orderpriority").cast("binary"), b"|"), "UTF-8"), r"\|")), "string_agg(o_orderpriority, ',' ORDER BY o_orderpriority)"), "n": (lambda: BIG(F.length(A.string_agg_bytes(col("o_orderpriority").cast("binary"), b"|"))), "CAST(sum(strlen(o_orderpriority)) + count(*) - 1 AS BIGINT)")})
grouped("a14_regr", L, "l_returnflag", {n: ((lambda n=n: F.round(A.REGRESSION[n]("l_extendedprice", "l_quantity"), 2)), f"round({n}(l_extendedprice, l_quantity), 2)") for n in A.REGRESSION if n != "regr_count"} | {"regr_count": (lambda: BIG(A.REGRESSION["regr_count"]("l_extendedprice", "l_quantity")), "CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT)")})
grouped("a15_json_agg_strict", C, "c_nationkey", {"items": (lambda: in_order(F.from_json(A.json_agg_strict(F.nullif("c_mktsegment", lit("BUILDING"))), "array<string>")), "coalesce(string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) FILTER (WHERE c_mktsegment <> 'BUILDING'), '')"), "n": (lambda: BIG(F.json_array_length(A.json_agg_strict(F.nullif("c_mktsegment", lit("BUILDING"))))), "count(*) FILTER (WHERE c_mktsegment <> 'BUILDING')")})
grouped("a16_percentile_cont", L, "l_returnflag", {"q1": (lambda: F.round(A.percentile_cont("l_quantity", 0.25), 6), "round(quantile_cont(l_quantity, 0.25), 6)"), "q9": (lambda: F.round(A.percentile_cont("l_extendedprice", 0.9), 4), "round(quantile_cont(l_extendedprice, 0.9), 4)")})
grouped("a17_percentile_cont_desc", L, "l_returnflag", {"q1": (lambda: F.round(A.quantile("l_quantity", 0.1, descending=True), 6), "round(percentile_cont(0.1) WITHIN GROUP (ORDER BY l_quantity DESC), 6)")})
grouped("a18_median", L, "l_returnflag", {"m": (lambda: A.quantile("l_extendedprice"), "median(l_extendedprice)")})
grouped("a19_quantile", L, "l_linestatus", {"m": (lambda: F.round(A.quantile("l_extendedprice", 0.99), 4), "round(quantile_cont(l_extendedprice, 0.99), 4)")})
at = lambda x, p: f"list_sort(list({x}))[CAST(least(floor({p} * count({x})) + 1, count({x})) AS BIGINT)]"
grouped("a20_quantile_exact", L, "l_returnflag, l_linestatus", {"m": (lambda: A.quantile_exact("l_quantity", 0.75), at("l_quantity", 0.75)), "i": (lambda: A.quantile_exact("l_linenumber", 0.5, "int"), at("l_linenumber", 0.5)), "d": (lambda: A.quantile_exact(col("l_shipdate").cast("date"), 0.3, "date"), at("CAST(l_shipdate AS DATE)", 0.3)), "top": (lambda: A.quantile_exact("l_quantity", 1.0, where=col("l_tax") > 0.04), "max(l_quantity) FILTER (WHERE l_tax > 0.04)")})
grouped("a20_percentile_disc", L, "l_returnflag", {"m": (lambda: A.percentile_disc("l_quantity", 0.75), "quantile_disc(l_quantity, 0.75)"), "i": (lambda: A.percentile_disc("l_linenumber", 0.5).cast("int"), "quantile_disc(l_linenumber, 0.5)")})
grouped("a21_arg_min", O, "o_custkey", {"r": (lambda: A.arg_min("o_orderkey", F.struct("o_totalprice", "o_orderkey")), "arg_min(o_orderkey, (o_totalprice, o_orderkey))")})
grouped("a22_arg_max", O, "o_custkey", {"r": (lambda: A.arg_max("o_orderkey", F.struct("o_totalprice", "o_orderkey")), "arg_max(o_orderkey, (o_totalprice, o_orderkey))")})
beside_exact("a23_uniq", ("l_linenumber", "l_linestatus"), A.uniq, lambda sketch, exact: F.abs(sketch - exact) <= 1)
grouped("a24_uniq_exact", L, "l_returnflag", {"one": (lambda: A.uniq_exact("l_partkey"), "count(DISTINCT l_partkey)"), "two": (lambda: A.uniq_exact("l_suppkey", "l_linenumber"), "count(DISTINCT (l_suppkey, l_linenumber))")})
beside_exact("a25_uniq_combined", ("l_partkey",), A.uniq_combined, within(0.05))
beside_exact("a26_uniq_combined64", ("l_orderkey",), A.uniq_combined64, within(0.05))
beside_exact("a27_uniq_hll12", ("l_partkey",), A.uniq_hll12, within(0.1))
beside_exact("a28_uniq_theta", ("l_partkey",), A.uniq_theta, within(0.1))
grouped("a29_custom_aggregates", E, "event_type", {"most": (lambda: A.arg_max("event_id", F.struct("value", "event_id")), "arg_max(event_id, (value, event_id))"), "users": (lambda: A.uniq_exact("user_id"), "count(DISTINCT user_id)")})


@query("a30_merge_states", "SELECT event_type, round(sum(value), 2) AS total, count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a30(spark, sf_dir):
    daily = table(spark, sf_dir, E).groupBy("event_type", F.to_date("ts").alias("day")).agg(S.state("sum").write("value").alias("s"), S.state("count").write().alias("c"), S.state("avg").write("value").alias("a"), S.state("uniqExact").write("user_id").alias("u"))
    return daily.groupBy("event_type").agg(F.round(S.merged("sum", "s"), 2).alias("total"), S.merged("count", "c").alias("n"), F.round(S.merged("avg", "a"), 6).alias("mean"), S.merged("uniqExact", "u").alias("users"))


@query("a30_merge_sketches", "SELECT event_type, true AS hll, true AS theta, true AS q FROM events GROUP BY event_type")
def a30_sketches(spark, sf_dir):
    events = table(spark, sf_dir, E)
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(S.state("uniq").write("user_id").alias("h"), S.state("uniqTheta").write("user_id").alias("t"), S.state("quantile").write("value").alias("q"))
    merged = daily.groupBy("event_type").agg(S.merged("uniq", "h").alias("h"), S.merged("uniqTheta", "t").alias("t"), S.merged("quantile", "q", 0.5).alias("q"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"), F.percentile("value", lit([0.45, 0.55])).alias("p"))
    near = lambda c: F.abs(c / col("n") - 1) < 0.1
    return merged.join(exact, "event_type").select("event_type", near(col("h")).alias("hll"), near(col("t")).alias("theta"), col("q").between(col("p")[0], col("p")[1]).alias("q"))


@query("a31_simple_states", "SELECT event_type, max(value) AS most, min(ts) AS first FROM events GROUP BY event_type")
def a31(spark, sf_dir):
    daily = table(spark, sf_dir, E).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("m"), F.min("ts").alias("f"))
    return daily.groupBy("event_type").agg(S.merged("max", "m").alias("most"), S.merged("min", "f").alias("first"))


@query("a32_sum_map", "SELECT o_custkey, o_orderstatus AS k, count(*) AS v FROM orders GROUP BY ALL")
def a32(spark, sf_dir):
    maps = table(spark, sf_dir, O).select("o_custkey", F.array("o_orderstatus", lit("all")).alias("ks"), F.array(lit(1).cast("long"), lit(1).cast("long")).alias("vs"))
    return S.sum_map(maps, ["o_custkey"], "ks", "vs").select("o_custkey", F.explode("sums").alias("k", "v")).where("k != 'all'")


SIGN = "CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END"


def _signed():
    return Collapsing(F.when(col("l_orderkey") % 3 == 0, -1).otherwise(1))


grouped("a33_collapsing_sum", L, "l_returnflag", {"r": (lambda: F.round(_signed().sum("l_quantity"), 2), f"round(sum(l_quantity * ({SIGN})), 2)")})
grouped("a34_collapsing_count", L, "l_returnflag", {"r": (lambda: _signed().count(), f"CAST(sum({SIGN}) AS BIGINT)"), "x": (lambda: _signed().count(F.nullif("l_linenumber", lit(1))), f"CAST(sum({SIGN}) FILTER (WHERE l_linenumber <> 1) AS BIGINT)")})
grouped("a35_collapsing_avg", L, "l_returnflag", {"r": (lambda: F.round(_signed().avg("l_quantity"), 6), f"round(sum(l_quantity * ({SIGN})) / sum({SIGN}), 6)")})

# W: windows over a customer's orders
by_date = lambda: Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
by_price = lambda: Window.partitionBy("o_orderstatus").orderBy("o_orderpriority")
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
PEERS = "OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)"
framed("w01_row_number", O, "o_orderkey", {"r": (lambda: BIG(F.row_number().over(by_date())), f"row_number() {OVER}")})
framed("w02_rank", O, "o_orderkey", {"r": (lambda: BIG(F.rank().over(by_price())), f"rank() {PEERS}")})
framed("w03_dense_rank", O, "o_orderkey", {"r": (lambda: BIG(F.dense_rank().over(by_price())), f"dense_rank() {PEERS}")})
framed("w04_percent_rank", O, "o_orderkey", {"r": (lambda: F.round(F.percent_rank().over(by_price()), 9), f"round(percent_rank() {PEERS}, 9)")})
framed("w05_cume_dist", O, "o_orderkey", {"r": (lambda: F.round(F.cume_dist().over(by_price()), 9), f"round(cume_dist() {PEERS}, 9)")})
framed("w06_ntile", O, "o_orderkey", {"r": (lambda: BIG(F.ntile(4).over(by_date())), f"ntile(4) {OVER}")})
framed("w07_lead", O, "o_orderkey", {"a": (lambda: F.lead("o_orderkey").over(by_date()), f"lead(o_orderkey) {OVER}"), "b": (lambda: F.lead("o_orderkey", 2, -1).over(by_date()), f"lead(o_orderkey, 2, -1) {OVER}")})
framed("w08_lag", O, "o_orderkey", {"a": (lambda: F.lag("o_orderkey").over(by_date()), f"lag(o_orderkey) {OVER}"), "b": (lambda: F.lag("o_orderkey", 2, -1).over(by_date()), f"lag(o_orderkey, 2, -1) {OVER}")})
framed("w09_first_last_nth", O, "o_orderkey", {"f": (lambda: F.first_value("o_orderkey").over(by_date()), f"first_value(o_orderkey) {OVER}"), "l": (lambda: F.last_value("o_orderkey").over(by_date()), f"last_value(o_orderkey) {OVER}"), "n": (lambda: F.nth_value("o_orderkey", 2).over(by_date()), f"nth_value(o_orderkey, 2) {OVER}")})
framed("w10_min_max", O, "o_orderkey", {"a": (lambda: F.min("o_totalprice").over(by_date()), f"min(o_totalprice) {OVER}"), "b": (lambda: F.max("o_totalprice").over(Window.partitionBy("o_custkey")), "max(o_totalprice) OVER (PARTITION BY o_custkey)")})
framed("w11_aggregates", O, "o_orderkey", {"s": (lambda: F.round(F.sum("o_totalprice").over(by_date()), 2), f"round(sum(o_totalprice) {OVER}, 2)"), "a": (lambda: F.round(F.avg("o_totalprice").over(by_date()), 4), f"round(avg(o_totalprice) {OVER}, 4)"), "n": (lambda: F.count("*").over(by_date()), f"count(*) {OVER}")})
framed("w12_order_nulls", O, "o_orderkey", {"r": (lambda: BIG(F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.nullif("o_orderstatus", lit("P")).desc_nulls_first(), "o_orderkey"))), "row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'P') DESC NULLS FIRST, o_orderkey)")})
framed("w13_rows_frame", O, "o_orderkey", {"s": (lambda: F.round(F.sum("o_totalprice").over(by_date().rowsBetween(-2, 1)), 2), "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2)")})
framed("w14_range_frame", O, "o_orderkey", {"n": (lambda: F.count("*").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-1000, 1000)), "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING)")})
both("w14_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS n FROM {orders}")


@query("w15_groups_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
def w15(spark, sf_dir):
    return rel.groups_frame(table(spark, sf_dir, O), ["o_custkey"], [col("o_orderpriority")], -1, 1, {"n": F.count("*")}).select("o_orderkey", "n")


framed("w16_ranking_without_frame", O, "o_orderkey", {"r": (lambda: BIG(F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))), "rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")})
framed("w17_filter_in_window", O, "o_orderkey", {"s": (lambda: F.count(F.when(col("o_orderstatus") == "F", 1)).over(by_date()), f"count(*) FILTER (WHERE o_orderstatus = 'F') {OVER}")})
both("w18_window_sort_limit", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders} ORDER BY r DESC, o_orderkey LIMIT 50")


@query("w19_exclude_current", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS n FROM orders")
def w19(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, O).select("o_orderkey", (F.count("*").over(w.rowsBetween(-2, -1)) + F.count("*").over(w.rowsBetween(1, 2))).alias("n"))
