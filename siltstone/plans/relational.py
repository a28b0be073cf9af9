"""Projection and predicates (P), joins (J), grouping (G), sorts, limits and set operations (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as Y
from ..functions import maths as M
from ..operators import relational as rel
from .common import both, col, grouped, lit, run_sql, scalar, table
from .registry import query

C, L, O, E, P = "customer", "lineitem", "orders", "events", "part"

# P: projection, filter, predicates, expressions
both("p01_columns", "SELECT c_custkey, c_name FROM {customer}")
both("p02_where", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > 200000 AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'")
scalar("p03_logic", C, "c_custkey", lambda: ((col("c_acctbal") > 0) & (col("c_nationkey") < 10)) | ~(col("c_mktsegment") == "BUILDING"), "((c_acctbal > 0 AND c_nationkey < 10) OR NOT c_mktsegment = 'BUILDING')")
both("p04_comparison", "SELECT c_custkey, c_nationkey = 3 AS eq, c_nationkey <> 3 AS ne, c_nationkey < 3 AS lt, c_nationkey <= 3 AS le, c_nationkey > 3 AS gt, c_nationkey >= 3 AS ge FROM {customer}")
both("p05_arithmetic", "SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS a, l_orderkey - 7 AS s, l_linenumber * 3 AS m, l_orderkey % 5 AS r, -l_linenumber AS n FROM {lineitem}")
scalar("p06_integer_division", L, "l_orderkey, l_linenumber", lambda: M.div(col("l_orderkey") - 5000, lit(7)), "CAST(trunc((l_orderkey - 5000) / 7.0) AS BIGINT)")
scalar("p06_integer_division_large", L, "l_orderkey, l_linenumber", lambda: M.div(col("l_orderkey") + lit(9007199254740993), lit(3)) - M.div(lit(-9223372036854775807) + col("l_orderkey"), lit(2)), "CAST((l_orderkey + 9007199254740993) // 3 + (9223372036854775807 - l_orderkey) // 2 AS BIGINT)")
both("p07_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS result FROM {customer}")
both("p08_like", "SELECT c_custkey, c_mktsegment LIKE 'B%' AS a, c_mktsegment NOT LIKE '%I_D%' AS b, c_mktsegment ILIKE 'mach%' AS c, c_mktsegment NOT ILIKE '%hold' AS d FROM {customer}")
both("p09_is_null", "SELECT c_custkey, o_orderkey IS NULL AS missing, o_orderkey IS NOT NULL AS there FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'P'")
both("p10_is_distinct_from", "SELECT c_custkey, nullif(c_nationkey, 3) IS DISTINCT FROM nullif(c_nationkey % 5, 3) AS result FROM {customer}")
both("p11_nullif", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS result FROM {customer}")
both("p12_coalesce", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS result FROM {customer}")
both("p13_greatest_least", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_discount * 100, NULL) AS g, least(l_quantity, l_discount * 100) AS l FROM {lineitem}")
both("p14_case", "SELECT c_custkey, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS simple, CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal < 1000 THEN 0 ELSE 1 END AS searched FROM {customer}")
both("p15_in_list", "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (1, 2, 3) OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE')")
both("p15_not_in_null", "SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (1, NULL)")
scalar("p16_any", C, "c_custkey", lambda: Y.any_equal(col("c_nationkey"), F.array(lit(1), lit(5), lit(9))), "list_contains([1, 5, 9], c_nationkey)")
scalar("p17_all", C, "c_custkey", lambda: Y.all_differ(col("c_nationkey"), F.array(lit(1), lit(5))) & ~Y.all_equal(col("c_nationkey"), F.array(lit(7), lit(7))), "(NOT list_contains([1, 5], c_nationkey) AND c_nationkey <> 7)")
scalar("p18_any_all_compare", C, "c_custkey", lambda: F.exists(F.array(lit(3), lit(20)), lambda x: col("c_nationkey") > x) & F.forall(F.array(lit(23), lit(24)), lambda x: col("c_nationkey") < x), "(c_nationkey > 3 AND c_nationkey < 23)")
both("p19_cast", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS d, CAST(o_orderkey AS INT) AS i, CAST(o_orderdate AS DATE) AS day FROM {orders}")
both("p20_text_cast", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS t, CAST(CAST(o_orderkey AS STRING) AS BIGINT) AS back FROM {orders}")
both(
    "p21_constants",
    "SELECT r_regionkey, 1 AS i, 2.5 AS d, TRUE AS b, 'it''s' AS s, DATE '2026-01-31' AS day, TIMESTAMP_NTZ '2026-01-31 10:11:12.345' AS ts FROM {region}",
    "SELECT r_regionkey, 1 AS i, 2.5 AS d, TRUE AS b, 'it''s' AS s, DATE '2026-01-31' AS day, TIMESTAMP '2026-01-31 10:11:12.345' AS ts FROM region",
)
scalar("p22_array_constructor", C, "c_custkey", lambda: F.concat(F.array("c_nationkey", lit(7)), F.array().cast("array<int>")), "[c_nationkey, 7]")
both("p23_row_constructor", "SELECT o_orderkey FROM {orders} WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'))")


@query("p24_bind_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 50000")
def p24(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = :status AND o_totalprice BETWEEN :low AND :high", {"status": "O", "low": 1000, "high": 50000})


scalar("p25_subscript", "embeddings", "vec_id", lambda: Y.subscript("embedding", 3), "embedding[3]")
scalar("p25_subscript_outside", "embeddings", "vec_id", lambda: Y.subscript("embedding", 1000), "embedding[1000]")
scalar("p26_slice", "embeddings", "vec_id", lambda: F.concat(Y.slice_("embedding", 2, 4), Y.slice_("embedding", 63, None), Y.slice_("embedding", None, 1)), "list_concat(list_concat(embedding[2:4], embedding[63:]), embedding[:1])")


@query("p27_session_values")
def p27(spark, sf_dir):
    return spark.sql("SELECT current_user() AS current_user, session_user() AS session_user, current_schema() AS current_schema, current_database() AS current_database, current_catalog() AS current_catalog")


# J: joins
both("j01_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_nationkey = 7")
both("j02_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000")
both("j03_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM {orders} WHERE o_totalprice > 300000) o RIGHT JOIN {customer} ON c_custkey = o_custkey")
both("j04_full", "SELECT s.s_suppkey AS s, c.c_custkey AS c FROM (SELECT * FROM {supplier} WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM {customer} WHERE c_acctbal < 5000 AND c_mktsegment = 'BUILDING') c ON s.s_suppkey = c.c_custkey")


@query("j05_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j05(spark, sf_dir):
    c, o = table(spark, sf_dir, C), table(spark, sf_dir, O).where("o_orderstatus = 'P'")
    return rel.semi(c, o, c.c_custkey == o.o_custkey).select("c_custkey", "c_name")


@query("j06_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j06(spark, sf_dir):
    c, o = table(spark, sf_dir, C), table(spark, sf_dir, O).where("o_orderstatus = 'P'")
    return rel.anti(c, o, c.c_custkey == o.o_custkey).select("c_custkey", "c_name")


both("j07_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
both("j08_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("j08_non_equi", "SELECT s_suppkey, n_nationkey FROM {supplier} JOIN {nation} ON s_acctbal > 400 * n_nationkey AND s_nationkey <> n_nationkey")
both("j09_self_n_way", "SELECT a.n_name AS x, b.n_name AS y, r_name FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey JOIN {region} ON r_regionkey = a.n_regionkey JOIN {supplier} ON s_nationkey = b.n_nationkey WHERE a.n_nationkey < 5")


@query("j10_across_sources", "SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def j10(spark, sf_dir):
    # one side from files, the other one built in the session
    names = {r.n_nationkey: r.n_name for r in table(spark, sf_dir, "nation").collect()}  # 25 rows
    local = spark.createDataFrame(list(names.items()), "n_nationkey int, n_name string")
    return table(spark, sf_dir, C).join(local, col("c_nationkey") == col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


both("j11_uncorrelated_exists", "SELECT r_name FROM {region} WHERE EXISTS (SELECT 1 FROM {customer} WHERE c_acctbal < 0)")
both("j12_correlated_scalar", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.8 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
both("j13_uncorrelated_scalar", "SELECT c_custkey FROM {customer} WHERE c_acctbal = (SELECT max(c_acctbal) FROM {customer})")


@query("j14_not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def j14(spark, sf_dir):
    return rel.not_in(table(spark, sf_dir, "supplier"), "s_suppkey", table(spark, sf_dir, L).where("l_quantity > 49"), "l_suppkey").select("s_suppkey")


@query("j14_not_in_with_null", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT nullif(l_suppkey, 3) FROM lineitem WHERE l_quantity > 49)")
def j14_null(spark, sf_dir):
    right = table(spark, sf_dir, L).where("l_quantity > 49").select(F.nullif("l_suppkey", lit(3).cast("long")).alias("x"))
    return rel.not_in(table(spark, sf_dir, "supplier"), "s_suppkey", right, "x").select("s_suppkey")


both("j15_cte_join", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey) SELECT c_name, round(total, 2) AS total FROM {customer} JOIN big ON o_custkey = c_custkey WHERE total > 2000000")

# G: grouping
grouped("g01_group_by", O, "o_orderstatus, o_orderpriority", {"n": (lambda: F.count("*"), "count(*)"), "total": (lambda: F.round(F.sum("o_totalprice"), 2), "round(sum(o_totalprice), 2)")})
grouped("g02_scalar_aggregate", O, "", {"n": (lambda: F.count("*"), "count(*)"), "most": (lambda: F.max("o_totalprice"), "max(o_totalprice)")})
both("g03_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 14 AND max(o_totalprice) > 400000")
grouped("g04_distinct_aggregate", L, "l_returnflag", {"parts": (lambda: F.count_distinct("l_partkey"), "count(DISTINCT l_partkey)"), "total": (lambda: F.sum_distinct("l_linenumber"), "CAST(sum(DISTINCT l_linenumber) AS BIGINT)")})
both("g05_filter", "SELECT l_returnflag, sum(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS o, avg(l_linenumber) FILTER (WHERE l_quantity > 25) AS a FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS o, avg(l_linenumber) FILTER (WHERE l_quantity > 25) AS a FROM {lineitem} GROUP BY l_returnflag")
both("g06_distinct_and_filter", "SELECT l_returnflag, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 40) AS n FROM {lineitem} GROUP BY l_returnflag")
both("g07_count_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 40) AS n FROM {lineitem} GROUP BY l_returnflag")
both("g08_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("g08_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("g08_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("g09_group_by_constant", "SELECT 1 AS k, count(*) AS n FROM orders")
def g09(spark, sf_dir):
    return table(spark, sf_dir, O).groupBy(lit(1).alias("k")).agg(F.count("*").alias("n"))


grouped("g10_partial_aggregates", L, "l_suppkey", {"n": (lambda: F.count("*"), "count(*)"), "q": (lambda: F.sum("l_quantity"), "sum(l_quantity)"), "least": (lambda: F.min("l_shipdate"), "min(l_shipdate)")})


@query("g11_select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def g11(spark, sf_dir):
    return table(spark, sf_dir, L).select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


# O: sort, limit, set operations
@query("o01_order_nulls", "SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) ORDER BY k DESC NULLS FIRST, c_custkey LIMIT 100")
def o01(spark, sf_dir):
    df = table(spark, sf_dir, C).select("c_custkey", F.nullif("c_nationkey", lit(3)).alias("k"))
    return rel.top_k(df, 100, ("k", True), ("c_custkey", False))


both("o02_sort_of_groups", "SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 7")
both("o03_sort", "SELECT s_suppkey, s_acctbal FROM {supplier} ORDER BY s_acctbal DESC, s_suppkey")


@query("o04_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 50")
def o04(spark, sf_dir):
    return rel.top_k(table(spark, sf_dir, O).select("o_orderkey"), 20, ("o_orderkey", False), offset=50)


@query("o05_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o05(spark, sf_dir):
    return rel.top_k(table(spark, sf_dir, O).select("o_orderkey", "o_totalprice"), 10, ("o_totalprice", True), ("o_orderkey", False))


both("o06_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
both("o06_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
both("o07_intersect", "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT s_suppkey FROM {supplier}")
both("o07_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
both("o07_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
both("o07_except_all", "SELECT s_nationkey AS k FROM {supplier} EXCEPT ALL SELECT n_nationkey FROM {nation}")


@query("o08_set_returning", "SELECT vec_id, unnest(embedding[1:3]) AS x FROM embeddings")
def o08(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.slice("embedding", 1, 3)).alias("x"))
