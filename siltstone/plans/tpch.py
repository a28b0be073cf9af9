"""The TPC-H queries over our tables. There is no partsupp; a part's suppliers are those of its line items, with the
mean price as cost. Constants are those that occur in the data."""

from __future__ import annotations

from .common import both

PARTSUPP = """partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty,
         round(avg(l_extendedprice / l_quantity), 2) AS ps_supplycost
  FROM {lineitem} GROUP BY l_partkey, l_suppkey)"""
#: Money has four exact decimals here; added as decimals, sums do not depend on the order of rows.
REVENUE = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"

both(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS sum_base_price,
       CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc_price,
       CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,6))) AS DOUBLE) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc,
       count(*) AS count_order
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '2001-08-01 00:00:00'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
both(
    "tpch_q2",
    f"""WITH {PARTSUPP},
offers AS (
  SELECT ps_partkey, ps_supplycost, s_acctbal, s_name, n_name
  FROM partsupp JOIN {{supplier}} ON s_suppkey = ps_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey
  JOIN {{region}} ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, p_partkey, p_type
FROM {{part}} JOIN offers o ON p_partkey = o.ps_partkey
WHERE p_size = 15 AND p_type LIKE '%MO%'
  AND o.ps_supplycost = (SELECT min(i.ps_supplycost) FROM offers i WHERE i.ps_partkey = p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
)
both(
    "tpch_q3",
    f"""SELECT l_orderkey, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, o_orderdate
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
both(
    "tpch_q4",
    """SELECT o_orderpriority, count(*) AS order_count FROM {orders}
WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
)
both(
    "tpch_q5",
    f"""SELECT n_name, CAST(sum({REVENUE}) AS DOUBLE) AS revenue
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
JOIN {{supplier}} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {{nation}} ON s_nationkey = n_nationkey
JOIN {{region}} ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
GROUP BY n_name ORDER BY revenue DESC""",
)
both(
    "tpch_q6",
    """SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM {lineitem}
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
  AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
)
both(
    "tpch_q7",
    f"""SELECT supp_nation, cust_nation, l_year, CAST(sum(volume) AS DOUBLE) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS volume
  FROM {{supplier}} JOIN {{lineitem}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey
  JOIN {{customer}} ON c_custkey = o_custkey JOIN {{nation}} n1 ON s_nationkey = n1.n_nationkey JOIN {{nation}} n2 ON c_nationkey = n2.n_nationkey
  WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
    AND l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
)
both(
    "tpch_q8",
    f"""SELECT o_year, round(CAST(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) AS DOUBLE) / CAST(sum(volume) AS DOUBLE), 6) AS mkt_share FROM (
  SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
  FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey
  JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
  JOIN {{nation}} n1 ON c_nationkey = n1.n_nationkey JOIN {{region}} ON n1.n_regionkey = r_regionkey JOIN {{nation}} n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = 'AMERICA' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1998-12-31 00:00:00' AND p_type = 'ECONOMY') all_nations
GROUP BY o_year ORDER BY o_year""",
)
both(
    "tpch_q9",
    f"""SELECT nation, o_year, CAST(sum(amount) AS DOUBLE) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS amount
  FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey
  JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{nation}} ON s_nationkey = n_nationkey
  WHERE p_name LIKE '%blue%') profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
)
both(
    "tpch_q10",
    f"""SELECT c_custkey, c_name, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, c_acctbal, n_name
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{nation}} ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
both(
    "tpch_q11",
    f"""WITH {PARTSUPP},
held AS (
  SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS value
  FROM partsupp JOIN {{supplier}} ON ps_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey
  WHERE n_name = 'NATION_7' GROUP BY ps_partkey)
SELECT ps_partkey, value FROM held WHERE value > (SELECT sum(value) * 0.005 FROM held) ORDER BY value DESC, ps_partkey""",
)
both(
    "tpch_q12",
    """SELECT l_linestatus, count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS high_line_count,
       count(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 END) AS low_line_count
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_returnflag IN ('A', 'R')
GROUP BY l_linestatus ORDER BY l_linestatus""",
)
both(
    "tpch_q13",
    """SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT'
  GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
)
both(
    "tpch_q14",
    f"""SELECT round(CAST(100 AS DOUBLE) * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) AS DOUBLE) / CAST(sum({REVENUE}) AS DOUBLE), 6) AS promo_revenue
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'""",
)
both(
    "tpch_q15",
    f"""WITH revenue AS (
  SELECT l_suppkey AS supplier_no, CAST(sum({REVENUE}) AS DOUBLE) AS total_revenue FROM {{lineitem}}
  WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {{supplier}} JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
)
both(
    "tpch_q16",
    f"""WITH {PARTSUPP}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt
FROM partsupp JOIN {{part}} ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM {{supplier}} WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
)
both(
    "tpch_q17",
    """SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / 7.0, 4) AS avg_yearly FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * avg(i.l_quantity) FROM {lineitem} i WHERE i.l_partkey = p_partkey)""",
)
both(
    "tpch_q18",
    """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS quantity
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
)
both(
    "tpch_q19",
    f"""SELECT CAST(sum({REVENUE}) AS DOUBLE) AS revenue FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
   OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""",
)
both(
    "tpch_q20",
    f"""WITH {PARTSUPP}
SELECT s_name, s_acctbal FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
WHERE n_name = 'NATION_3' AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM {{part}} WHERE p_name LIKE 'red%')
    AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM {{lineitem}}
      WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'))
ORDER BY s_name""",
)
both(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait
FROM {supplier} JOIN {lineitem} l1 ON s_suppkey = l1.l_suppkey JOIN {orders} ON o_orderkey = l1.l_orderkey JOIN {nation} ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND n_name = 'NATION_5'
  AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
)
both(
    "tpch_q22",
    """SELECT c_nationkey, count(*) AS numcust, CAST(sum(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) AS totacctbal FROM {customer}
WHERE c_nationkey IN (13, 1, 23, 9, 3, 18, 17)
  AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0 AND c_nationkey IN (13, 1, 23, 9, 3, 18, 17))
  AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
GROUP BY c_nationkey ORDER BY c_nationkey""",
)
