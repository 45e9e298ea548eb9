"""Pass-through SQL: the relational operators a user reaches by query text."""

from __future__ import annotations

from tablewright.suite.registry import sql_query

sql_query("sql_inner_join", """
SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority, o.o_custkey, l.l_quantity, l.l_extendedprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")

sql_query("sql_filter", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'""")

sql_query("sql_group_avg", """
SELECT c.c_mktsegment, count(*) AS orders, round(avg(o.o_totalprice), 2) AS avg_price, max(o.o_totalprice) AS max_price
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""")

sql_query("sql_left_join", """
SELECT c.c_custkey, c.c_mktsegment, count(o.o_orderkey) AS orders
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'
GROUP BY c.c_custkey, c.c_mktsegment""")

sql_query("sql_full_join", """
SELECT p.p_type, s.s_nationkey, p.n AS parts, s.n AS suppliers
FROM (SELECT p_type, p_size % 25 AS k, count(*) AS n FROM part GROUP BY 1, 2) p
FULL OUTER JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON p.k = s.s_nationkey""")

sql_query("sql_semi_join", """
SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)""")

sql_query("sql_anti_join", """
SELECT d.doc_id, d.lang, d.source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")

sql_query("sql_union", """
SELECT c_nationkey AS nationkey, 'customer' AS side, c_acctbal AS acctbal FROM customer
UNION ALL SELECT s_nationkey, 'supplier', s_acctbal FROM supplier""")

sql_query("sql_union_distinct", """
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier""")

sql_query("sql_intersect", """
SELECT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'R'
INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'""")

sql_query("sql_except", """
SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")

sql_query("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")

sql_query("sql_topk", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")

sql_query("sql_subquery", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")

sql_query("sql_having", """
SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) >= 15""")

sql_query("sql_window_rank", """
SELECT o_orderkey, o_custkey,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
       rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS priority_rank,
       lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_price
FROM orders""")

sql_query("sql_grouping_sets", """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")

sql_query("sql_rollup", """
SELECT n.n_regionkey, c.c_mktsegment, count(*) AS customers
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ROLLUP (n.n_regionkey, c.c_mktsegment)""")

sql_query("sql_scalar_functions", """
SELECT p_partkey, upper(p_name) AS name, length(p_brand) AS brand_length, coalesce(nullif(p_type, 'SMALL'), 'other') AS kind,
       abs(p_size - 25) AS distance, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class
FROM part""")

sql_query("sql_date_functions", """
SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS orders, min(o_totalprice) AS cheapest
FROM orders GROUP BY 1, 2""")
