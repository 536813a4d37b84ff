"""Correlated, quantified and nested subqueries."""

from __future__ import annotations

from vellumine.plans.suite import Suite

suite = Suite()

suite.both("sub_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
suite.both("sub_correlated_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.4 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
suite.both("sub_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS n FROM customer")
suite.both("sub_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity = 50 AND l.l_discount = 0.1)")
suite.both("sub_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
suite.both("sub_exists_or", "SELECT c_custkey FROM customer c WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
suite.both("sub_in", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
suite.both("sub_not_in_nulls", "SELECT x FROM (VALUES (1), (2), (NULL)) t(x) WHERE x NOT IN (SELECT y FROM (VALUES (2), (NULL)) u(y))")
suite.both("sub_not_in_empty", "SELECT x FROM (VALUES (1), (NULL)) t(x) WHERE x NOT IN (SELECT y FROM (VALUES (2)) u(y) WHERE y > 5)")
suite.texts("sub_any", "SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM (SELECT s_nationkey * 60.0D AS v FROM supplier WHERE s_acctbal > 9000) s WHERE p.p_retailprice < s.v)", "SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT s_nationkey * 60.0 FROM supplier WHERE s_acctbal > 9000)")
suite.texts("sub_all", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_size AS v FROM part WHERE p_brand = 'Brand#11') s WHERE NOT (p.p_size >= s.v) OR s.v IS NULL OR p.p_size IS NULL)", "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part WHERE p_brand = 'Brand#11')")
suite.both("sub_order_limit", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer")
suite.both("sub_two_levels", "SELECT n_name FROM nation n WHERE (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)) > 20")
suite.both("sub_from", "SELECT avg_price, count(*) AS n FROM (SELECT o_custkey, round(avg(o_totalprice), -4) AS avg_price FROM orders GROUP BY o_custkey) t GROUP BY avg_price")
suite.both("sub_select_alias_group", "SELECT o_orderkey % 7 AS k, count(*) AS n FROM orders GROUP BY k HAVING n > 10")
