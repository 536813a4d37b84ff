"""Every kind of join."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.data import table
from vellumine.operators import joins
from vellumine.plans.suite import Suite

suite = Suite()

suite.both("join_inner", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING'")
suite.both("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
suite.both("join_right", "SELECT o.o_orderkey, c.c_custkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey")
suite.both("join_full", "SELECT a.c_custkey AS a, b.s_suppkey AS b FROM (SELECT c_custkey FROM customer) a FULL JOIN (SELECT s_suppkey FROM supplier) b ON a.c_custkey = b.s_suppkey")
suite.texts("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
suite.texts("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
suite.both("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
suite.both("join_using", "SELECT n_nationkey, n_name, s_suppkey FROM nation JOIN (SELECT s_suppkey, s_nationkey AS n_nationkey FROM supplier) s USING (n_nationkey)")
suite.both("join_natural", "SELECT n_nationkey, n_name, c_custkey FROM nation NATURAL JOIN (SELECT c_custkey, c_nationkey AS n_nationkey FROM customer) c")
suite.both("join_lateral", "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
suite.both("join_lateral_left", "SELECT c.c_custkey, t.total FROM customer c LEFT JOIN LATERAL (SELECT round(sum(o_totalprice), 2) AS total FROM orders o WHERE o.o_custkey = c.c_custkey) t ON true")
suite.both("join_theta_residual", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(a.o_orderkey) AS BIGINT) AS s FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_totalprice < b.o_totalprice AND a.o_orderdate > b.o_orderdate")
suite.both("join_null_keys", "SELECT a.x, b.y FROM (VALUES (1, 'a'), (NULL, 'b'), (2, 'c')) a(k, x) LEFT JOIN (VALUES (1, 'p'), (1, 'q'), (NULL, 'r')) b(k, y) ON a.k = b.k")
suite.both("join_null_safe", "SELECT a.x, b.y FROM (VALUES (1, 'a'), (NULL, 'b'), (2, 'c')) a(k, x) JOIN (VALUES (1, 'p'), (NULL, 'r')) b(k, y) ON a.k IS NOT DISTINCT FROM b.k")
suite.both("join_multi_way", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name")


@suite.add("join_asof", "SELECT e.event_id, p.value AS last_purchase, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof(spark, folder):
    events = table(spark, folder, "events")
    right = events.where("event_type = 'purchase'").selectExpr("user_id", "ts AS pts", "event_id AS purchase_id", "value AS last_purchase")
    left = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return joins.asof(left, right, ["user_id"], "ts", "pts", ["purchase_id", "last_purchase"]).select("event_id", "last_purchase", "purchase_id")


@suite.add("join_positional", "SELECT a.n_name, b.r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation) a FULL JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name DESC) AS i FROM region) b USING (i)")
def positional(spark, folder):
    return joins.positional(table(spark, folder, "nation").select("n_name"), [F.asc("n_name")], table(spark, folder, "region").select("r_name"), [F.desc("r_name")])


@suite.add("join_range", "SELECT c.c_custkey, b.lo FROM customer c JOIN (SELECT CAST(range AS DOUBLE) * 700 - 1000 AS lo, CAST(range AS DOUBLE) * 700 - 200 AS hi FROM range(0, 17)) b ON c.c_acctbal BETWEEN b.lo AND b.hi")
def range_join(spark, folder):
    bands = spark.range(0, 17).selectExpr("CAST(id AS DOUBLE) * 700 - 1000 AS lo", "CAST(id AS DOUBLE) * 700 - 200 AS hi")
    return joins.range_join(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", bands, "lo", "hi", 800.0).select("c_custkey", "lo")


@suite.add("join_mark", "SELECT n_nationkey, n_nationkey IN (SELECT CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey END FROM supplier WHERE s_acctbal > 7000) AS m FROM nation")
def mark(spark, folder):
    keys = table(spark, folder, "supplier").where("s_acctbal > 7000").selectExpr("CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey END AS k")
    return joins.mark(table(spark, folder, "nation").select("n_nationkey"), keys, "n_nationkey", "k", "m")


@suite.add("join_nearest", "SELECT c_custkey, s_suppkey FROM (SELECT c.c_custkey, s.s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_acctbal, s_suppkey) AS r FROM customer c JOIN supplier s ON c_nationkey = s_nationkey) WHERE r = 1")
def nearest(spark, folder):
    c = table(spark, folder, "customer").selectExpr("c_custkey", "c_nationkey AS k", "c_acctbal")
    s = table(spark, folder, "supplier").selectExpr("s_suppkey", "s_nationkey AS k", "s_acctbal")
    return joins.nearest(c, "c_acctbal", s, "s_acctbal", ["k"], ["s_suppkey"]).where("s_suppkey IS NOT NULL").select("c_custkey", "s_suppkey")
