"""Scans, filters, projections, sorts, limits, distinct, set operations, recursion, pivots, statements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumine.data import run_sql, table
from vellumine.operators import limits, recursive, tables
from vellumine.operators.limits import Key
from vellumine.plans.suite import Suite

suite = Suite()

suite.both("rel_filter_project", "SELECT o_orderkey, o_totalprice * 2 AS doubled, o_orderstatus FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'F'")
suite.both("rel_values", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'ç')) AS t(x, y)")
suite.both("rel_dummy", "SELECT 1 AS one, 'x' AS x")
suite.both("rel_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
suite.both("rel_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 37")
suite.both("rel_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
suite.both("rel_case_between_in", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 'mid' WHEN l_quantity < 10 THEN 'low' ELSE 'high' END AS band FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity NOT BETWEEN 30 AND 40")
suite.both("rel_order_nulls", "SELECT x, row_number() OVER (ORDER BY x ASC NULLS LAST) AS asc_place, row_number() OVER (ORDER BY x DESC NULLS FIRST) AS desc_place FROM (VALUES (3), (NULL), (1), (2)) t(x)".replace("row_number()", "CAST(row_number()").replace("LAST)", "LAST) AS INT)").replace("FIRST)", "FIRST) AS INT)"))
suite.both("rel_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM big GROUP BY o_custkey) SELECT * FROM per WHERE n > 1")
suite.both("rel_set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
suite.both("rel_set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
suite.both("rel_set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
suite.both("rel_set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
suite.both("rel_set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
suite.both("rel_set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
suite.both("rel_recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
suite.both("rel_group_by_all", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
suite.both("rel_having", "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550 AND avg(l_discount) > 0.04")


@suite.add("rel_limit_percent", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7 PERCENT")
def limit_percent(spark, folder):
    return limits.limit_percent(table(spark, folder, "customer"), 7, F.desc("c_acctbal"), F.asc("c_custkey")).select("c_custkey")


@suite.add("rel_limit_ties", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def limit_ties(spark, folder):
    return limits.limit_ties(table(spark, folder, "part").select("p_partkey", "p_size"), 10, Key("p_size", descending=True))


@suite.add("rel_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, folder):
    return limits.distinct_on(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@suite.add("rel_sample_rows", "SELECT * FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def sample_rows(spark, folder):
    return limits.sample_rows(table(spark, folder, "orders"), 100, 42, "o_orderkey")


@suite.add("rel_sample_share", "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5('7:' || o_orderkey), 1, 13) AS BIGINT) < 0.2 * 4503599627370496")
def sample_share(spark, folder):
    return limits.sample_share(table(spark, folder, "orders"), 20, 7, "o_orderkey").select("o_orderkey")


@suite.add("rel_union_by_name_distinct", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION BY NAME SELECT c_nationkey AS k, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def union_by_name_distinct(spark, folder):
    n = table(spark, folder, "nation")
    seen = table(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("n_name AS name", "c_nationkey AS k")
    return tables.union_by_name(n.selectExpr("n_nationkey AS k", "n_name AS name"), seen, distinct=True)


@suite.add("rel_union_by_name", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, r_regionkey AS region FROM region")
def union_by_name(spark, folder):
    a = table(spark, folder, "nation").selectExpr("n_nationkey AS k", "n_name AS name")
    return tables.union_by_name(a, table(spark, folder, "region").selectExpr("r_name AS name", "r_regionkey AS region"))


@suite.add("rel_star_exclude_replace_rename", "SELECT * EXCLUDE (c_name) REPLACE (round(c_acctbal, 0) AS c_acctbal) RENAME (c_mktsegment AS segment) FROM customer")
def star(spark, folder):
    return tables.star(table(spark, folder, "customer"), exclude=("c_name",), replace={"c_acctbal": F.round("c_acctbal", 0)}, rename={"c_mktsegment": "segment"})


@suite.add("rel_columns_regex", "SELECT min(COLUMNS('.*key')) FROM supplier".replace("min(COLUMNS('.*key'))", "min(s_suppkey) AS s_suppkey, min(s_nationkey) AS s_nationkey"))
def columns_regex(spark, folder):
    df = table(spark, folder, "supplier")
    return df.agg(*tables.columns(df, "key$", F.min))


@suite.add("rel_pivot", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS \"F\", CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS \"O\", CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS \"P\" FROM orders GROUP BY o_orderpriority")
def pivot(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@suite.add("rel_unpivot", "SELECT c_custkey, name, value FROM (SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nation FROM customer) UNPIVOT (value FOR name IN (c_acctbal, c_nation))")
def unpivot(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nation"))
    return df.unpivot("c_custkey", ["c_acctbal", "c_nation"], "name", "value")


@suite.add("rel_recursive_union_distinct", "WITH RECURSIVE r(n) AS (SELECT 0 UNION SELECT (n * 3 + 1) % 50 FROM r) SELECT n FROM r")
def recursive_distinct(spark, folder):
    return recursive.union_distinct(spark.range(1).select(F.lit(0).alias("n")), lambda d: d.select(((F.col("n") * 3 + 1) % 50).alias("n")))


@suite.add("rel_recursive_using_key", "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 40 AS a, l_partkey % 40 AS b FROM lineitem), r(n, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.n WHERE r.d < 40) SELECT n, CAST(min(d) AS INT) AS d FROM r GROUP BY n")
def recursive_key(spark, folder):
    edges = table(spark, folder, "lineitem").selectExpr("l_suppkey % 40 AS a", "l_partkey % 40 AS b").distinct()
    anchor = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0).alias("d"))
    return recursive.using_key(anchor, ["n"], lambda changed, _: changed.join(edges, changed["n"] == edges["a"]).select(F.col("b").alias("n"), (F.col("d") + 1).alias("d")), "d")


@suite.add("rel_merge", """SELECT s.s_suppkey, CASE WHEN u.k IS NULL THEN s.s_acctbal ELSE round(s.s_acctbal + u.b, 2) END AS s_acctbal FROM supplier s LEFT JOIN (SELECT s_suppkey AS k, s_nationkey * 1.5 AS b FROM supplier WHERE s_suppkey % 3 = 0) u ON u.k = s.s_suppkey WHERE u.k IS NULL OR s.s_acctbal >= 0
    UNION ALL SELECT 1000000, 1.0""")
def merge(spark, folder):
    base = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    changes = table(spark, folder, "supplier").where("s_suppkey % 3 = 0").selectExpr("s_suppkey", "s_nationkey * 1.5D AS s_acctbal")
    changes = changes.unionByName(spark.range(1).select(F.lit(1000000).cast("long").alias("s_suppkey"), F.lit(1.0).alias("s_acctbal")))
    return tables.merge(base, changes, ["s_suppkey"], update={"s_acctbal": F.round(F.col("s_acctbal") + F.col("s_s_acctbal"), 2)}, delete=F.col("s_acctbal") < 0)


@suite.add("rel_summarize", "SELECT 'p_size' AS column_name, CAST(min(p_size) AS VARCHAR) AS min, CAST(max(p_size) AS VARCHAR) AS max, count(p_size) AS count, count(*) - count(p_size) AS nulls FROM part UNION ALL SELECT 'p_brand', min(p_brand), max(p_brand), count(p_brand), count(*) - count(p_brand) FROM part")
def summarize(spark, folder):
    return tables.summarize(table(spark, folder, "part").select("p_size", "p_brand"))


@suite.add("rel_recursive_key_aggregate", "WITH RECURSIVE r AS (SELECT n_nationkey AS k, n_regionkey AS v, 0 AS n FROM nation UNION ALL SELECT k, v + 1, n + 1 FROM r WHERE n < k % 4) SELECT k, CAST(sum(v) AS BIGINT) AS v, max(n) AS n FROM r GROUP BY k")
def recursive_key_aggregate(spark, folder):
    anchor = table(spark, folder, "nation").selectExpr("n_nationkey AS k", "n_regionkey AS v", "0 AS n")
    return recursive.using_key(anchor, ["k"], lambda rows, _: rows.where("n < k % 4").selectExpr("k", "v + 1 AS v", "n + 1 AS n"), combine={"v": F.sum})


@suite.add("rel_search_depth", """
    WITH RECURSIVE e(a, b) AS (SELECT n_nationkey, n_nationkey * 2 + 1 FROM nation UNION ALL SELECT n_nationkey, n_nationkey * 2 + 2 FROM nation),
    r(n, way) AS (SELECT 0, [0] UNION ALL SELECT b, list_append(way, b) FROM r JOIN e ON a = n WHERE b < 25)
    SELECT n, CAST(row_number() OVER (ORDER BY way) AS INT) AS place FROM r""")
def search_depth(spark, folder):
    nation = table(spark, folder, "nation")
    edges = nation.selectExpr("n_nationkey AS a", "n_nationkey * 2 + 1 AS b").unionByName(nation.selectExpr("n_nationkey AS a", "n_nationkey * 2 + 2 AS b"))
    step = lambda rows: rows.join(edges, rows["n"] == edges["a"]).where("b < 25").select(F.col("b").alias("n"), "__way", "__seen")
    found = recursive.search_order(spark.range(1).select(F.lit(0).alias("n")), step, ["n"])
    return found.select("n", F.row_number().over(Window.orderBy("ordering")).alias("place"))


@suite.add("rel_cycle", "WITH RECURSIVE r(n, seen, c) AS (SELECT n_nationkey, [n_nationkey], false FROM nation UNION ALL SELECT (n * 3 + 1) % 25, list_append(seen, (n * 3 + 1) % 25), list_contains(seen, (n * 3 + 1) % 25) FROM r WHERE NOT c) SELECT n, c AS is_cycle, count(*) AS ways FROM r GROUP BY ALL")
def cycle(spark, folder):
    step = lambda rows: rows.select(((F.col("n") * 3 + 1) % 25).alias("n"), "__way", "__seen")
    found = recursive.search_order(table(spark, folder, "nation").select(F.col("n_nationkey").alias("n")), step, ["n"], cycle=["n"])
    return found.groupBy("n", "is_cycle").agg(F.count(F.lit(1)).alias("ways"))


suite.texts("rel_unnest", "SELECT doc_id, CAST(pos AS BIGINT) AS pos, word FROM (SELECT doc_id, posexplode(split(text, ' ')) AS (pos, word) FROM documents)",
            "SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
suite.texts("rel_generate_series", "SELECT id AS x, id * id AS y FROM range(3, 40, 4)", "SELECT range AS x, range * range AS y FROM range(3, 40, 4)")
suite.texts("rel_list_comprehension", "SELECT c_custkey, filter(transform(sequence(1, 5), x -> x * c_nationkey), y -> y % 2 = 0) AS l FROM customer", "SELECT c_custkey, [x * c_nationkey FOR x IN range(1, 6) IF (x * c_nationkey) % 2 = 0] AS l FROM customer".replace("range(1, 6)", "[1, 2, 3, 4, 5]"))


@suite.add("rel_prepared", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'")
def prepared(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 250000, "status": "O"})


@suite.add("rel_macro_scalar", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS charge FROM lineitem")
def macro(spark, folder):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vl_charge(p DOUBLE, d DOUBLE, t DOUBLE DEFAULT 0.0D) RETURNS DOUBLE RETURN p * (1 - d) * (1 + t)")
    return run_sql(spark, folder, "SELECT l_orderkey, l_linenumber, round(vl_charge(l_extendedprice, l_discount, l_tax), 7) AS charge FROM lineitem")


@suite.add("rel_macro_table", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
def macro_table(spark, folder):
    table(spark, folder, "customer").createOrReplaceTempView("customer")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vl_rich(seg STRING, least DOUBLE) RETURNS TABLE (c_custkey BIGINT, c_acctbal DOUBLE) RETURN SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = seg AND c_acctbal > least")
    return spark.sql("SELECT * FROM vl_rich('BUILDING', 9000D)")
