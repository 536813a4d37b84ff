"""Decision-support and web-analytics queries over the given tables."""

from __future__ import annotations

from vellumine.plans.suite import Suite

suite = Suite()

REVENUE = "l_extendedprice * (1 - l_discount)"

suite.both("q03_shipping_priority", f"SELECT l_orderkey, round(sum({REVENUE}), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
suite.both("q04_order_priority", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY o_orderpriority")
suite.both("q05_local_supplier", f"SELECT n_name, round(sum({REVENUE}), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
suite.both("q06_forecast", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
suite.both("q07_volume_shipping", f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year, round(sum({REVENUE}), 4) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_regionkey = 1 AND n2.n_regionkey = 2 GROUP BY 1, 2, 3")
suite.both("q08_market_share", f"SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' OR nation = 'BRAZIL' THEN volume ELSE 0 END) / sum(volume), 6) AS share FROM (SELECT CAST(extract(year FROM o_orderdate) AS INT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE n1.n_regionkey = 1) t GROUP BY o_year")
suite.both("q09_product_profit", f"SELECT n_name, CAST(extract(year FROM o_orderdate) AS INT) AS o_year, round(sum({REVENUE} - p_retailprice * 0.1 * l_quantity), 4) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size > 30 GROUP BY 1, 2")
suite.both("q10_returned_items", f"SELECT c_custkey, c_name, round(sum({REVENUE}), 4) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
suite.both("q11_important_stock", "SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.0008 FROM lineitem)")
suite.both("q12_ship_priority", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0E0 ELSE 0.0E0 END) AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1.0E0 ELSE 0.0E0 END) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus")
suite.both("q13_customer_distribution", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count")
suite.both("q14_promotion", f"SELECT round(100.0E0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey")
suite.both("q15_top_supplier", f"WITH r AS (SELECT l_suppkey, round(sum({REVENUE}), 4) AS total FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM r)")
suite.both("q16_parts_supplier", "SELECT p_brand, p_size, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#45' AND p_size IN (1, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_size")
suite.both("q17_small_quantity", "SELECT round(sum(l_extendedprice) / 7.0E0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.5E0 * avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)")
suite.both("q18_large_orders", "SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice")
suite.both("q19_discounted", f"SELECT round(sum({REVENUE}), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 1 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 20 AND 30)")
suite.both("q20_promotion_candidates", "SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 25) GROUP BY l_suppkey HAVING sum(l_quantity) > 100)")
suite.both("q21_waiting_suppliers", "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'A') GROUP BY s_name")
suite.both("q22_sales_opportunity", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey")
suite.both("web_count_nonzero", "SELECT count(*) AS n FROM events WHERE value <> 0")
suite.both("web_distinct_users", "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10")
suite.both("web_top_users", "SELECT user_id, count(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10")
suite.both("web_user_type_minute", "SELECT user_id, CAST(extract(minute FROM ts) AS INT) AS m, event_type, count(*) AS c FROM events GROUP BY user_id, 2, event_type ORDER BY c DESC, user_id, m, event_type LIMIT 10")
suite.both("web_like", "SELECT count(*) AS n FROM pages WHERE url LIKE '%page%'")
suite.texts("web_host", "SELECT regexp_replace(url, '^https?://(?:www\\\\.)?([^/]+)/.*$', '$1') AS host, count(*) AS c, round(avg(length(html)), 4) AS l FROM pages GROUP BY 1 HAVING c > 2", "SELECT regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1') AS host, count(*) AS c, round(avg(length(html)), 4) AS l FROM pages GROUP BY 1 HAVING c > 2")
suite.both("web_shifted_sums", "SELECT CAST(sum(p_size) AS BIGINT) AS s0, CAST(sum(p_size + 1) AS BIGINT) AS s1, CAST(sum(p_size + 2) AS BIGINT) AS s2 FROM part")
suite.both("web_daily", "SELECT CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 5")
suite.both("docs_by_language", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS a, CAST(max(length(text)) AS BIGINT) AS m FROM documents GROUP BY lang")
suite.both("conv_turns", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS convs, max(turn) AS last FROM conversations GROUP BY role")
