"""Aggregates, their modifiers, grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.data import table
from vellumine.functions import aggregates as A
from vellumine.plans.suite import Suite

suite = Suite()

suite.both("q01_pricing_summary", """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
suite.both("agg_empty_input", "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_quantity) AS lo FROM lineitem WHERE l_quantity < 0")
suite.both("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(*) AS n FROM orders GROUP BY o_orderstatus")
suite.both("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS many, round(sum(l_tax) FILTER (WHERE l_discount > 0.05), 4) AS tax FROM lineitem GROUP BY l_returnflag")
suite.both("agg_bool_bit", "SELECT p_brand, bool_and(p_size > 0) AS a, bool_or(p_size > 49) AS o, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx FROM part GROUP BY p_brand")
suite.both("agg_variance", "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp FROM lineitem GROUP BY l_returnflag")
suite.both("agg_corr_covar", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 8) AS cp, round(covar_samp(l_quantity, l_discount), 8) AS cs FROM lineitem GROUP BY l_returnflag")
suite.both("agg_regression", "SELECT l_linestatus, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_intercept(l_extendedprice, l_quantity), 2) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_sxx(l_extendedprice, l_quantity), 0) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1000, 0) AS sxy FROM lineitem GROUP BY l_linestatus")
@suite.add("agg_quantiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_disc(l_extendedprice, 0.75) AS q3, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag")
def quantiles(spark, folder):
    lines, key = table(spark, folder, "lineitem"), ["l_returnflag"]
    prices = A.quantiles(lines, key, "l_extendedprice", {"q1": (0.25, True), "q3": (0.75, False)})
    return prices.join(A.quantiles(lines, key, "l_quantity", {"m": (0.5, True)}), key)


suite.texts("agg_string_agg", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
suite.texts("agg_list", "SELECT n_regionkey, sort_array(collect_list(n_nationkey)) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
suite.both("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
suite.both("agg_cube", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
suite.both("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
suite.both("agg_nulls", "SELECT k, count(*) AS n, count(v) AS c, CAST(sum(v) AS BIGINT) AS s, avg(v) AS a, min(v) AS lo FROM (VALUES (1, 2), (1, NULL), (2, NULL), (NULL, 5), (NULL, 7)) t(k, v) GROUP BY k")
suite.both("agg_any_of_group_key", "SELECT o_custkey, any_value(o_custkey) AS same, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey")


@suite.add("agg_arg_extremes", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_custkey")
def arg_extremes(spark, folder):
    key = (F.col("o_totalprice"), F.col("o_orderkey"))
    return table(spark, folder, "orders").groupBy("o_custkey").agg(A.arg_max(F.col("o_orderkey"), *key).alias("top"), A.arg_min(F.col("o_orderkey"), *key).alias("low"))


@suite.add("agg_least_greatest_n", "SELECT o_orderstatus, min(o_orderkey, 4) AS first4, max(o_totalprice, 3) AS top3 FROM orders GROUP BY o_orderstatus")
def least_n(spark, folder):
    orders = table(spark, folder, "orders")
    return A.least_n(orders, ["o_orderstatus"], "o_orderkey", 4, "first4").join(A.greatest_n(orders, ["o_orderstatus"], "o_totalprice", 3, "top3"), "o_orderstatus")


@suite.add("agg_count_if_product", "SELECT n_regionkey, CAST(count_if(n_nationkey > 10) AS BIGINT) AS big, product(n_nationkey - 6.5) AS p FROM nation GROUP BY n_regionkey")
def product(spark, folder):
    return table(spark, folder, "nation").groupBy("n_regionkey").agg(F.count_if(F.col("n_nationkey") > 10).alias("big"), F.product(F.col("n_nationkey") - 6.5).alias("p"))


@suite.add("agg_arg_n", "SELECT o_orderstatus, arg_min(o_orderkey, o_totalprice, 4) AS cheap, arg_max(o_orderkey, o_totalprice, 3) AS dear FROM orders GROUP BY o_orderstatus")
def arg_n(spark, folder):
    orders, key = table(spark, folder, "orders"), ["o_orderstatus"]
    cheap = A.arg_n(orders, key, F.col("o_orderkey"), F.col("o_totalprice"), 4, "cheap")
    return cheap.join(A.arg_n(orders, key, F.col("o_orderkey"), F.col("o_totalprice"), 3, "dear", greatest=True), key)


@suite.add("agg_first_last_ordered", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS f, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY o_custkey")
def first_last(spark, folder):
    x, order = F.col("o_orderkey"), (F.col("o_orderdate"), F.col("o_orderkey"))
    return table(spark, folder, "orders").groupBy("o_custkey").agg(A.first_in(x, *order).alias("f"), A.last_in(x, *order).alias("l"))


@suite.add("agg_exact_sum", "SELECT l_returnflag, fsum(l_extendedprice) AS s, favg(l_discount) AS a FROM lineitem GROUP BY l_returnflag".replace("fsum(l_extendedprice) AS s, favg(l_discount) AS a", "CAST(sum(CAST(l_extendedprice AS DECIMAL(38, 10))) AS DOUBLE) AS s, round(favg(l_discount), 12) AS a"))
def exact(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(A.exact_sum(F.col("l_extendedprice")).alias("s"), F.round(A.exact_avg(F.col("l_discount")), 12).alias("a"))




@suite.add("agg_moments", "SELECT l_returnflag, round(sem(l_extendedprice), 6) AS sem, round(skewness(l_extendedprice), 6) AS sk, round(kurtosis(l_extendedprice), 6) AS ku, round(kurtosis_pop(l_extendedprice), 6) AS kp FROM lineitem GROUP BY l_returnflag")
def moments(spark, folder):
    x = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.round(A.sem(x), 6).alias("sem"), F.round(A.skewness(x), 6).alias("sk"), F.round(A.kurtosis(x), 6).alias("ku"), F.round(F.kurtosis(x), 6).alias("kp"))


@suite.add("agg_geomean_weighted", "SELECT l_linestatus, round(geomean(l_extendedprice), 4) AS g, round(weighted_avg(l_discount, l_quantity), 8) AS w FROM lineitem GROUP BY l_linestatus")
def geomean(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_linestatus").agg(F.round(A.geomean(F.col("l_extendedprice")), 4).alias("g"), F.round(A.weighted_avg(F.col("l_discount"), F.col("l_quantity")), 8).alias("w"))


@suite.add("agg_mad", "SELECT l_returnflag, mad(l_extendedprice) AS mad FROM lineitem GROUP BY l_returnflag")
def mad(spark, folder):
    return A.median_deviation(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", "mad")


@suite.add("agg_entropy", "SELECT o_orderstatus, round(entropy(o_orderpriority), 8) AS e FROM orders GROUP BY o_orderstatus")
def entropy(spark, folder):
    return A.entropy(table(spark, folder, "orders"), ["o_orderstatus"], "o_orderpriority", "e").withColumn("e", F.round("e", 8))


@suite.add("agg_mode", "SELECT user_id, event_type AS m FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def mode(spark, folder):
    return A.mode(table(spark, folder, "events"), ["user_id"], "event_type", "m")


@suite.add("agg_histogram", "SELECT o_orderstatus, list(o_orderpriority || '=' || n ORDER BY o_orderpriority) AS h FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def histogram(spark, folder):
    found = A.histogram(table(spark, folder, "orders"), ["o_orderstatus"], "o_orderpriority", "h")
    return found.select("o_orderstatus", F.transform(F.map_entries("h"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias("h"))


@suite.add("agg_bitstring", "SELECT n_regionkey, CAST(bitstring_agg(n_nationkey, 0, 24) AS VARCHAR) AS bits FROM nation GROUP BY n_regionkey")
def bitstring(spark, folder):
    return table(spark, folder, "nation").groupBy("n_regionkey").agg(A.bitstring_agg(F.col("n_nationkey"), 0, 24).alias("bits"))


@suite.add("agg_approx_count_distinct")
def approx_distinct(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@suite.add("agg_approx_quantile")
def approx_quantile(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", F.lit(0.9), F.lit(10000)).alias("p90"))


@suite.add("agg_approx_top_k")
def approx_top_k(spark, folder):
    return table(spark, folder, "events").agg(F.expr("approx_top_k(event_type, 3)").alias("top"))


@suite.add("agg_lttb")
def lttb(spark, folder):
    return A.lttb(table(spark, folder, "events").select("event_type", F.col("event_id").alias("x"), F.col("value").alias("y")), ["event_type"], "x", "y", 20)


suite.texts("agg_json_group", "SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
suite.texts("agg_json_object_group", "SELECT n_regionkey, to_json(map_from_entries(sort_array(collect_list(struct(n_name, n_nationkey))))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(json_group_object(n_name, n_nationkey) AS VARCHAR) AS j FROM (SELECT * FROM nation ORDER BY n_name) GROUP BY n_regionkey")
suite.texts("agg_time_average", "SELECT event_type, timestamp_micros(CAST(sum(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) DIV count(ts) AS BIGINT) + 1704067200000000)::timestamp_ntz AS middle FROM events GROUP BY event_type", "SELECT event_type, make_timestamp(CAST(sum(epoch_us(ts) - 1704067200000000) // count(ts) AS BIGINT) + 1704067200000000) AS middle FROM events GROUP BY event_type")
