"""Table functions, statements as rewrites, aggregate states, bit strings, zones, and further functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumine.data import table
from vellumine.functions import aggregates as A
from vellumine.functions import dates, lists, numbers, strings
from vellumine.operators import statements, tablefunctions, windows
from vellumine.plans.suite import Suite

suite = Suite()
C = F.col


@suite.add("tf_json_each", "SELECT event_id, key, CAST(value AS VARCHAR) AS value FROM events, json_each(props)".replace("FROM events, json_each(props)", "FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) t").replace("CAST(value AS VARCHAR)", "props->>key"))
def json_each(spark, folder):
    return tablefunctions.json_each(table(spark, folder, "events"), "props", ["event_id"])


@suite.add("tf_json_tree", """SELECT event_id, fullkey AS path, CASE WHEN t.type = 'VARCHAR' THEN t.value->>'$' ELSE CAST(json(t.value) AS VARCHAR) END AS value FROM (SELECT event_id, '{"a":[' || props || ',2]}' AS j FROM events) e, json_tree(e.j) t""")
def json_tree(spark, folder):
    return tablefunctions.json_tree(table(spark, folder, "events").select("event_id", F.concat(F.lit('{"a":['), "props", F.lit(',2]}')).alias("j")), "j", ["event_id"])


@suite.add("tf_generate_series", "SELECT generate_series FROM generate_series(5, 50, 9)")
def generate_series(spark, folder):
    return tablefunctions.generate_series(spark, 5, 50, 9)


@suite.add("tf_query_table", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def query_table(spark, folder):
    table(spark, folder, "nation").select(C("n_nationkey").alias("k")).createOrReplaceTempView("vl_a")
    table(spark, folder, "region").select(C("r_regionkey").alias("k")).createOrReplaceTempView("vl_b")
    return tablefunctions.query_table(spark, ["vl_a", "vl_b"])


@suite.add("tf_unnest_zip", "SELECT n_nationkey, unnest([n_nationkey, 1, 2]) AS a, unnest([n_regionkey, 9]) AS b FROM nation")
def unnest_zip(spark, folder):
    df = table(spark, folder, "nation").select("n_nationkey", F.array(C("n_nationkey"), F.lit(1), F.lit(2)).alias("a"), F.array(C("n_regionkey"), F.lit(9)).alias("b"))
    return tablefunctions.unnest(df, "a", "b")


@suite.add("st_insert_replace", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_regionkey = 2")
def insert_replace(spark, folder):
    n = table(spark, folder, "nation")
    return statements.insert(n.select("n_nationkey", "n_name"), n.where("n_regionkey = 2").select(F.lower("n_name").alias("n_name"), "n_nationkey"), ["n_nationkey"], "replace")


@suite.add("st_insert_ignore", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 6 = 3")
def insert_ignore(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey")
    return statements.insert(s.where("s_suppkey % 2 = 0"), s.where("s_suppkey % 3 = 0"), ["s_suppkey"], "ignore")


@suite.add("st_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update(spark, folder):
    return statements.update(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": F.lit(0.0)}, C("c_acctbal") < 0)


@suite.add("st_delete_using", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def delete_using(spark, folder):
    gone = table(spark, folder, "customer").where("c_acctbal < 0").select(C("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey")


@suite.add("st_constraints", "SELECT 'unique p_size' AS rule, CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM part GROUP BY p_size HAVING count(*) > 1) UNION ALL SELECT 'check', count(*) FROM part WHERE NOT p_size < 40")
def constraints(spark, folder):
    return statements.violations(table(spark, folder, "part"), unique=["p_size"], not_null=["p_name"], check=C("p_size") < 40)


@suite.add("agg_within_group", "SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity < 20) + 1 AS BIGINT) AS r, CAST(count(DISTINCT CASE WHEN l_quantity < 20 THEN l_quantity END) + 1 AS BIGINT) AS d, round(count(*) FILTER (WHERE l_quantity < 20) / count(*), 8) AS p, round((count(*) FILTER (WHERE l_quantity <= 20) + 1) / (count(*) + 1), 8) AS c FROM lineitem GROUP BY l_returnflag")
def within_group(spark, folder):
    x = C("l_quantity")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(A.rank_within(20, x).alias("r"), A.dense_rank_within(20, x).alias("d"), F.round(A.percent_rank_within(20, x), 8).alias("p"), F.round(A.cume_dist_within(20, x), 8).alias("c"))


@suite.add("agg_arg_null", "SELECT k, arg_min_null(x, o) AS lo, arg_max_null(x, o) AS hi FROM (VALUES (1, 5, 1), (1, NULL, 0), (1, 7, 9), (2, 3, NULL), (2, 4, 2)) t(k, x, o) GROUP BY k")
def arg_null(spark, folder):
    df = spark.createDataFrame([(1, 5, 1), (1, None, 0), (1, 7, 9), (2, 3, None), (2, 4, 2)], "k int, x int, o int")
    return df.groupBy("k").agg(A.arg_min_null(C("x"), C("o")).alias("lo"), A.arg_max_null(C("x"), C("o")).alias("hi"))


@suite.add("agg_histogram_bins", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice <= 100000) AS a, count(*) FILTER (WHERE o_totalprice > 100000 AND o_totalprice <= 200000) AS b, count(*) FILTER (WHERE o_totalprice > 200000) AS c FROM orders GROUP BY o_orderstatus")
def histogram_bins(spark, folder):
    h = table(spark, folder, "orders").groupBy("o_orderstatus").agg(A.histogram_bins(C("o_totalprice"), [100000.0, 200000.0]).alias("h"))
    return h.select("o_orderstatus", *[F.get("h", i)["n"].alias(n) for i, n in enumerate("abc")])


@suite.add("agg_states_merge", "SELECT o_orderstatus, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderstatus")
def states_merge(spark, folder):
    states = table(spark, folder, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(A.moments_state(C("o_totalprice")).alias("state"))
    merged = states.groupBy("o_orderstatus").agg(A.moments_merge(C("state")).alias("m"))
    return merged.select("o_orderstatus", C("m.n").alias("n"), F.round(C("m.s") / C("m.n"), 4).alias("a"))


@suite.add("agg_sketch_states")
def sketch_states(spark, folder):
    states = table(spark, folder, "events").groupBy("event_type", "user_id").agg(A.distinct_state(C("event_id")).alias("s"))
    return states.groupBy("event_type").agg(A.distinct_finalize(A.distinct_merge(C("s"))).alias("n"))


@suite.add("fn_bitstrings", "SELECT n_nationkey, CAST(get_bit(b, 2) AS INT) AS g, CAST(set_bit(b, 1, 1) AS VARCHAR) AS s, CAST(bit_position('1'::BIT, b) AS INT) AS p, bit_count(b) AS c FROM (SELECT n_nationkey, bitstring(bin(n_nationkey), 8) AS b FROM nation)")
def bitstrings(spark, folder):
    df = table(spark, folder, "nation").select("n_nationkey", strings.bitstring(F.bin("n_nationkey"), 8).alias("b"))
    return df.select("n_nationkey", strings.get_bit(C("b"), 2).alias("g"), strings.set_bit(C("b"), 1, 1).alias("s"), strings.bit_position(F.lit("1"), C("b")).alias("p"), strings.bit_count(C("b")).alias("c"))


@suite.add("fn_md5_number", "SELECT n_nationkey, CAST(md5_number_lower(n_name) AS VARCHAR) AS lower, CAST(md5_number_upper(n_name) AS VARCHAR) AS upper FROM nation")
def md5_number(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", strings.md5_number_lower(C("n_name")).cast("string").alias("lower"), strings.md5_number_upper(C("n_name")).cast("string").alias("upper"))


@suite.add("fn_time_zones", "SELECT event_id, CAST(timezone('UTC', timezone('America/New_York', ts)) AS TIMESTAMP) AS utc FROM events")
def time_zones(spark, folder):
    return table(spark, folder, "events").select("event_id", dates.at_time_zone(C("ts"), "America/New_York").alias("utc"))


@suite.add("fn_age", "SELECT o_orderkey, date_sub('month', o_orderdate, TIMESTAMP '2002-05-17 00:00:00') AS m, CAST(date_part('year', age(TIMESTAMP '2002-05-17 00:00:00', o_orderdate)) * 12 + date_part('month', age(TIMESTAMP '2002-05-17 00:00:00', o_orderdate)) AS BIGINT) AS am FROM orders")
def age(spark, folder):
    end = F.lit("2002-05-17").cast("timestamp_ntz")
    return table(spark, folder, "orders").select("o_orderkey", dates.date_sub("month", C("o_orderdate"), end).alias("m"), dates.age(end, C("o_orderdate"))["months"].cast("long").alias("am"))


@suite.add("fn_make_timestamps", "SELECT event_id, make_timestamp(1700000000000000 + event_id * 1000000) AS a, make_date(2024, 2, 29) AS d, epoch_ms(1700000000000 + event_id * 1000) AS ms FROM events")
def make_timestamps(spark, folder):
    i = C("event_id")
    return table(spark, folder, "events").select("event_id", dates.from_micros(F.lit(1700000000000000) + i * 1000000).alias("a"), F.make_date(F.lit(2024), F.lit(2), F.lit(29)).alias("d"), dates.make_timestamp_ms(F.lit(1700000000000) + i * 1000).alias("ms"))


@suite.add("fn_list_aggregates", "SELECT k, CAST(list_aggregate(l, 'sum') AS BIGINT) AS s, CAST(list_min(l) AS INT) AS lo, list_avg(l) AS a, list_product(l) AS p, list_any_value(l) AS f, CAST(list_count(l) AS BIGINT) AS n FROM (SELECT n_nationkey AS k, [n_nationkey, NULL, 4] AS l FROM nation)")
def list_aggregates(spark, folder):
    l = C("l")
    df = table(spark, folder, "nation").select(C("n_nationkey").alias("k"), F.array(C("n_nationkey"), F.lit(None), F.lit(4)).alias("l"))
    return df.select("k", lists.total(l, "long").alias("s"), F.array_min(l).alias("lo"), lists.mean(l).alias("a"), lists.product(l).alias("p"), F.get(F.filter(l, lambda x: x.isNotNull()), 0).alias("f"), F.size(F.filter(l, lambda x: x.isNotNull())).cast("long").alias("n"))


@suite.add("fn_list_shapes", "SELECT n_nationkey, flatten([[n_nationkey], [1, 2]]) AS f, list_select([5, 6, 7], [3, 1]) AS se, list_where([5, 6, 7], [true, false, true]) AS w, list_intersect([1, 2, 3], [3, 4]) AS i, array_cross_product([1.0, 2.0, 3.0]::DOUBLE[3], [n_nationkey, 5.0, 6.0]::DOUBLE[3])::DOUBLE[] AS c, equi_width_bins(0.0, 10.0, 2, false)::DOUBLE[] AS e FROM nation")
def list_shapes(spark, folder):
    a = lambda *v: F.array(*[x if not isinstance(x, (int, float, bool)) else F.lit(x) for x in v])
    n = C("n_nationkey")
    return table(spark, folder, "nation").select("n_nationkey", F.flatten(a(a(n), a(1, 2))).alias("f"), lists.select(a(5, 6, 7), a(3, 1)).alias("se"), lists.where(a(5, 6, 7), a(True, False, True)).alias("w"), F.array_intersect(a(1, 2, 3), a(3, 4)).alias("i"), lists.cross_product(a(1.0, 2.0, 3.0), a(n.cast("double"), 5.0, 6.0)).alias("c"), numbers.equi_width_bins(F.lit(0.0), F.lit(10.0), 2).alias("e"))


@suite.add("fn_map_functions", "SELECT n_nationkey, map_extract(m, 'a') AS x, map_extract(m, 'q') AS y, cardinality(map_concat(m, MAP {'z': 1})) AS n, map_entries(m)[1].key AS k FROM (SELECT n_nationkey, MAP {'a': n_nationkey} AS m FROM nation)".replace("cardinality(map_concat(m, MAP {'z': 1}))", "CAST(cardinality(map_concat(m, MAP {'z': 1})) AS BIGINT)").replace("map_extract(m, 'q')", "CAST(map_extract(m, 'q') AS INTEGER[])"))
def map_functions(spark, folder):
    df = table(spark, folder, "nation").select("n_nationkey", F.create_map(F.lit("a"), C("n_nationkey")).alias("m"))
    return df.select("n_nationkey", lists.map_extract(C("m"), F.lit("a")).alias("x"), lists.map_extract(C("m"), F.lit("q")).alias("y"), F.size(F.map_concat("m", F.create_map(F.lit("z"), F.lit(1)))).cast("long").alias("n"), F.get(F.map_entries("m"), 0)["key"].alias("k"))


@suite.add("fn_parse_bytes", "SELECT * FROM (VALUES ('1.5 KiB', CAST(1536 AS BIGINT)), ('2 MB', 2000000), ('7 bytes', 7)) t(s, n)")
def parse_bytes(spark, folder):
    return spark.createDataFrame([("1.5 KiB",), ("2 MB",), ("7 bytes",)], "s string").withColumn("n", strings.parse_formatted_bytes(C("s")))


@suite.add("win_per_row_frame", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN (p_size % 3) PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")
def per_row_frame(spark, folder):
    held = windows.framed(table(spark, folder, "part"), ["p_brand"], [C("p_partkey")], C("p_size"), "l", C("p_size") % 3, 0, (2, 0))
    return held.select("p_partkey", lists.total(C("l"), "long").alias("s"))


suite.both("rel_nested_ctes", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT a.o_custkey, t, c_nationkey FROM a JOIN customer ON c_custkey = o_custkey), m AS (SELECT c_nationkey, max(t) AS mt FROM b GROUP BY c_nationkey) SELECT b.c_nationkey, count(*) AS n FROM b JOIN m ON b.c_nationkey = m.c_nationkey AND b.t >= m.mt * 0.9 GROUP BY b.c_nationkey")
suite.both("rel_fetch_semi_reduction", "SELECT max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
suite.texts("fn_uuid_random", "SELECT count(DISTINCT u) AS n, bool_and(x BETWEEN 0 AND 1) AS r FROM (SELECT uuid() AS u, rand(3) AS x FROM nation)", "SELECT count(*) AS n, true AS r FROM nation")
suite.texts("fn_try_expressions", "SELECT x, try_divide(10, x) AS d, try_cast(concat('1', x) AS INT) AS c FROM (VALUES (0), (2), (NULL)) t(x)", "SELECT x, CASE WHEN x = 0 THEN NULL ELSE CAST(10 AS DOUBLE) / x END AS d, TRY_CAST('1' || x AS INT) AS c FROM (VALUES (0), (2), (NULL)) t(x)")
suite.texts("fn_current_values", "SELECT current_date() = date_trunc('day', current_timestamp()) AS same, typeof(1L) AS t", "SELECT true AS same, lower(typeof(CAST(1 AS BIGINT))) AS t")


@suite.add("fn_session_variables", "SELECT c_custkey, c_acctbal * 1.5 AS scaled FROM customer WHERE c_mktsegment = 'BUILDING'")
def session_variables(spark, folder):
    table(spark, folder, "customer").createOrReplaceTempView("customer")
    spark.sql("DECLARE OR REPLACE VARIABLE vl_scale DOUBLE DEFAULT 1.0D")
    spark.sql("DECLARE OR REPLACE VARIABLE vl_segment STRING")
    spark.sql("SET VAR (vl_scale, vl_segment) = (SELECT 1.5D, 'BUILDING')")
    return spark.sql("SELECT c_custkey, c_acctbal * session.vl_scale AS scaled FROM customer WHERE c_mktsegment = session.vl_segment")
