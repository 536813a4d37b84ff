"""Structs, variants, list aggregates, intervals, statements that return rows, joins on subqueries, copies and file metadata."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.data import table
from vellumine.functions import aggregates as A
from vellumine.functions import dates, json, lists, strings, structs
from vellumine.operators import joins, limits, scans, statements, tablefunctions
from vellumine.operators.lineage import cut
from vellumine.plans.io import _scratch
from vellumine.plans.suite import Suite
from vellumine.sources import files, metadata

suite = Suite()
C = F.col


# ---- structs and variants


def _customers(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.struct(C("c_nationkey").alias("a"), C("c_mktsegment").alias("b")).alias("s"))


@suite.add("fn_struct_update", "SELECT c_custkey, u.a AS a, u.b AS b, u.c AS c FROM (SELECT c_custkey, struct_update({'a': c_nationkey, 'b': c_mktsegment}, b := lower(c_mktsegment), c := c_custkey % 3) AS u FROM customer)")
def struct_update(spark, folder):
    u = structs.update(C("s"), ["a", "b"], b=F.lower("s.b"), c=C("c_custkey") % 3)
    return _customers(spark, folder).select("c_custkey", u.alias("u")).select("c_custkey", "u.a", "u.b", "u.c")


@suite.add("fn_struct_concat", "SELECT c_custkey, u.a AS a, u.b AS b, u.z AS z FROM (SELECT c_custkey, struct_concat({'a': c_nationkey, 'b': c_mktsegment}, {'z': c_custkey + 1}) AS u FROM customer)")
def struct_concat(spark, folder):
    df = _customers(spark, folder)
    u = structs.concat((C("s"), structs.names(df, "s")), (F.struct((C("c_custkey") + 1).alias("z")), ["z"]))
    return df.select("c_custkey", u.alias("u")).select("c_custkey", "u.a", "u.b", "u.z")


@suite.add("fn_struct_keys_values", "SELECT c_custkey, ['a', 'b'] AS k, c_custkey AS v, list_contains([c_nationkey, c_custkey], 7) AS c, list_position([c_nationkey, c_custkey], 7) AS p FROM customer")
def struct_keys(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", F.struct(C("c_nationkey").cast("long").alias("a"), C("c_custkey").alias("b")).alias("s"))
    m = structs.names(df, "s")
    return df.select("c_custkey", structs.keys(C("s"), m).alias("k"), structs.values(C("s"), m)["_1"].alias("v"), structs.contains(C("s"), m, F.lit(7)).alias("c"), structs.position(C("s"), m, F.lit(7).cast("long")).alias("p"))


@suite.add("fn_remap_struct", "SELECT c_custkey, c_mktsegment AS x, c_nationkey AS y, 0 AS z FROM customer")
def remap_struct(spark, folder):
    return _customers(spark, folder).select("c_custkey", structs.remap(C("s"), {"x": "b", "y": "a", "z": F.lit(0)}).alias("r")).select("c_custkey", "r.x", "r.y", "r.z")


@suite.add("fn_variants", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'OBJECT' WHEN event_id % 3 = 1 THEN 'ARRAY' ELSE 'VARCHAR' END AS kind, CASE WHEN event_id % 3 = 0 THEN json_keys(props) END AS keys,
           CASE WHEN event_id % 3 = 1 THEN 2 END AS n, CASE WHEN event_id % 3 = 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k FROM events""")
def variants(spark, folder):
    text = F.when(C("event_id") % 3 == 0, C("props")).when(C("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit(",1]"))).otherwise(F.lit('"text"'))
    df = table(spark, folder, "events").select("event_id", F.parse_json(text).alias("v"))
    return df.select("event_id", structs.variant_typeof(C("v")).alias("kind"), structs.variant_keys(C("v")).alias("keys"), structs.variant_length(C("v")).cast("int").alias("n"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


@suite.add("fn_sort_key", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority DESC NULLS LAST, o_orderdate, o_orderkey) AS INT) AS place FROM orders")
def sort_key(spark, folder):
    df = table(spark, folder, "orders")
    key = structs.sort_key((C("o_orderpriority"), T.StringType(), True, False), (C("o_orderdate"), T.TimestampNTZType(), False, False), (C("o_orderkey"), T.LongType(), False, False))
    placed = scans.numbered(df.select("o_orderkey", key.alias("key")), [], [C("key")], "place", "total")
    return placed.select("o_orderkey", C("place").cast("int").alias("place"))


# ---- lists


@suite.add("fn_list_statistics", """
    SELECT k, round(list_var_pop(l), 8) AS vp, round(list_var_samp(l), 8) AS vs, round(list_stddev_pop(l), 8) AS sp, round(list_stddev_samp(l), 8) AS ss, round(list_sem(l), 8) AS se, list_median(l) AS md,
           round(list_entropy(l), 8) AS en, list_mode(l) AS mo, list_first(l) AS f, list_last(l) AS la, list_any_value(l) AS av, list_string_agg(l) AS st, list_bit_and(l) AS ba, list_bit_or(l) AS bo, list_bit_xor(l) AS bx
    FROM (SELECT p_partkey AS k, [NULL, p_size % 5, 7, p_size, 7, p_size % 3] AS l FROM part)""")
def list_statistics(spark, folder):
    l, size = C("l"), C("p_size").cast("int")
    df = table(spark, folder, "part").select(C("p_partkey").alias("k"), F.array(F.lit(None), size % 5, F.lit(7), size, F.lit(7), size % 3).alias("l"))
    return df.select(
        "k", F.round(lists.var_pop(l), 8).alias("vp"), F.round(lists.var_samp(l), 8).alias("vs"), F.round(lists.stddev_pop(l), 8).alias("sp"), F.round(lists.stddev_samp(l), 8).alias("ss"), F.round(lists.sem(l), 8).alias("se"),
        lists.median(l).alias("md"), F.round(lists.entropy(l), 8).alias("en"), lists.mode(l).alias("mo"), lists.first(l).alias("f"), lists.last(l).alias("la"), lists.any_value(l).alias("av"), lists.string_agg(l).alias("st"),
        lists.bit_fold(l, "and").alias("ba"), lists.bit_fold(l, "or").alias("bo"), lists.bit_fold(l, "xor").alias("bx"),
    )


@suite.add("fn_list_bools", "SELECT n_nationkey, list_bool_and([n_nationkey > 3, NULL, n_regionkey > 0]) AS a, list_bool_or([n_nationkey > 3, NULL, n_regionkey > 0]) AS o, list_transform(map_entries(list_histogram([n_regionkey, 1, 1])), lambda e: e.key || '=' || e.value) AS h FROM nation")
def list_bools(spark, folder):
    flags = F.array(C("n_nationkey") > 3, F.lit(None), C("n_regionkey") > 0)
    h = lists.histogram(F.array(C("n_regionkey"), F.lit(1), F.lit(1)))
    return table(spark, folder, "nation").select("n_nationkey", lists.bool_and(flags).alias("a"), lists.bool_or(flags).alias("o"), F.transform(F.map_entries(h), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))).alias("h"))


@suite.add("fn_list_zip", "SELECT n_nationkey, list_transform(list_zip([n_nationkey, 1, 2], ['a']), lambda s: concat_ws(':', s[1], s[2])) AS z, list_transform(list_zip([n_nationkey, 1, 2], ['a'], true), lambda s: concat_ws(':', s[1], s[2])) AS t FROM nation")
def list_zip(spark, folder):
    parts = [F.array(C("n_nationkey"), F.lit(1), F.lit(2)), F.array(F.lit("a"))]
    text = lambda z: F.transform(z, lambda s: F.concat_ws(":", s["_0"].cast("string"), s["_1"]))
    return table(spark, folder, "nation").select("n_nationkey", text(lists.zip_(parts)).alias("z"), text(lists.zip_(parts, truncate=True)).alias("t"))


@suite.add("fn_union_extract", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS num, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS str FROM nation")
def union_extract(spark, folder):
    kinds = {"num": "int", "str": "string"}
    u = F.when(C("n_nationkey") % 2 == 0, lists.union_value(["num", "str"], "num", C("n_nationkey"), kinds)).otherwise(lists.union_value(["num", "str"], "str", C("n_name"), kinds))
    return table(spark, folder, "nation").select("n_nationkey", u.alias("u")).select("n_nationkey", lists.union_extract(C("u"), "num").alias("num"), lists.union_extract(C("u"), "str").alias("str"))


# ---- JSON


@suite.add("fn_json_depth", """
    SELECT event_id, json_value(j, '$.a.k') AS v, json_value(j, '$.a') AS o, json_contains(j, '{"b": [2]}') AS c, json_contains(j, '7') AS s, CAST(json_structure(j) AS VARCHAR) AS st, CAST(json_transform(j, '{"a": {"k": "BIGINT"}}').a.k AS BIGINT) AS t
    FROM (SELECT event_id, '{"a":' || props || ',"b":[1,2.5,' || event_id % 9 || ']}' AS j FROM events)""")
def json_depth(spark, folder):
    j = C("j")
    df = table(spark, folder, "events").select("event_id", F.concat(F.lit('{"a":'), "props", F.lit(',"b":[1,2.5,'), (C("event_id") % 9).cast("string"), F.lit("]}")).alias("j"))
    return df.select("event_id", json.value(j, "$.a.k").alias("v"), json.value(j, "$.a").alias("o"), json.contains(j, F.lit('{"b": [2]}')).alias("c"), json.contains(j, F.lit("7")).alias("s"), json.structure(j).alias("st"), json.transform(j, "a struct<k: bigint>")["a"]["k"].alias("t"))


# ---- texts and paths


@suite.add("fn_format_specs", "SELECT p_partkey, format('{0:>12}|{0:<12}|{0:^12}|{1:08.2f}|{2:x}|{{}}|{2:+d}', p_brand, p_retailprice, p_size) AS f FROM part")
def format_specs(spark, folder):
    return table(spark, folder, "part").select("p_partkey", strings.format_braces("{0:>12}|{0:<12}|{0:^12}|{1:08.2f}|{2:x}|{{}}|{2:+d}", C("p_brand"), C("p_retailprice"), C("p_size")).alias("f"))


@suite.add("fn_paths", "SELECT * FROM (VALUES ('/a/b/c.txt', '/a/b'), ('a/b', 'a'), ('c.txt', ''), ('/x', '/')) t(p, d)")
def paths(spark, folder):
    return spark.createDataFrame([("/a/b/c.txt",), ("a/b",), ("c.txt",), ("/x",)], "p string").select("p", strings.parse_dirpath(C("p")).alias("d"))


@suite.add("fn_path_join", "SELECT n_nationkey, '/root/' || n_name || '/x' AS a, '/abs' AS b FROM nation")
def path_join(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", strings.path_join(F.lit("/root/"), C("n_name"), F.lit("x")).alias("a"), strings.path_join(C("n_name"), F.lit("/abs")).alias("b"))


@suite.add("fn_graphemes", "SELECT n_nationkey, right(n_name, 3) AS r, substring(n_name, 2, 3) AS s FROM nation")
def graphemes(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", strings.right_grapheme(C("n_name"), F.lit(3)).alias("r"), strings.substring_grapheme(C("n_name"), F.lit(2), F.lit(3)).alias("s"))


@suite.add("fn_sizes", "SELECT * FROM (VALUES (CAST(7 AS BIGINT), '7 bytes', '7 bytes'), (1536, '1.50 KiB', '1536 bytes'), (20000, '19.53 KiB', '20 kB'), (5000000000, '4.66 GiB', '4768 MB')) t(n, r, p)")
def sizes(spark, folder):
    return spark.createDataFrame([(7,), (1536,), (20000,), (5_000_000_000,)], "n long").select("n", strings.readable_size(C("n")).alias("r"), strings.size_pretty(C("n")).alias("p"))


# ---- intervals and times


@suite.add("fn_intervals", """
    SELECT event_id, ts + to_months(CAST(event_id % 14 AS INT)) AS m, ts + to_weeks(CAST(event_id % 5 AS INT)) AS w, ts + to_hours(event_id % 50) AS h, ts + to_quarters(CAST(event_id % 3 AS INT)) AS q, ts + to_decades(1) AS d, ts - to_days(CAST(event_id % 40 AS INT)) AS a FROM events""")
def intervals(spark, folder):
    i, t = C("event_id"), C("ts")
    plus = lambda unit, n: dates.add_interval(t, dates.to_interval(unit, n))
    return table(spark, folder, "events").select("event_id", plus("months", i % 14).alias("m"), plus("weeks", i % 5).alias("w"), plus("hours", i % 50).alias("h"), plus("quarters", i % 3).alias("q"), plus("decades", F.lit(1)).alias("d"), dates.ago(t, dates.to_interval("days", i % 40)).alias("a"))


@suite.add("fn_normalized_interval", "SELECT n_nationkey, CAST(n_nationkey * 10 // 24 // 30 AS BIGINT) AS mo, CAST(n_nationkey * 10 // 24 % 30 AS BIGINT) AS da, CAST(n_nationkey * 10 % 24 AS BIGINT) * 3600000000 AS us FROM nation")
def normalized(spark, folder):
    n = dates.normalized_interval(dates.to_interval("hours", C("n_nationkey") * 10))
    return table(spark, folder, "nation").select("n_nationkey", n.alias("i")).select("n_nationkey", C("i.months").alias("mo"), C("i.days").alias("da"), C("i.micros").alias("us"))


@suite.add("fn_make_times", "SELECT n_nationkey, CAST(make_time(n_nationkey % 24, n_nationkey, 1.5) AS VARCHAR) AS t, epoch_us(timezone('UTC', timezone('America/New_York', make_timestamp(2024, 3, 1 + n_nationkey, 4, 5, 6.25)))) AS z FROM nation")
def make_times(spark, folder):
    n, l = C("n_nationkey"), F.lit
    zoned = dates.make_timestamptz(l(2024), l(3), l(1) + n, l(4), l(5), l(6.25), "America/New_York")
    return table(spark, folder, "nation").select("n_nationkey", dates.make_time(n % 24, n, l(1.5)).cast("string").alias("t"), F.unix_micros(zoned).alias("z"))


# ---- statements


@suite.add("st_upsert_returning", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 END AS b, 'update' AS action FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 1000000, s_acctbal, 'insert' FROM supplier WHERE s_suppkey % 5 = 0")
def upsert_returning(spark, folder):
    s = table(spark, folder, "supplier").selectExpr("s_suppkey AS k", "s_acctbal AS b")
    new = s.where("k % 3 = 0").selectExpr("k", "b + 1 AS b").unionByName(s.where("k % 5 = 0").selectExpr("k + 1000000 AS k", "b"))
    _, returned = statements.upsert(s, new, ["k"])
    return returned.withColumnRenamed("__action", "action")


@suite.add("st_upsert_result", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS b FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_acctbal FROM supplier WHERE s_suppkey % 5 = 0")
def upsert_result(spark, folder):
    s = table(spark, folder, "supplier").selectExpr("s_suppkey AS k", "s_acctbal AS b")
    new = s.where("k % 3 = 0").unionByName(s.where("k % 5 = 0").selectExpr("k + 1000000 AS k", "b"))
    return statements.upsert(s, new, ["k"], {"b": C("b") + C("excluded_b")})[0]


@suite.add("st_delete_returning", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 20000")
def delete_returning(spark, folder):
    return statements.delete_returning(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), C("o_totalprice") < 20000)[1]


@suite.add("st_alter", "SELECT r_regionkey AS k, r_name AS n, CAST(r_regionkey AS VARCHAR) AS t FROM region")
def alter(spark, folder):
    return statements.alter(table(spark, folder, "region").withColumn("gone", F.lit(1)), drop=("gone",), rename={"r_regionkey": "k", "r_name": "n"}, add={"t": C("r_regionkey").cast("string")})


# ---- joins


@suite.add("join_right_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def right_semi(spark, folder):
    c, o = table(spark, folder, "customer").where("c_acctbal > 5000"), table(spark, folder, "orders")
    return joins.right_semi(c, o, c["c_custkey"] == o["o_custkey"]).select("o_orderkey")


@suite.add("join_right_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def right_anti(spark, folder):
    c, o = table(spark, folder, "customer").where("c_acctbal > 5000"), table(spark, folder, "orders")
    return joins.right_anti(c, o, c["c_custkey"] == o["o_custkey"]).select("o_orderkey")


# A subquery inside ON: what it answers for a row of one side becomes a column of that side.
suite.texts("join_on_subquery", "SELECT c_custkey, o_orderkey FROM (SELECT *, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS served FROM customer) c LEFT JOIN orders ON c_custkey = o_custkey AND served AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
            "SELECT c_custkey, o_orderkey FROM (SELECT *, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS served FROM customer) c LEFT JOIN orders ON c_custkey = o_custkey AND served AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)")


@suite.add("join_nearest_k", "SELECT c_custkey, s_suppkey, CAST(r AS INT) AS rank FROM (SELECT c.c_custkey, s.s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_acctbal, s_suppkey) AS r FROM customer c JOIN supplier s ON c_nationkey = s_nationkey) WHERE r <= 3")
def nearest_k(spark, folder):
    c = table(spark, folder, "customer").selectExpr("c_custkey", "c_nationkey AS k", "c_acctbal")
    s = table(spark, folder, "supplier").selectExpr("s_suppkey", "s_nationkey AS k", "s_acctbal")
    return joins.nearest(c, "c_acctbal", s, "s_acctbal", ["k"], ["s_suppkey"], k=3).select("c_custkey", "s_suppkey", "rank")


# ---- files


@suite.add("io_copy_returning", "SELECT count(*) AS n, true AS sized FROM orders")
def copy_returning(spark, folder):
    written = files.copy_returning(table(spark, folder, "orders"), _scratch(spark, "copy"), rows_per_file=5000)
    return written.agg(F.sum("count").alias("n"), F.every(C("file_size_bytes") > 0).alias("sized"))


@suite.add("io_parquet_schema", "SELECT * FROM (VALUES ('n_nationkey', 'INT32'), ('n_name', 'BYTE_ARRAY'), ('n_regionkey', 'INT32')) t(name, type)")
def parquet_schema(spark, folder):
    return metadata.parquet_schema(spark, f"{folder}/nation.parquet").select("name", "type")


@suite.add("io_parquet_file_metadata", "SELECT count(*) AS num_rows FROM lineitem")
def parquet_file_metadata(spark, folder):
    return metadata.parquet_file_metadata(spark, f"{folder}/lineitem.parquet").agg(F.sum("num_rows").alias("num_rows"))


@suite.add("io_parquet_kv_metadata", "SELECT 'org.apache.spark.version' AS key UNION ALL SELECT 'org.apache.spark.sql.parquet.row.metadata'")
def parquet_kv_metadata(spark, folder):
    table(spark, folder, "region").coalesce(1).write.parquet(path := _scratch(spark, "kv"))
    return metadata.parquet_kv_metadata(spark, path).select(F.decode("key", "UTF-8").alias("key")).where("key LIKE 'org.apache.spark%'").distinct()


@suite.add("io_scan_by_name", "SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT r_regionkey, r_name FROM region")
def scan_by_name(spark, folder):
    table(spark, folder, "region").createOrReplaceTempView("region")
    return files.scan(spark, f"{folder}/customer.parquet").select("c_custkey", "c_mktsegment").union(files.scan(spark, "region").select("r_regionkey", "r_name"))


@suite.add("io_arrow", "SELECT n_nationkey, n_name FROM nation")
def arrow(spark, folder):
    return files.from_arrow(spark, files.to_arrow(table(spark, folder, "nation").select("n_nationkey", "n_name")))


@suite.add("io_blob_and_glob", "SELECT 2 AS files, true AS same")
def blob_and_glob(spark, folder):
    rows = table(spark, folder, "region").select("r_name")
    rows.coalesce(1).write.text(f"{(path := _scratch(spark, 'blob'))}/a")
    rows.coalesce(1).write.text(f"{path}/b")
    found = files.read_blob(spark, f"{path}/*/*.txt").join(files.glob(spark, f"{path}/*/*.txt"), C("filename") == C("file"))
    return found.agg(F.count(F.lit(1)).cast("int").alias("files"), F.every(F.octet_length("content") == C("size")).alias("same"))


@suite.add("rel_macro_aggregate", "SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) AS share FROM lineitem GROUP BY l_returnflag")
def macro_aggregate(spark, folder):
    share = lambda x, w: F.sum(x * w) / F.sum(x)  # noqa: E731  an aggregating macro is a function of columns
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.round(share(C("l_extendedprice"), C("l_discount")), 8).alias("share"))


# ---- further forms


@suite.add("tf_with_ordinality", "SELECT n_nationkey, x, CAST(o AS BIGINT) AS o FROM nation, unnest([n_name, 'b', n_name]) WITH ORDINALITY t(x, o)")
def with_ordinality(spark, folder):
    df = table(spark, folder, "nation").select("n_nationkey", F.array(C("n_name"), F.lit("b"), C("n_name")).alias("l"))
    return tablefunctions.with_ordinality(df, "l", "x", "o")


@suite.add("tf_split_to_table", "SELECT p_partkey, regexp_split_to_table(p_type, '[ _-]+') AS part FROM part")
def split_to_table(spark, folder):
    return tablefunctions.split_to_table(table(spark, folder, "part").select("p_partkey", "p_type"), "p_type", "[ _-]+", "part")


@suite.add("rel_limit_subquery", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT count(*) FROM nation)")
def limit_subquery(spark, folder):
    bound = table(spark, folder, "nation").agg(F.count(F.lit(1)))
    return limits.limit_of(table(spark, folder, "orders"), bound, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey")


@suite.add("rel_materialized_cte", "WITH m AS MATERIALIZED (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT a.o_custkey FROM m a JOIN (SELECT max(t) AS most FROM m) ON a.t > most * 0.8")
def materialized_cte(spark, folder):
    m = cut(table(spark, folder, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")))
    most = m.agg(F.max("t").alias("most"))
    return m.join(F.broadcast(most), C("t") > C("most") * 0.8).select("o_custkey")


@suite.add("agg_list_nulls", "SELECT n_regionkey, list(CASE WHEN n_nationkey % 2 = 0 THEN n_name END ORDER BY n_nationkey) AS l FROM nation GROUP BY n_regionkey")
def list_nulls(spark, folder):
    return table(spark, folder, "nation").groupBy("n_regionkey").agg(A.list_all(F.when(C("n_nationkey") % 2 == 0, C("n_name")), C("n_nationkey")).alias("l"))


suite.texts("fn_assertions", "SELECT n_nationkey, assert_true(n_nationkey >= 0) IS NULL AS held, IF(n_regionkey > 0, n_name, NULL) AS c FROM nation", "SELECT n_nationkey, true AS held, CASE WHEN n_regionkey > 0 THEN n_name END AS c FROM nation")
suite.texts("fn_nested_text", "SELECT n_nationkey, CAST(array(n_nationkey, 7) AS STRING) AS l, CAST(array('a', n_name) AS STRING) AS s FROM nation", "SELECT n_nationkey, CAST([n_nationkey, 7] AS VARCHAR) AS l, CAST(['a', n_name] AS VARCHAR) AS s FROM nation")
suite.both("rel_order_by_all", "SELECT n_regionkey, n_name FROM nation ORDER BY ALL LIMIT 7")
suite.both("rel_order_by_position", "SELECT n_name, n_regionkey FROM nation ORDER BY 2 DESC, 1 LIMIT 7")


@suite.add("io_catalog_tables", "SELECT 'nation' AS table_name, true AS temporary UNION ALL SELECT 'region', true")
def catalog_tables(spark, folder):
    for name in ("nation", "region"):
        table(spark, folder, name).createOrReplaceTempView(name)
    return metadata.tables(spark).where("table_name IN ('nation', 'region')").select("table_name", "temporary").distinct()


@suite.add("io_catalog_functions", "SELECT 'sum' AS function_name UNION ALL SELECT 'regexp_replace'")
def catalog_functions(spark, folder):
    return metadata.functions(spark).where("function_name IN ('sum', 'regexp_replace')")


@suite.add("io_catalog_settings", "SELECT 'spark.sql.ansi.enabled' AS name, 'true' AS value")
def catalog_settings(spark, folder):
    table(spark, folder, "nation")  # pins the settings
    return metadata.settings(spark).where("name = 'spark.sql.ansi.enabled'").select("name", "value")


@suite.add("tf_query_text", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def query_text(spark, folder):
    table(spark, folder, "nation").createOrReplaceTempView("nation")
    return tablefunctions.query(spark, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
