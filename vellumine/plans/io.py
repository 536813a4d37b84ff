"""Round trips through each file format, and file metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellumine.data import table
from vellumine.plans.suite import Suite
from vellumine.sources import files, metadata

suite = Suite()


def _scratch(spark, name: str) -> str:
    """A path in the folder that all machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/vellumine-io/{name}-{uuid.uuid4().hex}"


@suite.add("io_csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, folder):
    df = table(spark, folder, "customer")
    files.copy_to(df, path := _scratch(spark, "csv"), format="csv", header=True)
    return files.read_csv(spark, path, schema="c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", sep=",", header=True)


@suite.add("io_csv_sniffed", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name FROM nation")
def csv_sniffed(spark, folder):
    files.copy_to(table(spark, folder, "nation").select("n_nationkey", "n_name").coalesce(1), path := _scratch(spark, "csv"), format="csv", header=True, sep="|")
    return files.read_csv(spark, path)


@suite.add("io_csv_options", "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0")
def csv_options(spark, folder):
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    text = F.concat_ws(";", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.lit("# left out")), day, "o_orderstatus")
    table(spark, folder, "orders").select(text.alias("value")).write.text(path := _scratch(spark, "csv"))
    return files.read_csv(spark, path, schema="k bigint, d date, s string", sep=";", header=False, comment="#", dateformat="%d/%m/%Y")


@suite.add("io_csv_skip", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def csv_skip(spark, folder):
    rows = table(spark, folder, "nation").select(F.concat_ws("|", "n_nationkey", "n_name").alias("value")).coalesce(1)
    head = spark.createDataFrame([("made by hand",), ("second line",), ("k|name",)], "value string").coalesce(1)
    head.unionByName(rows).coalesce(1).write.text(path := _scratch(spark, "csv"))
    return files.read_csv(spark, path, schema="a bigint, b string", sep="|", header=True, skip=2, names=["k", "name"])


@suite.add("io_json_round_trip", "SELECT event_id, user_id, event_type, value, props FROM events")
def json_round_trip(spark, folder):
    df = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props")
    files.copy_to(df, path := _scratch(spark, "json"), format="json", compression="gzip")
    return files.read_json(spark, path, schema="event_id bigint, user_id bigint, event_type string, value double, props string")


@suite.add("io_json_objects", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_objects(spark, folder):
    files.copy_to(table(spark, folder, "supplier"), path := _scratch(spark, "json"), format="json")
    member = lambda name: F.get_json_object("json", f"$.{name}")
    return files.read_json_objects(spark, path).select(member("s_suppkey").cast("long").alias("s_suppkey"), member("s_name").alias("s_name"), member("s_acctbal").cast("double").alias("s_acctbal"))


@suite.add("io_parquet_hive", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def parquet_hive(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    files.copy_to(df, path := _scratch(spark, "parquet"), partition_by=("o_orderstatus",), compression="zstd")
    return files.read_parquet(spark, path).where("o_orderstatus = 'F'")


@suite.add("io_parquet_filename", "SELECT true AS named, count(*) AS n, count(*) AS places FROM part")
def parquet_filename(spark, folder):
    df = files.read_parquet(spark, f"{folder}/part.parquet", filename=True, file_row_number=True)
    return df.groupBy(F.contains("filename", F.lit("part.parquet")).alias("named")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_row_number").alias("places"))


@suite.add("io_parquet_metadata", "SELECT 'n_name' AS path_in_schema, count(*) AS num_values FROM nation UNION ALL SELECT 'n_nationkey', count(*) FROM nation UNION ALL SELECT 'n_regionkey', count(*) FROM nation")
def parquet_metadata(spark, folder):
    return metadata.parquet_metadata(spark, f"{folder}/nation.parquet").groupBy("path_in_schema").agg(F.sum("num_values").alias("num_values"))


@suite.add("io_text_files", "SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS content, CAST(sum(length(n_name) + 1) AS BIGINT) AS size FROM nation")
def text_files(spark, folder):
    files.copy_to(table(spark, folder, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name"), path := _scratch(spark, "text"), format="text")
    return files.read_text(spark, path).select("content", "size")


@suite.add("io_catalog_columns", "SELECT 'region' AS table_name, 1 AS column_index, 'r_regionkey' AS column_name, 'int' AS data_type, true AS is_nullable UNION ALL SELECT 'region', 2, 'r_name', 'string', true")
def catalog_columns(spark, folder):
    table(spark, folder, "region").createOrReplaceTempView("region")
    return metadata.columns(spark, "region")
