"""Tables of a data folder as DataFrames and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vellumine.session import pin

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Schemas read from footers, by application and path: a table's files do not change while it runs.
_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; only its first reading in an application runs a job to learn the schema."""
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = pin(spark).read.parquet(path).schema
    return pin(spark).read.schema(_schemas[key]).parquet(path)


def views(spark: SparkSession, folder: str, sql: str | None = None) -> SparkSession:
    """Registers the tables that ``sql`` names (all without it) as temporary views."""
    for name in TABLES:
        if sql is None or name in sql:
            table(spark, folder, name).createOrReplaceTempView(name)
    return spark


def run_sql(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    return views(spark, folder, sql).sql(sql)
