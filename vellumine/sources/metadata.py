"""Parquet footers as rows, read where the files are, and the catalog as frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "file_name string, row_group_id long, row_group_num_rows long, column_id long, path_in_schema string, type string, num_values long, stats_min string, stats_max string, stats_null_count long, compression string, total_compressed_size long, total_uncompressed_size long"

ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _open(path: str):
    """A seekable file of any store that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        path = "/" + path.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem().open_input_file(path)
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _footers(spark: SparkSession, path: str, fields: str, rows_of) -> DataFrame:
    """A row per thing that ``rows_of`` finds in a file's metadata. Spark lists the files; tasks read only their footers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _open(name) as file:
                    rows = rows_of(name, pq.ParquetFile(file))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.mapInArrow(run, fields)


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row per column chunk."""

    def chunks(name, file):
        rows = []
        for g in range(file.metadata.num_row_groups):
            group = file.metadata.row_group(g)
            for c in range(group.num_columns):
                chunk = group.column(c)
                s = chunk.statistics
                known = s is not None and s.has_min_max
                rows.append((name, g, group.num_rows, c, chunk.path_in_schema, chunk.physical_type, chunk.num_values, str(s.min) if known else None, str(s.max) if known else None, s.null_count if s is not None else None, chunk.compression, chunk.total_compressed_size, chunk.total_uncompressed_size))
        return rows

    return _footers(spark, path, FIELDS, chunks)


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    """A row per leaf column."""

    def leaves(name, file):
        found = (file.schema.column(i) for i in range(len(file.schema)))
        return [(name, c.name, c.path, c.physical_type, str(c.logical_type), c.max_definition_level, c.max_repetition_level) for c in found]

    return _footers(spark, path, "file_name string, name string, path_in_schema string, type string, logical_type string, max_definition_level int, max_repetition_level int", leaves)


def parquet_file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row per file."""

    def whole(name, file):
        m = file.metadata
        return [(name, m.created_by, m.num_rows, m.num_row_groups, m.format_version, m.serialized_size)]

    return _footers(spark, path, "file_name string, created_by string, num_rows long, num_row_groups long, format_version string, footer_size long", whole)


def parquet_kv_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row per key of a file's own metadata."""
    return _footers(spark, path, "file_name string, key binary, value binary", lambda name, file: [(name, k, v) for k, v in (file.metadata.metadata or {}).items()])


def columns(spark: SparkSession, *tables: str) -> DataFrame:
    """A row a column of the named tables or views."""
    rows = [(t, i + 1, c.name, c.dataType, c.nullable) for t in tables for i, c in enumerate(spark.catalog.listColumns(t))]
    return spark.createDataFrame(rows, "table_name string, column_index int, column_name string, data_type string, is_nullable boolean")


def tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()], "table_name string, table_type string, temporary boolean")


def settings(spark: SparkSession) -> DataFrame:
    return spark.sql("SET -v").select(F.col("key").alias("name"), "value", F.col("meaning").alias("description"))


def functions(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW FUNCTIONS").select(F.col("function").alias("function_name"))
