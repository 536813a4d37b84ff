"""Files in and out: Parquet, CSV, JSON, text and binary, with the options of the dialect."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions.dates import java_pattern


def read_parquet(spark: SparkSession, *paths: str, union_by_name: bool = False, filename: bool = False, file_row_number: bool = False, hive_partitioning: bool = True) -> DataFrame:
    reader = spark.read.option("mergeSchema", union_by_name)
    if not hive_partitioning:
        reader = reader.option("recursiveFileLookup", True)
    return _marked(reader.parquet(*paths), filename, file_row_number)


def _marked(df: DataFrame, filename: bool, row_number: bool = False) -> DataFrame:
    extra = [F.col("_metadata.file_path").alias("filename")] * filename + [F.col("_metadata.row_index").alias("file_row_number")] * row_number
    return df.select("*", *extra) if extra else df


def sniff_csv(spark: SparkSession, path: str, lines: int = 64) -> dict:
    """Delimiter, quote and header, from the first lines of the first file."""
    head = [r[0] for r in spark.read.text(path).limit(lines).collect()]
    sample = "\n".join(head)
    try:
        dialect = csv.Sniffer().sniff(sample, delimiters=",;\t|")
        sep, quote = dialect.delimiter, dialect.quotechar or '"'
    except csv.Error:
        sep, quote = ",", '"'
    rows = list(csv.reader(head, delimiter=sep, quotechar=quote))
    number = lambda v: v.replace(".", "", 1).lstrip("-").isdigit()
    header = bool(rows) and not any(map(number, rows[0])) and any(any(map(number, r)) for r in rows[1:])
    return {"sep": sep, "quote": quote, "header": header}


def read_csv(spark: SparkSession, path: str, *, schema: str | None = None, sep: str | None = None, header: bool | None = None, quote: str | None = None, escape: str = '"', nullstr: str = "", ignore_errors: bool = False, filename: bool = False, all_varchar: bool = False, skip: int = 0, names: list[str] | None = None, dateformat: str | None = None, timestampformat: str | None = None, comment: str | None = None, encoding: str | None = None, new_line: str | None = None, null_padding: bool = False) -> DataFrame:
    """What is not given is sniffed; types are inferred unless a schema is given.

    Formats of dates are those of ``strftime``. ``skip`` leaves out the first lines of every file and needs a
    schema; ``names`` renames the columns; ``null_padding`` fills short rows with nulls instead of refusing them.
    """
    found = sniff_csv(spark, path) if sep is None or header is None else {}
    sep, header, quote = (a if a is not None else found.get(k, d) for a, k, d in ((sep, "sep", ","), (header, "header", True), (quote, "quote", '"')))
    mode = "DROPMALFORMED" if ignore_errors else "PERMISSIVE" if null_padding else "FAILFAST"
    given = {"comment": comment, "encoding": encoding, "lineSep": new_line, "dateFormat": dateformat and java_pattern(dateformat), "timestampFormat": timestampformat and java_pattern(timestampformat)}
    options = {"sep": sep, "quote": quote, "escape": escape, "nullValue": nullstr, "mode": mode} | {k: v for k, v in given.items() if v is not None}
    if skip:
        if not schema:
            raise ValueError("skipped lines need a schema")
        lines = _without_first(spark, path, skip + header)
        df = lines.select(F.from_csv("value", F.lit(schema), options).alias("r")).select("r.*")
    else:
        reader = spark.read.options(header=header, **options)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", not all_varchar).option("preferDate", True)
        df = _marked(reader.csv(path), filename)
    return df.toDF(*names) if names else df


def _without_first(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Lines of text files but for the first ``n`` of each, which stand in a file's first block."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    first = lines.where("b = 0").withColumn("rn", F.row_number().over(Window.partitionBy("f").orderBy(F.monotonically_increasing_id())))
    return first.where(F.col("rn") > n).select("value").unionByName(lines.where("b > 0").select("value"))


def read_json(spark: SparkSession, path: str, *, layout: str = "newline_delimited", schema: str | None = None, filename: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", layout == "array")
    return _marked((reader.schema(schema) if schema else reader).json(path), filename)


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "json")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: name, size, content."""
    return read_blob(spark, path).withColumn("content", F.decode("content", "UTF-8"))


def read_blob(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), "content")


def glob(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"))


def scan(spark: SparkSession, name: str) -> DataFrame:
    """What ``FROM 'name'`` reads: a table or view, else files by their ending."""
    plain = name.lower().removesuffix(".gz").removesuffix(".zst")
    if plain.endswith((".csv", ".tsv")):
        return read_csv(spark, name)
    if plain.endswith((".json", ".ndjson", ".jsonl")):
        return read_json(spark, name)
    return read_parquet(spark, name) if plain.endswith(".parquet") else spark.table(name)


def from_arrow(spark: SparkSession, table) -> DataFrame:
    """An Arrow table of the driver as a frame; for tables that fit there."""
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame):
    """A result as an Arrow table on the driver; for results that fit there."""
    return df.toArrow()


def copy_returning(df: DataFrame, path: str, **options) -> DataFrame:
    """``copy_to`` that returns a row a file written: its name, size and rows."""
    copy_to(df, path, **options)
    spark, form = df.sparkSession, options.get("format", "parquet")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("filename"), F.col("length").alias("file_size_bytes"))
    reader = spark.read.option("recursiveFileLookup", True)
    rows = (reader.schema(df.schema) if form in ("csv", "json") else reader).format(form).option("header", options.get("header", False)).load(path)
    counts = rows.groupBy(F.col("_metadata.file_path").alias("filename")).agg(F.count(F.lit(1)).alias("count"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    named = files.withColumn("filename", plain("filename"))
    return named.join(counts.withColumn("filename", plain("filename")), "filename", "left").select("filename", F.coalesce("count", F.lit(0)).alias("count"), "file_size_bytes")


def copy_to(df: DataFrame, path: str, *, format: str = "parquet", partition_by: tuple[str, ...] = (), compression: str | None = None, overwrite: bool = False, append: bool = False, write_partition_columns: bool = False, rows_per_file: int | None = None, **options) -> None:
    """COPY TO; partitioned writes put the rows of a partition together first, in several parts if large."""
    if partition_by:
        if write_partition_columns:
            df = df.withColumns({f"__{c}": F.col(c) for c in partition_by})
            partition_by = tuple(f"__{c}" for c in partition_by)
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite" if overwrite else "append" if append else "errorifexists").options(**options)
    if compression:
        writer = writer.option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(format).save(path)
