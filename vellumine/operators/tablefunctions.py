"""Table functions: JSON walks, series, queries given as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_each(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row per member of a JSON object or array: key (or place) and value as text."""
    parsed = df.select(*keep, F.try_parse_json(column).alias("__v")).where("__v IS NOT NULL")
    parsed.createOrReplaceTempView("__vl_json_each")
    names = ", ".join(f"j.`{k}`" for k in keep)
    return df.sparkSession.sql(f"SELECT {names}, coalesce(t.key, CAST(t.pos AS STRING)) AS key, CAST(t.value AS STRING) AS value FROM __vl_json_each j, LATERAL variant_explode(j.__v) t")


def json_tree(df: DataFrame, column: str, keep: list[str], depth: int = 16) -> DataFrame:
    """A row per value at any depth (to ``depth``): its path and text. One generator a level, no rows kept back."""
    level = df.select(*keep, F.lit("$").alias("path"), F.try_parse_json(column).alias("__v")).where("__v IS NOT NULL")
    out = level.select(*keep, "path", F.col("__v").cast("string").alias("value"))
    for _ in range(depth):
        level.createOrReplaceTempView("__vl_json_tree")
        names = ", ".join(f"j.`{k}`" for k in keep)
        nested = df.sparkSession.sql(f"SELECT {names}, concat(j.path, CASE WHEN t.key IS NULL THEN concat('[', t.pos, ']') ELSE concat('.', t.key) END) AS path, t.value AS __v FROM __vl_json_tree j, LATERAL variant_explode(j.__v) t")
        if nested.isEmpty():
            return out
        out = out.unionByName(nested.select(*keep, "path", F.col("__v").cast("string").alias("value")))
        level = nested
    raise ValueError(f"values nest deeper than {depth}")


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "generate_series") -> DataFrame:
    """Both ends included."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def with_ordinality(df: DataFrame, column: str, item: str, ordinality: str = "ordinality") -> DataFrame:
    """A row an item of a list, with its place from 1."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("__at", item)).select(*rest, item, (F.col("__at") + 1).cast("long").alias(ordinality))


def split_to_table(df: DataFrame, column: str, pattern: str, item: str) -> DataFrame:
    """``regexp_split_to_table``: a row a part of a text."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.split(column, pattern, -1)).alias(item))


def query(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def query_table(spark: SparkSession, names: list[str], by_name: bool = False) -> DataFrame:
    """All rows of the named tables, by place or by name."""
    out = spark.table(names[0])
    for n in names[1:]:
        out = out.unionByName(spark.table(n), allowMissingColumns=True) if by_name else out.union(spark.table(n))
    return out


def unnest(df: DataFrame, *lists: str, recursive: bool = False) -> DataFrame:
    """Lists side by side, shorter ones padded with nulls; ``recursive`` also opens structs."""
    rest = [c for c in df.columns if c not in lists]
    zipped = df.select(*rest, F.explode(F.arrays_zip(*lists)).alias("__z")).select(*rest, *[F.col(f"__z.{c}").alias(c) for c in lists])
    if not recursive:
        return zipped
    out: list[Column] = []
    for f in zipped.schema.fields:
        if f.name in lists and f.dataType.typeName() == "struct":
            out += [F.col(f"{f.name}.{m.name}").alias(m.name) for m in f.dataType.fields]
        else:
            out.append(F.col(f.name))
    return zipped.select(*out)
