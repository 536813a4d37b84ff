"""Set operations by name, star expressions, pivots of a summary, merges and table summaries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_by_name(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    """UNION [ALL] BY NAME: missing columns are null, names are case-insensitive."""
    out = a.unionByName(b, allowMissingColumns=True)
    return out.distinct() if distinct else out


def star(df: DataFrame, exclude: tuple[str, ...] = (), replace: dict[str, Column] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """``* EXCLUDE (...) REPLACE (...) RENAME (...)``."""
    replace, rename = replace or {}, rename or {}
    return df.select(*[replace.get(c, F.col(c)).alias(rename.get(c, c)) for c in df.columns if c not in exclude])


def columns(df: DataFrame, pattern: str, body: Callable[[Column], Column] = lambda c: c) -> list[Column]:
    """``COLUMNS('regex')`` inside an expression, one result a matching column, under its name."""
    return [body(F.col(c)).alias(c) for c in df.columns if re.search(pattern, c)]


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column] | None = None, delete: Column | None = None, insert: bool = True) -> DataFrame:
    """MERGE INTO as one full join; source columns are named ``s_<column>`` in ``update`` and ``delete``.

    Source rows must be unique by key, else it is an error.
    """
    if not source.dropna(subset=keys).groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("several source rows have the same key")
    t = target.withColumn("__t", F.lit(True))
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns]).withColumn("__s", F.lit(True))
    condition = None
    for k in keys:
        same = F.col(k) == F.col(f"s_{k}")
        condition = same if condition is None else condition & same
    joined = t.join(s, condition, "full")
    matched = F.col("__t") & F.col("__s")
    if delete is not None:
        joined = joined.where(~F.coalesce(matched & delete, F.lit(False)))
    if not insert:
        joined = joined.where("__t")
    update = update or {}
    return joined.select(*[F.when(F.col("__t").isNull(), F.col(f"s_{c}") if c in source.columns else F.lit(None)).when(F.col("__s"), update.get(c, F.col(c))).otherwise(F.col(c)).alias(c) for c in target.columns])


def summarize(df: DataFrame) -> DataFrame:
    """A row a column: least, greatest, count and nulls; one pass over the table."""
    parts = []
    for c in df.columns:
        parts += [F.min(c).cast("string").alias(f"{c}__min"), F.max(c).cast("string").alias(f"{c}__max"), F.count(c).alias(f"{c}__n"), F.count(F.lit(1)).alias(f"{c}__all")]
    row = df.agg(*parts)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"), F.col(f"{c}__n").alias("count"), (F.col(f"{c}__all") - F.col(f"{c}__n")).alias("nulls")) for c in df.columns]
    return row.select(F.inline(F.array(*structs)))
