"""Sorted scans in parts: running values whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators.lineage import cut


#: With more rows than this of one key, rows are sorted into parts and values carried across them.
SPLIT_ROWS = 1_000_000


def hot(df: DataFrame, keys: list[str], split_rows: int = SPLIT_ROWS) -> bool:
    """Whether a key has more than so many rows; counted before any shuffle."""
    return bool(df.groupBy(*keys).count().where(F.col("count") > split_rows).limit(1).count())


def in_parts(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` sorted by keys, then order, with ``__part`` and, within it, ``__at``; cut, so that all uses see the same parts."""
    placed = df.orderBy(*keys, *order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    return cut(placed)


def _named_apart(by: list[str]) -> tuple[list[Column], Column]:
    """The columns under other names, and null-safe equality with those."""
    match = F.lit(True)
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"__o{i}"))
    return [F.col(c).alias(f"__o{i}") for i, c in enumerate(by)], match


def carried(parts: DataFrame, keys: list[str], value: str, name: str, ahead: bool = False) -> DataFrame:
    """Adds the last known ``value`` of the same keys at or before each row (``ahead``: the next, at or behind it)."""
    by = ["__part", *keys]
    order = F.desc("__at") if ahead else F.asc("__at")
    inside = parts.withColumn("__own", F.last(value, True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    known = F.when(F.col(value).isNotNull(), F.col("__at"))
    ends = parts.groupBy(*by).agg((F.min_by if ahead else F.max_by)(F.col(value), known).alias("__end"))
    across = Window.partitionBy(*keys).orderBy(F.desc("__part") if ahead else F.asc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that run on from another part have one: at most one row a part.
    runs_on = ends.withColumn("__carry", F.last("__end", True).over(across)).where("__carry IS NOT NULL").select(*by, "__carry")
    apart, match = _named_apart(by)
    joined = inside.join(F.broadcast(runs_on.select(*apart, "__carry")), match, "left")
    return joined.withColumn(name, F.coalesce("__own", "__carry")).drop("__own", "__carry", *[f"__o{i}" for i in range(len(by))])


#: Tables of at most so many short rows are joined by broadcast.
SMALL_ROWS = 100_000


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, total: str, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Adds the place of each row among its keys, from 1, and their number of rows.

    Where a key has more than ``split_rows`` rows, or all rows do without keys, rows are sorted into parts,
    and the rows of earlier parts added; ``order`` should end in a unique column.
    """
    if not hot(df, keys, split_rows):
        w = Window.partitionBy(*keys)
        return df.withColumns({name: F.row_number().over(w.orderBy(*order)).cast("long"), total: F.count(F.lit(1)).over(w)})
    parts = in_parts(df, keys, order)
    by = ["__part", *keys]
    spans = cut(parts.groupBy(*by).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")))
    w = Window.partitionBy(*keys).orderBy("__part")
    apart, match = _named_apart(by)
    earlier = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select(*apart, (earlier - F.col("__first") + 1).alias("__shift"), F.sum("__n").over(Window.partitionBy(*keys)).alias(total))
    placed = parts.join(F.broadcast(starts) if spans.count() <= SMALL_ROWS else starts, match)
    return placed.withColumn(name, F.col("__at") + F.col("__shift")).select(*df.columns, name, total)


def counted(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """A row a distinct known value: its rows ``n``, how many stand ``before`` it among its keys, and ``total``.

    Values are counted before they are sorted, and places added up part by part, so no key stands in one task.
    A row of ``df`` stands for as many as its ``weight`` says.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    parts = in_parts(counts, keys, [F.asc(value)])
    by = ["__part", *keys]
    sums = cut(parts.groupBy(*by).agg(F.sum("n").alias("__sum")))
    w = Window.partitionBy(*keys).orderBy("__part")
    apart, match = _named_apart(by)
    starts = sums.select(*apart, F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__sum").over(Window.partitionBy(*keys)).alias("total"))
    inside = parts.withColumn("__through", F.sum("n").over(Window.partitionBy(*by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)))
    placed = inside.join(F.broadcast(starts) if sums.count() <= SMALL_ROWS else starts, match)
    return placed.select(*keys, value, "n", (F.col("__start") + F.col("__through") - F.col("n")).alias("before"), "total")
