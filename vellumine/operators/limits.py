"""Limits by share, with ties, distinct on, and samples of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit_percent(df: DataFrame, percent: float, *order: Column, offset: int = 0) -> DataFrame:
    """The first ``percent`` of all rows, rounded down, after ``offset`` rows.

    Counts first, so the cut is a plain ordered limit and no window needs all rows in one task.
    """
    n = int(df.count() * percent / 100)
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(n)


def limit_of(df: DataFrame, bound: DataFrame, *order: Column, offset: int = 0) -> DataFrame:
    """``LIMIT (SELECT ...)``: as many rows as the one value of ``bound``; all, if that is null or has no row."""
    found = bound.limit(2).collect()
    if len(found) > 1:
        raise ValueError("the bound has several rows")
    ordered = df.orderBy(*order)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if not found or found[0][0] is None else ordered.limit(int(found[0][0]))


class Key:
    """A sort key that remembers its expression and direction; nulls last unless asked otherwise."""

    def __init__(self, column: Column | str, descending: bool = False, nulls_first: bool = False):
        self.column = F.col(column) if isinstance(column, str) else column
        self.name = ("desc" if descending else "asc") + ("_nulls_first" if nulls_first else "_nulls_last")

    def over(self, column: Column) -> Column:
        return getattr(column, self.name)()


def limit_ties(df: DataFrame, n: int, *order: Key) -> DataFrame:
    """The first ``n`` rows and all that tie with the last of them."""
    keys = [f"__key{i}" for i in range(len(order))]
    marked = df.withColumns({k: o.column for k, o in zip(keys, order, strict=True)})
    top = marked.orderBy(*[o.over(F.col(k)) for k, o in zip(keys, order, strict=True)]).limit(n)
    last = top.select(*keys).distinct().select(*[F.col(k).alias(f"{k}_top") for k in keys])
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"{k}_top"))
        condition = same if condition is None else condition & same
    # At most n distinct keys, the caller's constant.
    return marked.join(F.broadcast(last), condition, "left_semi").drop(*keys)


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def sample_rows(df: DataFrame, n: int, seed: int, *unique: str) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), those of the least seeded hashes of ``unique``."""
    return df.orderBy(_draw(seed, unique), *unique).limit(n)


def sample_share(df: DataFrame, percent: float, seed: int, *unique: str) -> DataFrame:
    """TABLESAMPLE: each row with the given chance, by a seeded hash of ``unique``, so that runs agree."""
    return df.where(F.conv(F.substring(_draw(seed, unique), 1, 13), 16, 10).cast("double") < percent / 100 * float(1 << 52))


def _draw(seed: int, unique: tuple[str, ...]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in unique]))
