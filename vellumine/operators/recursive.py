"""Recursion to a fixpoint with duplicates removed, and recursion that keeps one row a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators.lineage import cut


#: Rounds whose rows are written together again.
COMPACT = 20


def union_distinct(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rounds over the rows that are new, until none is.

    Each round is written once; of twenty, one table is made.
    """
    known = fresh = cut(anchor.distinct())
    for number in range(1, most_rounds + 1):
        found = step(fresh).select(*known.columns).distinct()
        fresh = cut(found.exceptAll(found.intersect(known)))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
        if number % COMPACT == 0:
            known = cut(known)
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def using_key(anchor: DataFrame, keys: list[str], step: Callable[[DataFrame, DataFrame], DataFrame], prefer: str | None = None, most_rounds: int = 1000, combine: dict[str, Callable] | None = None) -> DataFrame:
    """Recursion with a table of one row a key; a round's row replaces it where ``prefer`` is smaller.

    With ``combine`` instead, a column's aggregate by name (as ``{"total": F.sum}``), the table has these over the rows
    of all rounds and of other columns the latest; recursion ends when a round gives no rows.

    ``step`` gets the rows that changed and the whole table.
    """
    if combine:
        return _combined(anchor, keys, step, combine, most_rounds)
    pick = lambda df: df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(prefer, *[c for c in df.columns if c not in keys]))).where("__rn = 1").drop("__rn")
    state = changed = cut(pick(anchor))
    for _ in range(most_rounds):
        offered = pick(step(changed, state).select(*state.columns))
        now = state.select(*keys, F.col(prefer).alias("__old"))
        changed = cut(offered.join(now, keys, "left").where(F.col("__old").isNull() | (F.col(prefer) < F.col("__old"))).drop("__old"))
        if changed.isEmpty():
            return state
        state = cut(state.join(changed.select(*keys), keys, "left_anti").unionByName(changed))
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def _combined(anchor: DataFrame, keys: list[str], step: Callable[[DataFrame, DataFrame], DataFrame], combine: dict[str, Callable], most_rounds: int) -> DataFrame:
    columns = anchor.columns
    latest = lambda c: F.max_by(F.struct(c), "__round")[c].alias(c)
    fold = lambda df: df.groupBy(*keys).agg(*[combine[c](c).alias(c) if c in combine else latest(c) for c in columns if c not in keys]).select(*columns)
    every = fresh = cut(anchor.withColumn("__round", F.lit(0)))
    for number in range(1, most_rounds + 1):
        fresh = cut(step(fresh.drop("__round"), fold(every)).select(*columns).withColumn("__round", F.lit(number)))
        if fresh.isEmpty():
            return fold(every)
        every = every.unionByName(fresh)
        if number % COMPACT == 0:
            every = cut(every)
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def search_order(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], by: list[str], breadth: bool = False, cycle: list[str] | None = None, most_rounds: int = 1000) -> DataFrame:
    """UNION ALL recursion with ``ordering``, an array that sorts rows in depth or breadth first order.

    With ``cycle`` columns, ``is_cycle`` marks a row whose values stand on its own way already, and it goes no
    further. ``step`` gets rows with the columns of ``anchor`` and keeps ``__way`` and ``__seen`` as they are.
    """
    columns = anchor.columns
    here = lambda: F.struct(*by)
    mark = lambda: F.struct(*(cycle or by))
    rows = cut(anchor.withColumn("__way", F.array(here())).withColumn("__seen", F.array(mark())).withColumn("is_cycle", F.lit(False)))
    out = rows
    for _ in range(most_rounds):
        found = step(rows.where(~F.col("is_cycle"))).select(*columns, "__way", "__seen")
        again = F.array_contains("__seen", mark()) if cycle else F.lit(False)
        rows = cut(found.withColumn("is_cycle", again).withColumn("__way", F.concat("__way", F.array(here()))).withColumn("__seen", F.concat("__seen", F.array(mark()))))
        if rows.isEmpty():
            ordering = F.struct(F.size("__way").alias("depth"), F.col("__way").alias("way")) if breadth else F.col("__way")
            return out.select(*columns, ordering.alias("ordering"), *(["is_cycle"] if cycle else []))
        out = out.unionByName(rows)
    raise RuntimeError(f"no end after {most_rounds} rounds")
