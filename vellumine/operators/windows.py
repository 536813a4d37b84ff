"""Window features without Spark syntax: GROUPS frames, exclusions, distinct and filtered aggregates, fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators.lineage import cut
from vellumine.operators.scans import SMALL_ROWS, SPLIT_ROWS, carried, hot, in_parts, numbered


def groups_frame(df: DataFrame, partition: list[str], order: Column, start: int, end: int, aggregate: Column, name: str) -> DataFrame:
    """``aggregate`` over the peer groups from ``start`` to ``end`` around the current one."""
    ranked = df.withColumn("__group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    return ranked.withColumn(name, aggregate.over(Window.partitionBy(*partition).orderBy("__group").rangeBetween(start, end))).drop("__group")


def sum_excluding_current(value: str, frame) -> Column:
    """SUM over a frame that holds the current row, EXCLUDE CURRENT ROW; null if nothing else is there."""
    others = F.count(value).over(frame) - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    return F.when(others > 0, F.sum(value).over(frame) - F.coalesce(F.col(value), F.lit(0)))


def sum_excluding_ties(value: str, frame, peers) -> Column:
    """SUM over a frame, EXCLUDE GROUP: without the current row and its peers."""
    others = F.count(value).over(frame) - F.count(value).over(peers)
    return F.when(others > 0, F.sum(value).over(frame) - F.coalesce(F.sum(value).over(peers), F.lit(0)))


def count_distinct_over(value: str, frame) -> Column:
    return F.size(F.collect_set(value).over(frame)).cast("long")


def filtered(aggregate, condition: Column, value: Column, frame) -> Column:
    """An aggregate with FILTER inside a window."""
    return aggregate(F.when(condition, value)).over(frame)


def framed(df: DataFrame, partition: list[str], order: list[Column], value: Column, name: str, before: Column | int, behind: Column | int, reach: tuple[int, int], exclude: str = "no others") -> DataFrame:
    """Adds the values of a ROWS frame as an array, in order, for any aggregate over lists.

    ``before`` and ``behind`` rows, each a number or a column with one a row, but at most ``reach``, which bounds
    what is held. ``exclude``: "no others", "current row", "group" (the row and its peers) or "ties" (its
    peers).
    """
    return framed_all(df, partition, order, value, {name: exclude}, before, behind, reach)


def framed_all(df: DataFrame, partition: list[str], order: list[Column], value: Column, excludes: dict[str, str], before: Column | int, behind: Column | int, reach: tuple[int, int]) -> DataFrame:
    """``framed`` with an array for each name of ``excludes``; rows are sorted and frames gathered once for all."""
    w = Window.partitionBy(*partition).orderBy(*order)
    # Beyond what is held; stands for a null too, which leaves no row.
    beyond = F.lit(-(reach[0] + reach[1] + 2)).cast("long")
    before, behind = (F.greatest(F.coalesce((F.lit(b) if isinstance(b, int) else b).cast("long"), beyond), beyond) for b in (before, behind))
    placed = df.withColumns({"__rn": F.row_number().over(w), "__before": before, "__behind": behind, "__peers": F.rank().over(w), "__alike": F.count(F.lit(1)).over(w.rangeBetween(0, 0))})
    held = placed.withColumn("__held", F.collect_list(F.struct(value.alias("v"))).over(w.rowsBetween(-reach[0], reach[1])))
    rn, first = F.col("__rn"), F.greatest(F.col("__rn") - reach[0], F.lit(1))
    low, high = F.greatest(first, rn - F.col("__before")), F.least(first + F.size("__held") - 1, rn + F.col("__behind"))
    # Peers stand side by side, so what an exclusion leaves is a run of rows before it, one behind and, of ties, the row between.
    part = lambda a, b: F.slice(F.col("__held")["v"], (a - first + 1).cast("int"), F.greatest(b - a + 1, F.lit(0)).cast("int"))
    around = lambda a, b: (part(low, F.least(high, a - 1)), part(F.greatest(low, b + 1), high))
    peers = around(F.col("__peers"), F.col("__peers") + F.col("__alike") - 1)
    row = part(rn, F.when((rn >= low) & (rn <= high), rn).otherwise(rn - 1))
    left = {"no others": (part(low, high),), "current row": around(rn, rn), "group": peers, "ties": (peers[0], row, peers[1])}
    return held.withColumns({name: F.concat(*left[how]) for name, how in excludes.items()}).drop("__rn", "__peers", "__alike", "__before", "__behind", "__held")


def ntile(place: Column, total: Column, n: int) -> Column:
    """NTILE from a row's place and the number of rows: the first tiles take what division leaves."""
    at, size, longer = place - 1, F.floor(total / n), total % n
    edge = longer * (size + 1)
    return F.when(at < edge, F.floor(at / (size + 1))).otherwise(longer + F.floor((at - edge) / F.greatest(size, F.lit(1)))) + 1


def peer_ranks(df: DataFrame, partition: list[str], by: str, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Adds ``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist`` in the order of ``by``, nulls last.

    Rows are counted by value before anything is sorted, so a partition may hold any share of them.
    """
    counts, order = cut(df.groupBy(*partition, by).agg(F.count(F.lit(1)).alias("__n"))), F.col(by).asc_nulls_last()
    if hot(counts, partition, split_rows):
        places = numbered(df, partition, [order], "__place", "__total", split_rows)
        ranks = places.groupBy(*partition, by, "__total").agg(F.min("__place").alias("rank"), F.max("__place").alias("__through"))
        ranks = numbered(ranks, partition, [order], "dense_rank", "__values", split_rows).drop("__values")
    else:
        w = Window.partitionBy(*partition).orderBy(order)
        ranks = counts.withColumns({"dense_rank": F.row_number().over(w).cast("long"), "__through": F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__total": F.sum("__n").over(Window.partitionBy(*partition))})
        ranks = ranks.withColumn("rank", F.col("__through") - F.col("__n") + 1)
    last = F.col("__total") - 1
    shares = {"percent_rank": F.when(last > 0, (F.col("rank") - 1) / last).otherwise(0.0), "cume_dist": F.col("__through") / F.col("__total")}
    found, match = ranks.withColumns(shares), F.lit(True)
    keys = [*partition, by]
    for i, c in enumerate(keys):
        match = match & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    names = ["rank", "dense_rank", *shares]
    found = found.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(keys)], *names)
    return df.join(F.broadcast(found) if counts.count() <= SMALL_ROWS else found, match).select(*df.columns, *names)


def fill(df: DataFrame, partition: list[str], order: str, value: str, name: str, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Nulls of ``value`` interpolated along ``order`` between known neighbours; extrapolated at the ends.

    At an end with two known values on one side the line through them is continued; with one, it repeats.
    Between keys that are equal, the earlier value stands. Rows whose key is null or not finite keep what
    they have and, like values that are not finite, are no neighbours to others. Partitions of more than
    ``split_rows`` rows are sorted into parts, and known values carried across them.
    """
    x, y = F.col(order).cast("double"), F.col(value).cast("double")
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    marked = df.withColumn("__known", F.when(finite(x) & finite(y), F.struct(x.alias("x"), y.alias("y"))))
    near = _neighbours_split if hot(df, partition, split_rows) else _neighbours
    marked, extra = near(marked, partition, order)
    # With nothing known before a row, the line runs through the first two known; with nothing behind, the last two.
    start = F.when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.coalesce("__last_but_one", "__a")).otherwise(F.col("__a"))
    end = F.when(F.col("__a").isNull(), F.coalesce("__second", "__b")).otherwise(F.coalesce("__b", "__a"))
    lined = marked.withColumn("__from", start).withColumn("__to", end)
    line = F.col("__from.y") + (x - F.col("__from.x")) * (F.col("__to.y") - F.col("__from.y")) / F.nullif(F.col("__to.x") - F.col("__from.x"), F.lit(0.0))
    filled_in = F.coalesce(y, F.when(finite(x), F.coalesce(line, F.col("__from.y"))))
    return lined.withColumn(name, filled_in).drop("__known", "__a", "__second", "__b", "__last_but_one", "__from", "__to", *extra)


def _neighbours(marked: DataFrame, partition: list[str], order: str) -> tuple[DataFrame, list[str]]:
    """Adds the known values before and behind each row, and the second from either end."""
    w = Window.partitionBy(*partition).orderBy(F.col(order).asc_nulls_last())
    down = Window.partitionBy(*partition).orderBy(F.desc("__row"))
    before, whole = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.unboundedFollowing)
    marked = marked.withColumn("__row", F.row_number().over(w))
    marked = marked.withColumn("__a", F.last("__known", True).over(w.rowsBetween(*before))).withColumn("__second", F.nth_value("__known", 2, True).over(w.rowsBetween(*whole)))
    marked = marked.withColumn("__b", F.last("__known", True).over(down.rowsBetween(*before))).withColumn("__last_but_one", F.nth_value("__known", 2, True).over(down.rowsBetween(*whole)))
    return marked, ["__row"]


def _neighbours_split(marked: DataFrame, partition: list[str], order: str) -> tuple[DataFrame, list[str]]:
    parts = in_parts(marked, partition, [F.col(order).asc_nulls_last()])
    known, ends = parts.where("__known IS NOT NULL"), []
    for name, at in (("__second", F.asc("__at")), ("__last_but_one", F.desc("__at"))):
        # Ranks are limited to two before the shuffle.
        two = known.withColumn("__rn", F.row_number().over(Window.partitionBy(*partition).orderBy(at))).where("__rn <= 2")
        one = two.where("__rn = 2").select(*[F.col(c).alias(f"{name}{i}") for i, c in enumerate(partition)], F.col("__known").alias(name))
        ends.append((name, one))
    both = carried(carried(parts, partition, "__known", "__a"), partition, "__known", "__b", ahead=True)
    for name, one in ends:
        match = F.lit(True)
        for i, c in enumerate(partition):
            match = match & F.col(c).eqNullSafe(F.col(f"{name}{i}"))
        both = both.join(one, match, "left").drop(*[f"{name}{i}" for i in range(len(partition))])
    return both, ["__part", "__at"]
