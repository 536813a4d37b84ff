"""As-of, nearest, positional, range and mark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators.lineage import cut
from vellumine.operators.scans import SPLIT_ROWS, carried, hot, in_parts


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], how: str = "left", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time.

    Both sides go through one shuffle by key; a running last value replaces any pairwise comparison.
    Where a key has more than ``split_rows`` rows, the shuffle is a sort by key and time instead, and values
    are carried from part to part.
    Right rows with a null key or time match nothing. Of right rows with one time, the greatest values win.
    """
    out = left.columns
    l = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*out).alias("__row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__value"))
    usable = right.where(F.col(right_time).isNotNull()).dropna(subset=keys)
    r = usable.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*out)).schema[0].dataType).alias("__row"), F.struct(*values).alias("__value"))
    by, order, both = [f"__k{i}" for i in range(len(keys))], [F.col("__t").asc_nulls_first(), F.asc("__side"), F.col("__value").asc_nulls_first()], l.unionByName(r)
    if hot(both, by, split_rows):
        joined = carried(in_parts(both, by, order), by, "__value", "__found").where("__side = 1")
    else:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        joined = both.withColumn("__found", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    if how == "inner":
        joined = joined.where("__found IS NOT NULL")
    return joined.select(*[F.col(f"__row.{c}").alias(c) for c in out], *[F.col(f"__found.{v}").alias(v) for v in values])


def positional(left: DataFrame, left_order: list[Column], right: DataFrame, right_order: list[Column]) -> DataFrame:
    """The nth row with the nth, null-padded. Places come from sorted partitions, counted part by part."""
    a, b = _numbered(left, left_order), _numbered(right, right_order)
    return a.join(b, "__place", "full").drop("__place")


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    parts = df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    w = Window.partitionBy("__part").orderBy("__at")
    # Cut here: both uses below must see the same partitions.
    inside = cut(parts.withColumn("__rn", F.row_number().over(w)).drop("__at"))
    counts = inside.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row a partition of the sort.
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return inside.join(F.broadcast(starts), "__part").withColumn("__place", F.col("__before") + F.col("__rn")).drop("__part", "__rn", "__before")


def range_join(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points with the intervals that hold them (both ends included), met in cells of ``width``.

    An interval is sent to each cell it touches, a point to one, so the join is an equi-join whose keys
    are cells; choose a width near the usual length of an interval.
    """
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    p = points.withColumn("__cell", cell(F.col(point)))
    i = intervals.where(F.col(low) <= F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    return p.join(i, "__cell").where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__cell")


def mark(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str) -> DataFrame:
    """Each left row with ``left_key IN (right)`` in three-valued logic."""
    facts = right.agg(F.count(F.lit(1)).alias("__n"), F.count(right_key).alias("__known"))
    keys = right.where(F.col(right_key).isNotNull()).select(F.col(right_key).alias("__r")).distinct().withColumn("__hit", F.lit(True))
    # A one-row table of two counts.
    joined = left.join(keys, F.col(left_key) == F.col("__r"), "left").join(F.broadcast(facts))
    value = F.when(F.col("__n") == 0, F.lit(False)).when(F.col(left_key).isNull(), F.lit(None)).when(F.col("__hit"), F.lit(True)).when(F.col("__known") < F.col("__n"), F.lit(None)).otherwise(F.lit(False))
    return joined.withColumn(name, value.cast("boolean")).drop("__r", "__hit", "__n", "__known")


def nearest(left: DataFrame, left_value: str, right: DataFrame, right_value: str, keys: list[str], values: list[str], k: int = 1, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Each left row with the ``k`` right rows of its keys whose values are nearest (ties: the lower value, then
    the least ``values``).

    With ``k`` of 1 every left row stays, with nulls if nothing matches, and the neighbours below and above
    come from two running windows, one in either direction, over one shuffle; keys of more than ``split_rows`` rows as in ``asof``. With
    more, a row comes for each neighbour, with its ``rank``, and left rows without one go; the windows hold
    the ``k`` last values at a time.
    """
    out = left.columns
    kind = right.select(F.struct(F.col(right_value).alias("__v"), *values)).schema[0].dataType
    l = left.select(*keys, F.col(left_value).alias("__x"), F.struct(*out).alias("__row"), F.lit(None).cast(kind).alias("__value"), F.lit(1).alias("__side"))
    known = right.where(F.col(right_value).isNotNull()).dropna(subset=keys).select(*keys, F.col(right_value).alias("__x"), F.struct(F.col(right_value).alias("__v"), *values).alias("__value"))
    if k == 1:
        # Of right rows at one place only the least can be taken, from below or above.
        known = known.groupBy(*keys, "__x").agg(F.min("__value").alias("__value"))
    r = known.withColumns({"__row": F.lit(None).cast(left.select(F.struct(*out)).schema[0].dataType), "__side": F.lit(0)})
    both, x = l.unionByName(r), F.col("__x")
    if k > 1:
        return _several(both, keys, out, values, k)
    order = [F.asc("__x"), F.asc("__side")]
    if hot(both, keys, split_rows):
        both = carried(carried(in_parts(both, keys, order), keys, "__value", "__below"), keys, "__value", "__above", ahead=True)
    else:
        # A frame that ends with the partition is added up anew for each row, so the rows behind come from the order turned round.
        up, down = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(F.desc("__x"), F.desc("__side"))
        both = both.withColumn("__below", F.last("__value", True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__above", F.last("__value", True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    take_below = F.col("__above").isNull() | (x - F.col("__below.__v") <= F.col("__above.__v") - x)
    best = F.when(x.isNotNull(), F.when(F.col("__below").isNotNull() & take_below, F.col("__below")).otherwise(F.col("__above")))
    return both.where("__side = 1").withColumn("__best", best).select(*[F.col(f"__row.{c}").alias(c) for c in out], *[F.col(f"__best.{v}").alias(v) for v in values])


def _several(both: DataFrame, keys: list[str], out: list[str], values: list[str], k: int) -> DataFrame:
    """The ``k`` nearest: those among the ``k`` right rows before and the ``k`` behind, by their places among the right rows.

    Right rows of one value have two places: the least ``values`` come last to those who look down, first to those who look up.
    """
    place = lambda value: F.sum(F.when(F.col("__side") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(F.asc("__x"), F.asc("__side"), value).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumns({"__down": place(F.desc("__value")), "__up": place(F.asc("__value"))})
    ways = F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("__down").alias("p")), F.struct(F.lit(1).alias("w"), F.col("__up").alias("p"))))
    right = placed.where("__side = 0").select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(keys)], ways.alias("__rplace"), F.col("__value").alias("__found"))
    wanted = F.transform(F.sequence(F.col("__up") - k + 1, F.col("__up") + k), lambda p: F.struct((p > F.col("__up")).cast("int").alias("w"), p.alias("p")))
    left = placed.where("__side = 1 AND __x IS NOT NULL").withColumn("__id", F.monotonically_increasing_id()).withColumn("__rplace", F.explode(wanted))
    near = left.join(right, [left["__rplace"] == right["__rplace"], *[left[c] == right[f"__r{i}"] for i, c in enumerate(keys)]])
    best = Window.partitionBy("__id").orderBy(F.abs(F.col("__x") - F.col("__found.__v")), "__found.__v", "__found")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(*[F.col(f"__row.{c}").alias(c) for c in out], *[F.col(f"__found.{v}").alias(v) for v in values], "rank")


def right_semi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Right rows that a left row matches, once each."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Right rows that no left row matches."""
    return right.join(left, on, "left_anti")
