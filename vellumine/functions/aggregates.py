"""Aggregates that Spark lacks or defines otherwise; each is a Column for ``agg`` or ``over``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators.lineage import cut
from vellumine.operators.scans import SMALL_ROWS, counted


def arg_max(x: Column, key: Column, tie: Column | None = None) -> Column:
    return F.max_by(x, key if tie is None else F.struct(key, tie))


def arg_min(x: Column, key: Column, tie: Column | None = None) -> Column:
    return F.min_by(x, key if tie is None else F.struct(key, tie))


def arg_min_null(x: Column, key: Column) -> Column:
    """Unlike ``arg_min``, a null ``x`` at the least key counts."""
    return F.min(F.when(key.isNotNull(), F.struct(key.alias("k"), x.alias("x"))))["x"]


def first_in(x: Column, *order: Column) -> Column:
    """``first(x ORDER BY ...)``: null counts."""
    return F.min_by(F.struct(x.alias("x")), F.struct(*order))["x"]


def last_in(x: Column, *order: Column) -> Column:
    return F.max_by(F.struct(x.alias("x")), F.struct(*order))["x"]


def list_all(x: Column, *order: Column) -> Column:
    """``list(x ORDER BY ...)`` with its nulls; for groups whose lists fit a row."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.alias("x")))), lambda s: s["x"])


def arg_n(df: DataFrame, keys: list[str], x: Column, by: Column, n: int, name: str, greatest: bool = False, tie: Column | None = None) -> DataFrame:
    """``arg_min(x, by, n)`` or ``arg_max``: the list of ``x`` at the ``n`` extremes; nulls in ``by`` take no part.

    Ranks are limited to ``n`` before and after the shuffle, so no group gathers in one task.
    """
    order = by.desc() if greatest else by.asc()
    w = Window.partitionBy(*keys).orderBy(order, *([] if tie is None else [tie]))
    top = df.where(by.isNotNull()).select(*keys, x.alias("__x"), F.row_number().over(w).alias("__rn")).where(F.col("__rn") <= n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "__x"))), lambda s: s["__x"]).alias(name))


def least_n(df: DataFrame, keys: list[str], value: str, n: int, name: str) -> DataFrame:
    """``min(value, n)``: the ``n`` least known values in order."""
    return arg_n(df, keys, F.col(value), F.col(value), n, name)


def greatest_n(df: DataFrame, keys: list[str], value: str, n: int, name: str) -> DataFrame:
    return arg_n(df, keys, F.col(value), F.col(value), n, name, greatest=True)


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, bool]], weight: str | None = None) -> DataFrame:
    """Exact quantiles by name: (fraction, whether between two values the line counts).

    Values are counted, then placed by a sort in parts; a group may hold all rows. A row counts ``weight`` times.
    """
    placed = counted(df, keys, value, weight)
    last = (F.col("total") - 1).cast("double")
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))
    out = []
    for name, (share, between) in wanted.items():
        if between:
            low = F.floor(last * share)
            part = F.max(last * share - low)
            a, b = at(low), at(F.ceil(last * share))
            out.append(F.when(part == 0, a.cast("double")).otherwise(a + (b - a) * part).alias(name))
        else:
            out.append(at(F.greatest(F.ceil(F.col("total") * share) - 1, F.lit(0))).alias(name))
    return placed.groupBy(*keys).agg(*out)


def sem(x: Column) -> Column:
    return F.stddev_pop(x) / F.sqrt(F.count(x))


def skewness(x: Column) -> Column:
    """With the correction for small samples."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis(x: Column) -> Column:
    """Sample excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(x) + 6))


def geomean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))


def weighted_avg(x: Column, w: Column) -> Column:
    known = F.when(x.isNotNull(), w)
    return F.sum(x * w) / F.nullif(F.sum(known), F.lit(0.0))


def bitstring_agg(x: Column, low: int, high: int) -> Column:
    """A text of 0 and 1, one place a value between the bounds."""
    seen = F.collect_set(x)
    return F.array_join(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.when(F.array_contains(seen, i.cast("int")), "1").otherwise("0")), "")


def median_deviation(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Median of the distances from the median, each by ``quantiles``; rows are read once, and their counts by value twice."""
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")))
    middle = cut(quantiles(counts, keys, value, {"__median": (0.5, True)}, "__n"))
    match = F.lit(True)
    for i, c in enumerate(keys):
        match = match & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    found = middle.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__median")
    # A join by few keys would gather the counts in as few tasks.
    far = counts.join(F.broadcast(found) if middle.count() <= SMALL_ROWS else found, match).select(*keys, F.abs(F.col(value) - F.col("__median")).alias("__far"), "__n")
    return quantiles(far, keys, "__far", {name: (0.5, True)}, "__n")


def reservoir_quantile(df: DataFrame, keys: list[str], value: str, share: float, name: str, size: int = 8192, seed: int = 7, *unique: str) -> DataFrame:
    """A quantile of at most ``size`` values of each group, those of the least seeded hashes of ``unique``."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *unique, value))
    some = df.where(F.col(value).isNotNull()).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= size)
    return some.groupBy(*keys).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)").alias(name))


def exact_sum(x: Column) -> Column:
    """``fsum``: doubles added up without loss, as decimals of ten places."""
    return F.sum(x.cast("decimal(38,10)")).cast("double")


def exact_avg(x: Column) -> Column:
    """``favg``."""
    return exact_sum(x) / F.nullif(F.count(x), F.lit(0))


def entropy(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Bits of the distribution of a column; counts first, then one row a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    # -sum(p log p) = log(total) - sum(n log n) / total
    return counts.groupBy(*keys).agg((F.log2(F.sum("__n")) - F.sum(F.col("__n") * F.log2("__n")) / F.sum("__n")).alias(name))


def mode(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The commonest value; of equals the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))


def histogram(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Value -> count, as entries in order of the value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "__n")))).alias(name))


def _hull(points: np.ndarray) -> np.ndarray:
    """Places of the convex hull's points, of rows (x, y) in rising order; of equal points the first."""
    if len(points) < 3:
        return np.arange(len(points))
    chains = []
    for turn in (1.0, -1.0):
        chain: list[int] = []
        for i, (x, y) in enumerate(points.tolist()):
            while len(chain) > 1:
                (ax, ay), (bx, by) = points[chain[-2]], points[chain[-1]]
                if turn * ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) >= 0:
                    break
                chain.pop()
            if not chain or tuple(points[chain[-1]]) != (x, y):
                chain.append(i)
        chains += chain
    return np.unique(chains)


def lttb(df: DataFrame, keys: list[str], x: str, y: str, n: int) -> DataFrame:
    """Largest-triangle-three-buckets: ``n`` points of each series that keep its shape.

    Points are placed by a sort in parts and cut into buckets by place. Of a bucket only its convex hull
    can hold the farthest point, so each part sends on hulls, and one small task a series walks through
    those. Points with a null are left out; equal points come once, and of equals in area the first goes.
    """
    if n < 3:
        w = Window.partitionBy(*keys).orderBy(x, y)
        return df.select(*keys, x, y).dropna(subset=[x, y]).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
    known = df.select(*keys, F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("__p")).where(F.col("__p.x").isNotNull() & F.col("__p.y").isNotNull())
    placed = counted(known, keys, "__p")
    # Inner places 1 to total - 2 fall into n - 2 buckets; the ends stand for themselves.
    width = (F.col("total") - 2) / F.lit(float(n - 2))
    edge = lambda k: F.floor(k * width).cast("long") + 1
    guess = F.least(F.floor((F.col("before") - 1) / width), F.lit(n - 3)).cast("long")
    bucket = F.when(F.col("before") < edge(guess), guess - 1).when((F.col("before") >= edge(guess + 1)) & (guess < n - 3), guess + 1).otherwise(guess)
    bucket = F.when(F.col("total") <= n, F.col("before")).when(F.col("before") == 0, -1).when(F.col("before") + F.col("n") >= F.col("total"), n - 2).otherwise(F.greatest(bucket, F.lit(0)))
    rows = placed.select(*keys, bucket.alias("__b"), F.col("__p.x").cast("double").alias("__x"), F.col("__p.y").cast("double").alias("__y"), F.col("n").alias("__n"), F.col("__p.x").alias("__ox"), F.col("__p.y").alias("__oy"), (F.col("total") <= n).alias("__all"))
    by = [*keys, "__b"]
    means = rows.groupBy(*by).agg((F.sum(F.col("__x") * F.col("__n")) / F.sum("__n")).alias("__mx"), (F.sum(F.col("__y") * F.col("__n")) / F.sum("__n")).alias("__my"))
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64("__x", "__y"), F.lit(16)))

    def hull(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__x", "__y"])
        return part if part["__all"].iloc[0] else part.iloc[_hull(part[["__x", "__y"]].to_numpy(float))]

    hulls = spread.groupBy(*by, "__salt").applyInPandas(hull, spread.schema).drop("__salt")

    def walk(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(["__b", "__x", "__y"])
        if series["__all"].iloc[0]:
            return series
        px, py, mx, my = (series[c].to_numpy(float) for c in ("__x", "__y", "__mx", "__my"))
        starts = np.flatnonzero(np.diff(series["__b"].to_numpy(), prepend=-2))
        kept = [0]
        for low, high in zip(starts[1:-1], starts[2:], strict=True):
            ax, ay, cx, cy = px[kept[-1]], py[kept[-1]], mx[high], my[high]
            area = np.abs((ax - cx) * (py[low:high] - ay) - (ax - px[low:high]) * (cy - ay))
            kept.append(int(low) + int(area.argmax()))
        return series.iloc[[*kept, int(starts[-1])]]

    joined = hulls.join(means, by)
    return joined.groupBy(*keys).applyInPandas(walk, joined.schema).select(*keys, F.col("__ox").alias(x), F.col("__oy").alias(y))


def arg_max_null(x: Column, key: Column) -> Column:
    """Unlike ``arg_max``, a null ``x`` at the greatest key counts."""
    return F.max(F.when(key.isNotNull(), F.struct(key.alias("k"), x.alias("x"))))["x"]


def histogram_bins(x: Column, ends: list[float]) -> Column:
    """Counts of values up to each bin's end and above the one before; a last bin takes the rest."""
    counts, low = [], None
    for end in ends:
        inside = x <= end if low is None else (x > low) & (x <= end)
        counts.append(F.struct(F.lit(float(end)).alias("bin"), F.count(F.when(inside, 1)).alias("n")))
        low = end
    return F.array(*counts, F.struct(F.lit(float("inf")).alias("bin"), F.count(F.when(x > ends[-1], 1)).alias("n")))


def rank_within(value, x: Column) -> Column:
    """``rank(value) WITHIN GROUP (ORDER BY x)``: the place the value would take."""
    return F.count(F.when(x < value, 1)) + 1


def dense_rank_within(value, x: Column) -> Column:
    return F.count_distinct(F.when(x < value, x)) + 1


def percent_rank_within(value, x: Column) -> Column:
    return F.count(F.when(x < value, 1)) / F.count(F.lit(1))


def cume_dist_within(value, x: Column) -> Column:
    return (F.count(F.when(x <= value, 1)) + 1) / (F.count(F.lit(1)) + 1)


def distinct_state(x: Column) -> Column:
    """A sketch that merges (``distinct_merge``) and answers (``distinct_finalize``) later."""
    return F.hll_sketch_agg(x)


def distinct_merge(state: Column) -> Column:
    return F.hll_union_agg(state)


def distinct_finalize(state: Column) -> Column:
    return F.hll_sketch_estimate(state)


def moments_state(x: Column) -> Column:
    """Count, sum and sum of squares: enough for count, sum, average and variances."""
    return F.struct(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))


def moments_merge(state: Column) -> Column:
    return F.struct(F.sum(state["n"]).alias("n"), F.sum(state["s"]).alias("s"), F.sum(state["q"]).alias("q"))
