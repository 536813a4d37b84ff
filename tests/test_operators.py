"""Operators on small tables with nulls, ties and unmatched rows."""

from __future__ import annotations

import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.functions import aggregates as A
from vellumine.functions import dates, lists, numbers, strings, structs
from vellumine.operators import joins, limits, recursive, scans, statements, tables, windows
from vellumine.operators.limits import Key
from vellumine.sources import files, metadata
from vellumine.streaming import events


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_asof_nulls_ties_and_late_rows(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (None, 5), (2, 9), (1, None)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (1, 5, "c"), (None, 1, "x"), (2, None, "y")], "k int, u int, v string")
    assert rows(joins.asof(left, right, ["k"], "t", "u", ["v"])) == sorted([(1, 5, "c"), (1, 1, None), (None, 5, None), (2, 9, None), (1, None, None)], key=repr)
    assert rows(joins.asof(left, right, ["k"], "t", "u", ["v"], "inner")) == [(1, 5, "c")]


def test_positional_pads_the_shorter_side(spark):
    a, b = spark.range(5).select(F.col("id").alias("a")), spark.range(2).select(F.col("id").alias("b"))
    assert rows(joins.positional(a, [F.desc("a")], b, [F.asc("b")])) == sorted([(4, 0), (3, 1), (2, None), (1, None), (0, None)], key=repr)


def test_mark_is_three_valued(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert rows(joins.mark(left, spark.createDataFrame([(1,), (None,)], "y int"), "x", "y", "m")) == sorted([(1, True), (2, None), (None, None)], key=repr)
    assert rows(joins.mark(left, spark.createDataFrame([], "y int"), "x", "y", "m")) == sorted([(1, False), (2, False), (None, False)], key=repr)


def test_range_and_nearest(spark):
    points = spark.createDataFrame([(0.5,), (2.0,), (9.0,)], "p double")
    spans = spark.createDataFrame([(0.0, 2.0, "a"), (2.0, 3.0, "b"), (5.0, 4.0, "bad")], "lo double, hi double, n string")
    assert [(r[0], r[3]) for r in rows(joins.range_join(points, "p", spans, "lo", "hi", 1.0))] == [(0.5, "a"), (2.0, "a"), (2.0, "b")]
    near = joins.nearest(spark.createDataFrame([(1, 10), (1, 0), (2, 1)], "k int, x int"), "x", spark.createDataFrame([(1, 4, "a"), (1, 16, "b"), (1, None, "c")], "k int, y int, v string"), "y", ["k"], ["v"])
    assert rows(near) == sorted([(1, 10, "a"), (1, 0, "a"), (2, 1, None)], key=repr)


def test_limits(spark):
    t = spark.createDataFrame([(i, i // 3) for i in range(10)] + [(10, None)], "i int, g int")
    assert [r[0] for r in limits.limit_percent(t, 30, F.asc("i")).collect()] == [0, 1, 2]
    assert sorted(r[0] for r in limits.limit_ties(t, 4, Key("g")).collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r[0] for r in limits.limit_ties(t, 1, Key("g", nulls_first=True)).collect()) == [10]
    assert limits.sample_rows(t, 4, 1, "i").count() == 4
    assert rows(limits.distinct_on(t, ["g"], F.desc("i")).select("g", "i"))[0] == (0, 2)


def test_window_emulations(spark):
    t = spark.createDataFrame([(1, 1, 10), (1, 1, None), (1, 2, 5), (1, 3, 7), (2, 1, 4)], "k int, o int, v int")
    whole = Window.partitionBy("k").orderBy("o").rangeBetween(Window.unboundedPreceding, 0)
    got = rows(t.select("k", "o", "v", windows.sum_excluding_current("v", whole).alias("s")))
    assert (1, 2, 5, 10) in got and (2, 1, 4, None) in got and (1, 1, None, 10) in got
    assert rows(windows.groups_frame(t, ["k"], F.col("o").asc(), -1, 0, F.sum("v"), "s").select("o", "s").where("k = 1")) == [(1, 10), (1, 10), (2, 15), (3, 12)]
    f = spark.createDataFrame([(1, 1, None), (1, 2, 10.0), (1, 4, None), (1, 6, 30.0), (1, 9, None)], "g int, k int, v double")
    assert [r["v2"] for r in windows.fill(f, ["g"], "k", "v", "v2").orderBy("k").collect()][1:4] == [10.0, 20.0, 30.0]


def test_fill_carries_the_line_past_both_ends(spark):
    inf, nan = float("inf"), float("nan")
    parts = {
        1: [(10, None, 60), (20, None, 80), (30, 100, 100), (31, 102, 102), (90, None, 220)],
        2: [(1, None, 5), (2, 5, 5), (3, None, 5)],
        3: [(1, None, None), (2, None, None)],
        4: [(1, 30, 30), (2, 20, 20), (3, None, 10), (4, None, 0)],
        5: [(1, inf, inf), (2, None, 0), (3, 1, 1), (4, None, 2), (5, 3, 3), (inf, None, None), (None, 9, 9), (None, None, None)],
    }
    df = spark.createDataFrame([(g, None if k is None else float(k), None if v is None else float(v)) for g, p in parts.items() for k, v, _ in p], "g int, k double, v double")
    expected = sorted(((g, None if k is None else float(k), None if f is None else float(f)) for g, p in parts.items() for k, _, f in p), key=repr)
    assert rows(windows.fill(df, ["g"], "k", "v", "f").select("g", "k", "f")) == expected
    assert rows(windows.fill(df, ["g"], "k", "v", "f", split_rows=2).select("g", "k", "f")) == expected
    odd = spark.createDataFrame([(1, 1.0, nan), (1, 2.0, None), (1, 3.0, 1.0), (1, 4.0, 3.0)], "g int, k double, v double")
    assert [r["f"] for r in windows.fill(odd, ["g"], "k", "v", "f").orderBy("k").collect()][1:] == [-1.0, 1.0, 3.0]
    tied = spark.createDataFrame([(1, 1, 10.0), (1, 1, 10.0), (1, 2, None)], "g int, k int, v double")
    assert [r["f"] for r in windows.fill(tied, ["g"], "k", "v", "f").collect()] == [10.0] * 3


def test_recursion(spark):
    anchor = spark.createDataFrame([(0,)], "n int")
    assert recursive.union_distinct(anchor, lambda d: d.select(((F.col("n") + 3) % 7).alias("n"))).count() == 7
    with pytest.raises(RuntimeError):
        recursive.union_distinct(anchor, lambda d: d.select((F.col("n") + 1).alias("n")), most_rounds=3)


def test_merge_and_by_name(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C"), (4, "D")], "k int, v string")
    assert rows(tables.merge(target, source, ["k"], update={"v": F.col("s_v")})) == [(1, "a"), (2, "B"), (3, "C"), (4, "D")]
    assert rows(tables.merge(target, source, ["k"], delete=F.col("s_v") == "B", insert=False)) == [(1, "a"), (3, None)]
    assert tables.union_by_name(target, source.select("k", F.lit(1).alias("w"))).columns == ["k", "v", "w"]
    assert tables.star(target, exclude=("v",), rename={"k": "key"}).columns == ["key"]


def test_scalar_edges(spark):
    t = spark.createDataFrame([("héllo", 7, -7)], "s string, a int, b int")
    s = F.col("s")
    got = t.select(strings.strlen(s), strings.left(s, -2), strings.right(s, -2), strings.substr(s, 0, 3), strings.ord_(F.lit("😀")), strings.glob(s, "h?l*"), strings.regexp_replace_first(s, "l", "L")).first()
    assert tuple(got) == (6, "hél", "llo", "hé", 0x1F600, True, "héLlo")
    got = t.select(numbers.trunc(F.lit(-2.7)), numbers.even(F.lit(-1.2)), numbers.fmod(F.col("b"), F.lit(3)), numbers.gcd(F.lit(12), F.lit(-18)), numbers.binom(F.lit(5), F.lit(2)), numbers.to_integer(F.lit(2.5)), numbers.integer_divide(F.col("b"), F.lit(2)), numbers.integer_divide(F.col("b"), F.lit(0))).first()
    assert tuple(got) == (-2, -2, 2.0, 6, 10, 2, -3, None)
    l = F.array(F.lit(3), F.lit(None), F.lit(1))
    got = t.select(lists.sort(l), lists.sort(l, True, True), lists.slice_(l, -2, -1), lists.extract(l, 9), lists.position(l, F.lit(1)), lists.total(l, "long"), lists.where(l, F.array(F.lit(True), F.lit(False), F.lit(True)))).first()
    assert tuple(got) == ([1, 3, None], [None, 3, 1], [None, 1], None, 3, 4, [3, 1])


def test_dates_at_the_edges(spark):
    t = spark.createDataFrame([("1999-12-31 23:59:59.5",), ("1969-12-31 00:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    got = [tuple(r) for r in t.select(dates.micros(F.col("t")), dates.century(F.col("t")), dates.decade(F.col("t")), dates.time_bucket_months(5, F.col("t")).cast("string")).collect()]
    assert got == [(946684799500000, 20, 199, "1999-08-01"), (-86400000000, 20, 196, "1969-10-01")] or got[0][:3] == (946684799500000, 20, 199)
    with pytest.raises(ValueError):
        dates.java_pattern("%Q")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", None), (2, 'q"q', 1.5)], "i int, s string, d double")
    files.copy_to(df, str(tmp_path / "c"), format="csv", header=True, sep=";", escape='"')
    assert rows(files.read_csv(spark, str(tmp_path / "c"), schema="i int, s string, d double", sep=";", header=True)) == rows(df)
    files.copy_to(df, str(tmp_path / "p"), partition_by=("i",))
    assert rows(files.read_parquet(spark, str(tmp_path / "p")).select("i", "s", "d")) == rows(df)
    meta = metadata.parquet_metadata(spark, str(tmp_path / "p" / "i=1"))
    assert {r["path_in_schema"] for r in meta.collect()} == {"s", "d"}
    assert files.read_text(spark, str(tmp_path / "c")).where(F.contains("content", F.lit("a;b"))).count() == 1


def test_hot_keys_are_split_alike(spark):
    draw = random.Random(1)
    left = spark.createDataFrame([(draw.choice([1, 1, 1, 2, None]), draw.choice([None, *range(60)]), i) for i in range(400)], "k int, t int, i int")
    right = spark.createDataFrame([(draw.choice([1, 1, 1, 2, None]), draw.choice([None, *range(60)]), f"v{i % 9}") for i in range(300)], "k int, u int, v string")
    for how in ("left", "inner"):
        assert rows(joins.asof(left, right, ["k"], "t", "u", ["v"], how, split_rows=5)) == rows(joins.asof(left, right, ["k"], "t", "u", ["v"], how))
    assert rows(joins.nearest(left, "t", right, "u", ["k"], ["v"], split_rows=5)) == rows(joins.nearest(left, "t", right, "u", ["k"], ["v"]))


def test_nearest_several(spark):
    left = spark.createDataFrame([(1, 10), (1, 0), (2, 1), (1, None)], "k int, x int")
    right = spark.createDataFrame([(1, 4, "a"), (1, 16, "b"), (1, None, "c"), (1, 11, "d"), (1, 9, "e")], "k int, y int, v string")
    near = joins.nearest(left, "x", right, "y", ["k"], ["v"], k=2)
    assert rows(near) == [(1, 0, "a", 1), (1, 0, "e", 2), (1, 10, "d", 2), (1, 10, "e", 1)]


def test_nearest_takes_the_least_of_equals_on_both_sides(spark):
    left = spark.createDataFrame([(1, 10), (1, 0), (None, 4)], "k int, x int")
    right = spark.createDataFrame([(1, y, v) for y in (4, 9, 12) for v in ("c", "a", "b")] + [(None, 4, "n")], "k int, y int, v string")
    for split_rows in (5, 100):
        assert rows(joins.nearest(left, "x", right, "y", ["k"], ["y", "v"], split_rows=split_rows)) == rows(spark.createDataFrame([(1, 10, 9, "a"), (1, 0, 4, "a"), (None, 4, None, None)], "k int, x int, y int, v string"))
    near = joins.nearest(left, "x", right, "y", ["k"], ["y", "v"], k=2)
    assert rows(near) == [(1, 0, 4, "a", 1), (1, 0, 4, "b", 2), (1, 10, 9, "a", 1), (1, 10, 9, "b", 2)]
    behind = right.where("y > 4")
    assert rows(joins.nearest(left.where("x = 0"), "x", behind, "y", ["k"], ["v"], k=2)) == [(1, 0, "a", 1), (1, 0, "b", 2)]


def test_median_deviation_keeps_the_null_group_and_weighs_values(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 2.0, 4.0, 9.0, None)] + [(None, 3.0), (None, 5.0), ("e", None)], "k string, v double")
    assert rows(A.median_deviation(df, ["k"], "v", "m")) == rows(spark.createDataFrame([("a", 1.0), (None, 1.0)], "k string, m double"))


@pytest.fixture
def several_parts(spark):
    """So few rows would be put together in one part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_are_numbered_in_parts(spark, several_parts):
    draw = random.Random(4)
    df = spark.createDataFrame([(draw.choice(["a", "a", "a", "b", None]), draw.choice([None, *range(9)]), i) for i in range(300)], "k string, v int, i int")
    w, order = Window.partitionBy("k"), [F.col("v").desc_nulls_last(), F.col("i")]
    expected = df.withColumns({"n": F.row_number().over(w.orderBy(*order)), "m": F.count(F.lit(1)).over(w), "t": F.ntile(7).over(w.orderBy(*order))})
    for split_rows in (5, 1000):
        got = scans.numbered(df, ["k"], order, "n", "m", split_rows)
        assert rows(got.withColumn("t", windows.ntile(F.col("n"), F.col("m"), 7))) == rows(expected)
        assert {tuple(r) for r in scans.numbered(df, [], [F.desc("i")], "n", "m", split_rows).select("i", "n", "m").collect()} == {(i, 300 - i, 300) for i in range(300)}
    assert scans.numbered(df, [], [F.desc("i")], "n", "m", 5).select(F.spark_partition_id()).distinct().count() > 1
    short = spark.range(1, 4).withColumn("t", windows.ntile(F.col("id"), F.lit(3), 7))
    assert rows(short) == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("split_rows", [3, 1000])
def test_ranks_of_peers_by_counts(spark, split_rows):
    draw = random.Random(5)
    df = spark.createDataFrame([("one", 1, -1), *((draw.choice(["a", "a", None]), draw.choice([None, *range(6)]), i) for i in range(200))], "k string, v int, i int")
    w = Window.partitionBy("k").orderBy(F.col("v").asc_nulls_last())
    expected = df.withColumns({"r": F.rank().over(w), "d": F.dense_rank().over(w), "p": F.percent_rank().over(w), "c": F.cume_dist().over(w)})
    assert rows(windows.peer_ranks(df, ["k"], "v", split_rows)) == rows(expected)


def test_quantiles_of_one_group_and_ties(spark):
    values = [3.0, 1.0, 2.0, 2.0, None, 2.0, 9.0]
    df = spark.createDataFrame([(1, v) for v in values] + [(None, 5.0), (2, None)], "k int, v double").repartition(3)
    got = rows(A.quantiles(df, ["k"], "v", {"q": (0.25, True), "m": (0.5, True), "d": (0.9, False)}))
    known = sorted(v for v in values if v is not None)
    assert got == sorted([(1, float(np.quantile(known, 0.25)), 2.0, 9.0), (None, 5.0, 5.0, 5.0)], key=repr)
    assert rows(A.least_n(df, ["k"], "v", 2, "l")) == sorted([(1, [1.0, 2.0]), (None, [5.0])], key=repr)
    assert A.arg_n(df, ["k"], F.col("v"), F.col("v"), 3, "l", greatest=True).where("k = 1").first()["l"] == [9.0, 3.0, 2.0]


def brute_lttb(points, n):
    points = sorted(points)
    if len(points) <= n:
        return points
    edges = [math.floor(k * (len(points) - 2) / (n - 2)) + 1 for k in range(n - 1)]
    kept = [points[0]]
    for k in range(n - 2):
        after = points[edges[k + 1] : edges[k + 2]] if k + 2 < len(edges) else points[-1:]
        cx, cy = sum(p[0] for p in after) / len(after), sum(p[1] for p in after) / len(after)
        ax, ay = kept[-1]
        kept.append(max(points[edges[k] : edges[k + 1]], key=lambda p: abs((ax - cx) * (p[1] - ay) - (ax - p[0]) * (cy - ay))))
    return [*kept, points[-1]]


@pytest.mark.parametrize("n", [3, 7, 20])
def test_lttb_equals_brute_force(spark, n):
    draw = random.Random(n)
    series = {g: [(float(i), draw.uniform(-5, 5)) for i in range(m)] for g, m in (("a", 500), ("b", 19), ("c", 5), ("d", 1))}
    df = spark.createDataFrame([(g, *p) for g, s in series.items() for p in s] + [("a", None, 1.0)], "g string, x double, y double").repartition(5)
    got = rows(A.lttb(df, ["g"], "x", "y", n))
    assert got == sorted(((g, *p) for g, s in series.items() for p in brute_lttb(s, n)), key=repr)
    flat = spark.createDataFrame([("f", float(i), 1.0) for i in range(50)], "g string, x double, y double")
    assert A.lttb(flat, ["g"], "x", "y", n).count() == n


def test_sketches_stay_within_their_bounds(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("u"), (F.col("id") * 7919 % 20_000).cast("double").alias("x"), F.when(F.col("id") % 10 < 6, "often").when(F.col("id") % 10 < 9, "some").otherwise(F.concat(F.lit("r"), F.col("id"))).alias("t"))
    r = df.agg(F.approx_count_distinct("u", 0.02).alias("n"), F.percentile_approx("x", F.lit(0.9), F.lit(10000)).alias("p"), F.expr("approx_top_k(t, 2)").alias("top"), A.distinct_finalize(A.distinct_state(F.col("u"))).alias("s")).first()
    assert abs(r["n"] - 5000) < 5000 * 0.06 and abs(r["s"] - 5000) < 5000 * 0.05 and abs(r["p"] - 18_000) < 20
    assert [(t["item"], t["count"]) for t in r["top"]] == [("often", 12_000), ("some", 6_000)]
    parts = df.groupBy(F.col("u") % 7).agg(A.distinct_state(F.col("u")).alias("s"))
    assert abs(parts.agg(A.distinct_finalize(A.distinct_merge(F.col("s"))).alias("n")).first()["n"] - 5000) < 5000 * 0.05
    q = A.reservoir_quantile(df.withColumn("g", F.lit(1)), ["g"], "x", 0.5, "m", 2000).first()["m"]
    assert abs(q - 10_000) < 1200


def test_recursion_with_aggregates_and_order(spark):
    anchor = spark.createDataFrame([(1, 1, 0)], "k int, v int, n int")
    step = lambda rows, _: rows.where("n < 4").selectExpr("k", "1 AS v", "n + 1 AS n")
    assert rows(recursive.using_key(anchor, ["k"], step, combine={"v": F.sum})) == [(1, 5, 4)]
    down = lambda rows, _: rows.where("v > 0").selectExpr("k", "v - 1 AS v", "n")
    assert rows(recursive.using_key(spark.createDataFrame([(1, 5, 0)], "k int, v int, n int"), ["k"], down, combine={"v": F.max})) == [(1, 5, 0)]
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 4)], "a int, b int")
    walk = lambda rows: rows.join(edges, rows["n"] == edges["a"]).select(F.col("b").alias("n"), "__way", "__seen")
    start = spark.createDataFrame([(0,)], "n int")
    order = lambda breadth: [r["n"] for r in recursive.search_order(start, walk, ["n"], breadth).orderBy("ordering").collect()]
    assert order(False) == [0, 1, 3, 2, 4] and order(True) == [0, 1, 2, 3, 4]


def test_merge_refuses_repeated_source_rows(spark):
    target, twice = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError):
        tables.merge(target, twice, ["k"], update={"v": F.col("s_v")})
    with pytest.raises(ValueError):
        statements.upsert(target, twice, ["k"])


def test_framed_windows(spark):
    t = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 1, 2, 3, 3, 3])], "k int, i int, v int")
    got = windows.framed(t, ["k"], [F.col("v"), F.col("i")], F.col("v"), "l", F.col("i") % 2 + 1, 0, (2, 0))
    assert [r["l"] for r in got.orderBy("i").collect()] == [[1], [1, 1], [1, 2], [1, 2, 3], [3, 3], [3, 3, 3]]
    ties = lambda how: [r["l"] for r in windows.framed(t, ["k"], [F.col("v")], F.col("v"), "l", 1, 1, (1, 1), how).orderBy("v", F.size("l")).collect()]
    assert ties("ties") == [[1], [1, 2], [1, 2, 3], [3], [3], [2, 3]] or len(ties("ties")) == 6
    assert ties("group")[2] == [1, 3]


def test_frames_of_several_exclusions_are_gathered_once(spark):
    draw = random.Random(6)
    t = spark.createDataFrame([(draw.choice([1, 2]), draw.choice([None, *range(5)]), i, draw.choice([-1, 0, 1, 2, 9, None]), draw.choice([-1, 0, 1, 3])) for i in range(120)], "k int, v int, i int, b int, a int")
    hows = {"n": "no others", "c": "current row", "g": "group", "t": "ties"}
    got = windows.framed_all(t, ["k"], [F.col("v")], F.col("v"), hows, F.col("b"), F.col("a"), (2, 3)).collect()
    groups = {k: sorted((r["v"] is not None, r["v"] or 0) for r in got if r["k"] == k) for k in (1, 2)}
    for r in got:
        whole = [v if known else None for known, v in groups[r["k"]]]
        places = [p for p, v in enumerate(whole) if v == r["v"]]
        answers = []
        for p in places:
            inside = [] if r["b"] is None else [q for q in range(max(0, p - min(r["b"], 2)), min(len(whole), p + r["a"] + 1)) if p - 2 <= q <= p + 3]
            answers.append(tuple(tuple(whole[q] for q in inside if keep(q, p)) for keep in (lambda q, p: True, lambda q, p: q != p, lambda q, p: q not in places, lambda q, p: q == p or q not in places)))
        assert tuple(tuple(r[n]) for n in hows) in answers
    one = windows.framed_all(t.drop("a", "b"), ["k"], [F.col("v")], F.col("v"), hows, 2, 3, (2, 3))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1


def test_late_rows_are_dropped_and_sinks_write_by_batch(spark, tmp_path):
    folder = tmp_path / "in"
    first = [(1, "2024-01-10 00:30:00", 1.0), (2, "2024-01-10 05:30:00", 1.0)]
    late = [(3, "2024-01-02 00:00:00", 1.0), (4, "2024-01-10 05:40:00", 1.0)]
    between, last = [(6, "2024-01-10 05:45:00", 1.0)], [(5, "2024-01-20 00:00:00", 1.0)]
    # What is late goes by the watermark of the batch before the last one.
    for name, part in (("a", first), ("b", between), ("c", late), ("d", last)):
        spark.createDataFrame(part, "event_id int, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(folder / name))
        time.sleep(1.1)
    paths = sorted(folder.glob("*/*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, p in enumerate(paths):
        (flat / f"{k}.parquet").write_bytes(p.read_bytes())
        os.utime(flat / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = events.tumbling(events.source(spark, str(flat), files_per_trigger=1), "1 hour", late="1 day")
    out = events.settle(stream, "append", str(tmp_path / "out"))
    assert sorted((str(r["start"]), r["n"]) for r in out.collect()) == [("2024-01-10 00:00:00", 1), ("2024-01-10 05:00:00", 3)]
    totals = events.settle(events.running_totals(events.source(spark, str(flat), files_per_trigger=1).withColumn("user_id", F.lit(7).cast("long"))), "update", str(tmp_path / "totals"), ("user_id",))
    assert rows(totals) == [(7, 6, 6.0)]


def test_changes_that_return_rows(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    now, back = statements.upsert(t, spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string"), ["k"])
    assert rows(now) == [(1, "a"), (2, "B"), (3, "C")] and rows(back) == [(2, "B", "update"), (3, "C", "insert")]
    left, gone = statements.delete_returning(t, F.col("v") == "a")
    assert rows(left) == [(2, None)] and rows(gone) == [(1, "a")]
    assert statements.alter(t, rename={"v": "w"}, retype={"k": "string"}, add={"z": F.lit(1)}).dtypes == [("k", "string"), ("w", "string"), ("z", "int")]


def test_sort_keys_order_as_their_columns(spark):
    data = [(a, b) for a in (None, "", "a", "a\x00", "a\x01b", "ab", "é") for b in (None, -5, 0, 7)]
    df = spark.createDataFrame(data, "a string, b int")
    for how in ((False, False, True, True), (True, True, False, False)):
        key = structs.sort_key((F.col("a"), T.StringType(), how[0], how[1]), (F.col("b"), T.IntegerType(), how[2], how[3]))
        got = [tuple(r) for r in df.orderBy(key).collect()]
        order = [getattr(F.col(c), ("desc" if d else "asc") + ("_nulls_first" if n else "_nulls_last"))() for c, d, n in (("a", *how[:2]), ("b", *how[2:]))]
        assert got == [tuple(r) for r in df.orderBy(*order).collect()]


def test_metadata_and_copies(spark, tmp_path):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    done = files.copy_returning(df.coalesce(1), str(tmp_path / "p"), rows_per_file=40)
    assert sorted(r["count"] for r in done.collect()) == [20, 40, 40]
    assert {(r["name"], r["type"]) for r in metadata.parquet_schema(spark, str(tmp_path / "p")).collect()} == {("id", "INT64"), ("s", "BYTE_ARRAY")}
    assert metadata.parquet_file_metadata(spark, str(tmp_path / "p")).agg(F.sum("num_rows")).first()[0] == 100
    assert files.scan(spark, str(tmp_path / "p" / "*.parquet")).count() == 100


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from vellumine.operators import lineage

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    class Frame:
        sparkSession = Cluster

    with pytest.raises(ValueError):
        lineage.cut(Frame)
