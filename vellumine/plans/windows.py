"""Window functions and the frames that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumine.data import table
from vellumine.operators import scans, windows
from vellumine.plans.suite import Suite

suite = Suite()


@suite.add("win_ranking", "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER p AS INT) AS r, CAST(dense_rank() OVER p AS INT) AS d, round(percent_rank() OVER p, 8) AS pr, round(cume_dist() OVER p, 8) AS cd, CAST(ntile(7) OVER w AS INT) AS nt FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)")
def ranking(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    ranked = windows.peer_ranks(df, ["o_orderstatus"], "o_orderpriority")
    placed = scans.numbered(ranked, ["o_orderstatus"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()], "place", "total")
    whole = {"rn": F.col("place"), "r": F.col("rank"), "d": F.col("dense_rank")}
    return placed.select("o_orderkey", *[c.cast("int").alias(n) for n, c in whole.items()], F.round("percent_rank", 8).alias("pr"), F.round("cume_dist", 8).alias("cd"), windows.ntile(F.col("place"), F.col("total"), 7).cast("int").alias("nt"))


suite.both("win_lag_lead", "SELECT event_id, lag(value, 1) OVER w AS back, lead(value, 2, -1.0) OVER w AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
suite.both("win_first_last_nth", "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
suite.both("win_running_sum", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
suite.both("win_rows_frame", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders")
suite.both("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS n FROM part")
suite.both("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '36' HOUR PRECEDING AND CURRENT ROW) AS n FROM events".replace("INTERVAL '36' HOUR", "INTERVAL '36' HOUR"))
suite.texts("win_ignore_nulls", "SELECT i, last_value(v) IGNORE NULLS OVER (ORDER BY i) AS l FROM (VALUES (1, NULL), (2, 5), (3, NULL), (4, 7), (5, NULL)) t(i, v)", "SELECT i, last_value(v IGNORE NULLS) OVER (ORDER BY i) AS l FROM (VALUES (1, NULL), (2, 5), (3, NULL), (4, 7), (5, NULL)) t(i, v)")
suite.texts("win_qualify", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
suite.both("win_over_aggregate", "SELECT o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM orders GROUP BY o_orderstatus")


@suite.add("win_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def groups_frame(spark, folder):
    return windows.groups_frame(table(spark, folder, "part"), ["p_brand"], F.col("p_size").asc_nulls_last(), -1, 1, F.count(F.lit(1)), "n").select("p_partkey", "n")


@suite.add("win_exclude_current", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS BIGINT) AS s FROM part")
def exclude_current(spark, folder):
    frame = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(-3, 0)
    return table(spark, folder, "part").select("p_partkey", windows.sum_excluding_current("p_size", frame).alias("s"))


@suite.add("win_exclude_group", "SELECT p_partkey, CAST(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS BIGINT) AS s FROM part".replace("p_retailprice", "p_partkey"))
def exclude_group(spark, folder):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, folder, "part").select("p_partkey", windows.sum_excluding_ties("p_partkey", w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, 0)).alias("s"))


@suite.add("win_exclude_ties", "SELECT p_partkey, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS m FROM part")
def exclude_ties(spark, folder):
    # Peers end this frame, so the rows before them and the row itself are what is left.
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(Window.unboundedPreceding, -1)
    return table(spark, folder, "part").select("p_partkey", F.greatest(F.max("p_retailprice").over(w), "p_retailprice").alias("m"))


_NINE_SEVEN = "PARTITION BY l_suppkey ORDER BY l_quantity ROWS BETWEEN 9 PRECEDING AND 7 FOLLOWING"


@suite.add("win_exclude_any", f"""
    SELECT l_suppkey, l_quantity, coalesce(list(l_quantity) OVER ({_NINE_SEVEN} EXCLUDE CURRENT ROW), []) AS c, coalesce(list(l_quantity) OVER ({_NINE_SEVEN} EXCLUDE GROUP), []) AS g, list(l_quantity) OVER ({_NINE_SEVEN} EXCLUDE TIES) AS t
    FROM lineitem""")
def exclude_any(spark, folder):
    # Peers have one value here, so it does not matter in which order they come.
    df = table(spark, folder, "lineitem").select("l_suppkey", "l_quantity")
    return windows.framed_all(df, ["l_suppkey"], [F.col("l_quantity")], F.col("l_quantity"), {"c": "current row", "g": "group", "t": "ties"}, 9, 7, (9, 7))


@suite.add("win_distinct", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM events")
def distinct_over(spark, folder):
    frame = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, folder, "events").select("event_id", windows.count_distinct_over("event_type", frame).alias("n"))


@suite.add("win_filter", "SELECT event_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS errors FROM events")
def filtered(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("event_id", windows.filtered(F.count, F.col("event_type") == "error", F.lit(1), w).alias("errors"))


@suite.add("win_fill", """
    WITH t AS (SELECT user_id, CAST(event_id AS INT) AS k, CASE WHEN event_id % 4 = 1 THEN value END AS v FROM events),
    n AS (SELECT *, CASE WHEN v IS NOT NULL THEN {'x': CAST(k AS DOUBLE), 'y': v} END AS p FROM t),
    s AS (SELECT k, v, last_value(p IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(p IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b,
          list(p ORDER BY k) FILTER (WHERE p IS NOT NULL) OVER (PARTITION BY user_id) AS l FROM n WINDOW w AS (PARTITION BY user_id ORDER BY k)),
    e AS (SELECT k, v, CASE WHEN a IS NULL THEN l[1] WHEN b IS NULL THEN coalesce(l[-2], a) ELSE a END AS f, CASE WHEN a IS NULL THEN coalesce(l[2], l[1]) WHEN b IS NULL THEN a ELSE b END AS g FROM s)
    SELECT k, round(CASE WHEN v IS NOT NULL THEN v WHEN g.x = f.x THEN f.y ELSE f.y + (k - f.x) * (g.y - f.y) / (g.x - f.x) END, 8) AS v FROM e""")
def fill(spark, folder):
    df = table(spark, folder, "events").selectExpr("user_id", "CAST(event_id AS INT) AS k", "CASE WHEN event_id % 4 = 1 THEN value END AS v")
    return windows.fill(df, ["user_id"], "k", "v", "filled").select("k", F.round("filled", 8).alias("v"))


suite.both("win_sessions", "SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '12' HOUR THEN 0 ELSE 1 END AS fresh FROM events)")
