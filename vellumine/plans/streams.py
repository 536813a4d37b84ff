"""Streaming queries, run over the finite tables and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.data import table
from vellumine.plans.io import _scratch
from vellumine.plans.suite import Suite
from vellumine.streaming import events as E

suite = Suite()


def _events(spark, folder):
    table(spark, folder, "events")
    return E.source(spark, f"{folder}/events.parquet")


@suite.add("stream_tumbling", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling(spark, folder):
    out = E.settle(E.tumbling(_events(spark, folder), "6 hours", "event_type"), "complete", _scratch(spark, "stream"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@suite.add("stream_sliding", "SELECT b - INTERVAL 12 HOURS * k AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 12 HOURS, ts) AS b FROM events) e, (VALUES (0), (1)) t(k) GROUP BY ALL")
def sliding(spark, folder):
    out = E.settle(E.sliding(_events(spark, folder), "24 hours", "12 hours"), "complete", _scratch(spark, "stream"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@suite.add("stream_sessions", "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, folder):
    out = E.settle(E.sessions(_events(spark, folder), "8 hours", "user_id"), "complete", _scratch(spark, "stream"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _in_files(spark, folder, n: int):
    """The events as several files, so that the stream comes in several batches, in the order of time."""
    path = _scratch(spark, "events")
    table(spark, folder, "events").repartitionByRange(n, "ts").sortWithinPartitions("ts").write.parquet(path)
    return E.source(spark, path, files_per_trigger=1)


@suite.add("stream_stateful", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stateful(spark, folder):
    out = E.settle(E.running_totals(_in_files(spark, folder, 3)), "update", _scratch(spark, "stream"), ("user_id",))
    return out.select("user_id", "n", F.round("total", 2).alias("total"))


@suite.add("stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def distinct(spark, folder):
    # All of the table lies within the watermark here, so no key comes twice.
    stream = E.distinct(_events(spark, folder).select("ts", "user_id", "event_type"), "user_id", "event_type", late="3650 days")
    return E.settle(stream, "append", _scratch(spark, "stream")).select("user_id", "event_type")
