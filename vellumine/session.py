"""Session settings that pin the semantics the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change answers; all can be set at run time.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.timeType.enabled": "true",
}
#: Settings that only change how plans run: runtime re-planning, skew joins, Arrow exchange.
EXECUTION = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName("vellumine").config(map=SEMANTICS | EXECUTION | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Sets the semantics on a session that someone else has built."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark
