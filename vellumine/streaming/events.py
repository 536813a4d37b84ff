"""Windowed, session and stateful aggregates of an unbounded event table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files under ``path`` (a file's own path: of that file)."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(folder + "/" + name + "*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, *keys: str, late: str = "1 day") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, slide: str, *keys: str, late: str = "1 day") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, *keys: str, late: str = "1 day") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def running_totals(events: DataFrame) -> DataFrame:
    """Per user, the count and sum so far, kept as state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def distinct(events: DataFrame, *keys: str, late: str = "1 day") -> DataFrame:
    """The first event of each key; keys are let go once the watermark has passed them by ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def settle(stream: DataFrame, mode: str, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what there is and returns its result as a table at ``path``.

    A batch is written under its number, so that one that is run again replaces itself. Of mode "complete" the
    last batch counts, of "update" the last row of each of ``keys``.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/__batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    found = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])).parquet(f"{path}/out")
    if mode == "complete":
        last = found.agg(F.max("__batch")).first()[0]
        return found.where(F.col("__batch") == last).drop("__batch")
    if mode == "update":
        return found.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "__batch").alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in stream.columns if c not in keys])
    return found.drop("__batch")
