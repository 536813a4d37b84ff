"""Shared-folder helpers: lineage cuts that survive lost executors, and joins that stand hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster see; where none is named, a temporary one on a single machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellumine-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vellumine/{name}-{uuid.uuid4().hex}"


class Shared:
    """A broadcast of bounded size with an id by which Python workers keep what they build from it."""

    def __init__(self, spark: SparkSession, value, id_: str | None = None):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = id_ or uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


#: Bounds of Arrow batches for sessions that run these operators over long texts: rows, bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: The letters of size settings.
UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def size_setting(text: str) -> int:
    """A size as Spark's settings write it, such as 64m, 67108864b or 1gb, in bytes."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)i?b?\s*", text.lower())
    if not found:
        raise ValueError(f"not a size: {text}")
    return int(found[1]) * UNITS[found[2]]


def bound_batches(spark: SparkSession) -> SparkSession:
    """Lowers the session's Arrow batch settings to the bounds above, for whoever owns the session; operators never do."""
    for key, bound, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, int), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, size_setting)):
        now = value(spark.conf.get(key))
        if now <= 0 or now > bound:
            spark.conf.set(key, str(bound))
    return spark


#: What a Python worker handles at once of a batch: rows, bytes.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in parts of at most so many rows, halved while they are too large in bytes and have several."""
    waiting = [batch.slice(start, rows) for start in range(0, batch.num_rows, rows)][::-1]
    while waiting:
        part = waiting.pop()
        if part.num_rows > 1 and part.nbytes > size:
            half = part.num_rows // 2
            waiting += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads come from the shared folder, not from recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, row_salt, how: str = "left", heavy_share: int = 500) -> DataFrame:
    """Equi-join ``big`` to ``small`` (one row a key) where single keys may hold much of ``big``.

    ``weight`` is a column of ``small``: the key's row count in ``big``. Keys with more than
    1/``heavy_share`` of ``total`` rows number at most ``heavy_share``, so they go by broadcast with a
    proven bound; all others are joined through a shuffle where no key is that large. ``row_salt`` is a
    column of ``big`` that spreads the rows of heavy keys, which match nothing in the shuffled join.
    ``weight`` does not appear in the result.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    limit = max(1, total // heavy_share)
    values = [c for c in small.columns if c not in keys and c != weight]
    heavy = small.where(F.col(weight) > limit).drop(weight).withColumns({f"__h_{c}": F.col(c) for c in values}).drop(*values).withColumn("__h_hit", F.lit(True))
    # One key column of keys and salt: no side's partitioning by the keys alone can serve this join.
    light = small.where(F.col(weight) <= limit).select(F.struct(*keys, F.lit(0).cast("long").alias("__salt")).alias("__key"), *[F.col(c).alias(f"__l_{c}") for c in values], F.lit(True).alias("__l_hit"))
    salt = F.when(F.col("__h_hit"), F.xxhash64(row_salt).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))
    flagged = big.join(F.broadcast(heavy), keys, "left").withColumn("__key", F.struct(*keys, salt.alias("__salt")))
    joined = flagged.join(light, "__key", "left")
    if how == "inner":
        joined = joined.where(F.col("__h_hit") | F.col("__l_hit"))
    return joined.select(*big.columns, *[F.coalesce(f"__h_{c}", f"__l_{c}").alias(c) for c in values])
