"""Weighted rendezvous sharding of stable keys, with gapless slots inside each shard.

Each (key, shard) pair has a pseudo-random draw u in (0, 1); the key goes to the shard with the least
-ln(u) / weight. A shard's draws do not depend on the others, so one more shard takes rows only into
itself, in proportion to its weight, and a shard that goes gives its rows to the rest.

Keys are compared by their text; a null key is a key of its own. Rows that repeat a key follow it to
its shard and get slots of their own there. Slots follow (hash of the key, key, size, checksum); rows
alike in all of these are interchangeable and are counted together before any shuffle, so that a key
with very many rows never meets in one task. Null texts have no bytes. Empty tables give empty
results; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are numbered within buckets of the key's hash, 16 to a power a shard: this power, or less where that
#: would make more buckets over all shards.
HEX_DIGITS, MOST_BUCKETS = 3, 1 << 17
#: Interchangeable rows are laid out in runs of this many.
RUN = 8192


def draw(key: Column, shard: Column) -> Column:
    """A double in (0, 1) from the first 52 bits of the MD5 of key and shard."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, shard.cast("string"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def cost(key: Column, shard: Column, weight: Column) -> Column:
    return -F.ln(draw(key, shard)) / weight


def assign(key: Column, weights: list[float]) -> Column:
    """The shard (from 0) of a key; shards of weight zero take nothing."""
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights are needed, none negative, some above zero")
    costs = [F.struct(cost(key, F.lit(i), F.lit(float(w))).alias("c"), F.lit(i).alias("s")) for i, w in enumerate(weights) if w > 0]
    best = costs[0] if len(costs) == 1 else F.least(*costs)
    return best["s"]


def key_text(key: Column) -> Column:
    """Text that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def shard(df: DataFrame, key_col: str, text_col: str, weights: list[float], *, added_weight: float = 1.0) -> DataFrame:
    """Key, size, text checksum, law, shard, slot and the shard if one of ``added_weight`` were added."""
    n = len(weights)
    digits = next(d for d in range(HEX_DIGITS, -1, -1) if not d or n * 16**d <= MOST_BUCKETS)
    key = F.col("__key")
    rows = df.select(
        F.col(key_col).alias("__id"),
        key_text(F.col(key_col)).alias("__key"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("__size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("__crc"),
    )
    alike = rows.groupBy("__id", "__key", "__size", "__crc").agg(F.count(F.lit(1)).alias("__n"))
    placed = alike.withColumn("__shard", assign(key, weights)).withColumn("__md5", F.md5("__key"))
    own = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("__shard") + 1)
    moves = cost(key, F.lit(n), F.lit(added_weight)) < cost(key, F.col("__shard"), own)
    placed = placed.withColumn("__grown", F.when(moves, F.lit(n)).otherwise(F.col("__shard"))).withColumn("__bucket", F.substring("__md5", 1, digits))
    # One row a shard and bucket: at most MOST_BUCKETS, or a row a shard.
    counts = placed.groupBy("__shard", "__bucket").agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__shard", "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__shard", "__bucket").orderBy("__md5", "__key", "__size", "__crc").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(F.broadcast(starts), ["__shard", "__bucket"])
    first = F.col("__start") + F.col("__inside")
    runs = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(RUN).cast("long"))
    laid = numbered.withColumn("__first", first).withColumn("__from", F.explode(runs))
    offsets = F.sequence(F.col("__from"), F.least(F.col("__from") + RUN, F.col("__n")) - 1)
    single = laid.where("__n = 1").withColumn("__slot", F.col("__first"))
    many = laid.where("__n > 1").repartition("__md5", "__size", "__crc", "__from").withColumn("__slot", F.explode(offsets)).withColumn("__slot", F.col("__first") + F.col("__slot"))
    return single.unionByName(many).select(
        F.col("__id").alias(key_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("key").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.col("__grown").alias("grown_shard"),
    )
