"""Changes to tables as rewrites: insert with conflicts, update, delete, constraints as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(target: DataFrame, new: DataFrame, keys: list[str] | None = None, on_conflict: str = "error") -> DataFrame:
    """INSERT [BY NAME]; with ``keys``, a row that meets an old one is an error, ignored or replaces it."""
    named = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    if not keys:
        return target.unionByName(named)
    if on_conflict == "ignore":
        return target.unionByName(named.join(target.select(*keys), keys, "left_anti").select(*target.columns))
    if on_conflict == "replace":
        return target.join(named.select(*keys), keys, "left_anti").select(*target.columns).unionByName(named)
    if not named.join(target.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError("duplicate key")
    return target.unionByName(named)


def update(target: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False)))


def violations(df: DataFrame, *, unique: list[str] | None = None, not_null: list[str] | None = None, check: Column | None = None, references: tuple[DataFrame, list[str], list[str]] | None = None) -> DataFrame:
    """(constraint, count) of what a table breaks; nothing if it holds."""
    parts = []
    for c in not_null or []:
        parts.append(df.where(F.col(c).isNull()).agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(f"not null {c}")))
    if unique:
        repeated = df.dropna(subset=unique).groupBy(*unique).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        parts.append(repeated.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).withColumn("rule", F.lit("unique " + ", ".join(unique))))
    if check is not None:
        parts.append(df.where(~check).agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("check")))
    if references:
        parent, mine, theirs = references
        lost = df.dropna(subset=mine).join(parent.select(*[F.col(t).alias(m) for m, t in zip(mine, theirs, strict=True)]), mine, "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("references")))
    out = parts[0].select("rule", "n")
    for p in parts[1:]:
        out = out.unionByName(p.select("rule", "n"))
    return out.where("n > 0")


def upsert(target: DataFrame, new: DataFrame, keys: list[str], changes: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT ... ON CONFLICT DO UPDATE ... RETURNING: the table, and the rows put in or changed with ``__action``.

    New rows must be unique by key. ``changes`` may name old columns plainly and new ones as ``excluded_<column>``; without
    it all columns the new row has are taken over.
    """
    if not new.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("several new rows have the same key")
    named = new.select(*[F.col(c).alias(f"excluded_{c}") for c in new.columns], F.lit(True).alias("__new"))
    old = target.withColumn("__old", F.lit(True))
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"excluded_{k}"))
    changes = changes if changes is not None else {c: F.col(f"excluded_{c}") for c in new.columns if c not in keys}
    fresh = lambda c: F.col(f"excluded_{c}") if c in new.columns else F.lit(None).cast(target.schema[c].dataType)
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new"), "update")
    merged = old.join(named, match, "full").select(*[F.when(F.col("__old").isNull(), fresh(c)).when(F.col("__new"), changes.get(c, F.col(c))).otherwise(F.col(c)).alias(c) for c in target.columns], action.alias("__action"))
    return merged.select(*target.columns), merged.where("__action IS NOT NULL")


def delete_returning(target: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """The table without the rows, and the rows."""
    hit = F.coalesce(where, F.lit(False))
    return target.where(~hit), target.where(hit)


def alter(df: DataFrame, *, add: dict[str, Column] | None = None, drop: tuple[str, ...] = (), rename: dict[str, str] | None = None, retype: dict[str, str] | None = None) -> DataFrame:
    """ALTER TABLE as a rewrite: columns added with their default, dropped, renamed or cast."""
    rename, retype = rename or {}, retype or {}
    kept = [(F.col(f"`{c}`").cast(retype[c]) if c in retype else F.col(f"`{c}`")).alias(rename.get(c, c)) for c in df.columns if c not in drop]
    return df.select(*kept, *[v.alias(k) for k, v in (add or {}).items()])
