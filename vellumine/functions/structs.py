"""Structs by name, variants, sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def names(df: DataFrame, column: str) -> list[str]:
    """Member names, known from the schema."""
    return [f.name for f in df.schema[column].dataType.fields]


def update(s: Column, members: list[str], **changes: Column) -> Column:
    """``struct_update``: members given anew keep their places, new ones come last."""
    kept = [changes.get(m, s[m]).alias(m) for m in members]
    return F.when(s.isNotNull(), F.struct(*kept, *[v.alias(k) for k, v in changes.items() if k not in members]))


def concat(*parts: tuple[Column, list[str]]) -> Column:
    """``struct_concat`` of structs with their member names, which must differ."""
    every = [(s, m) for s, members in parts for m in members]
    if len({m.lower() for _, m in every}) < len(every):
        raise ValueError("a member stands in several structs")
    return F.struct(*[s[m].alias(m) for s, m in every])


def keys(s: Column, members: list[str]) -> Column:
    return F.when(s.isNotNull(), F.array(*[F.lit(m) for m in members]))


def values(s: Column, members: list[str]) -> Column:
    """``struct_values``: the members without names, as ``_0`` and so on."""
    return F.when(s.isNotNull(), F.struct(*[s[m].alias(f"_{i}") for i, m in enumerate(members)]))


def contains(s: Column, members: list[str], value: Column) -> Column:
    """``struct_contains``: whether a member equals the value; null for a null struct."""
    return F.when(s.isNotNull() & value.isNotNull(), F.array_contains(F.array(*[s[m] for m in members]), value) == F.lit(True))


def position(s: Column, members: list[str], value: Column) -> Column:
    """``struct_position``: the first member that equals the value, from 1; null if none."""
    return F.nullif(F.array_position(F.array(*[s[m] for m in members]), value), F.lit(0).cast("long")).cast("int")


def remap(s: Column, mapping: dict[str, str | Column]) -> Column:
    """``remap_struct``: target member -> the source's name, or a value for what the source lacks."""
    return F.when(s.isNotNull(), F.struct(*[(s[v] if isinstance(v, str) else v).alias(k) for k, v in mapping.items()]))


def variant_typeof(v: Column) -> Column:
    """Kind of a variant's value by the dialect's names."""
    kind = F.schema_of_variant(v)
    named = F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind == "STRING", "VARCHAR").when(kind == "VOID", "VARIANT_NULL")
    return F.when(v.isNotNull(), named.otherwise(kind))


def variant_keys(v: Column) -> Column:
    return F.json_object_keys(F.to_json(v))


def variant_length(v: Column) -> Column:
    return F.json_array_length(F.to_json(v)).cast("long")


def variant_normalize(v: Column) -> Column:
    """Text that is equal for equal values: members in order of their names."""
    return F.to_json(v)


def sort_key(*columns: tuple[Column, T.DataType, bool, bool]) -> Column:
    """Bytes that order as (column, type, descending, nulls first) do, for whole numbers, texts, dates and times."""
    return F.concat(*[_one_key(*c) for c in columns])


def _one_key(c: Column, kind: T.DataType, descending: bool, nulls_first: bool) -> Column:
    if isinstance(kind, T.StringType):
        # Text may hold bytes below the end mark; these are led by a 1.
        body = F.concat(F.replace(F.replace(c, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01")).cast("binary"), F.unhex(F.lit("00")))
    else:
        if not isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise TypeError(f"no sort key for {kind.simpleString()}")
        number = c if isinstance(kind, T.IntegralType) else F.unix_micros(c.cast("timestamp"))
        body = F.unhex(F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    if descending:
        digits = F.hex(body)
        body = F.unhex(F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210"))
    null, known = ("00", "01") if nulls_first else ("01", "00")
    return F.when(c.isNull(), F.unhex(F.lit(null))).otherwise(F.concat(F.unhex(F.lit(known)), body))
