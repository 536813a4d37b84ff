"""JSON text: access by path natively; rewriting of whole values in Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def extract_string(s: Column, path: str) -> Column:
    """``->>``."""
    return F.get_json_object(s, path)


def exists(s: Column, path: str) -> Column:
    return F.variant_get(F.try_parse_json(s), path, "variant").isNotNull() | F.get_json_object(s, path).isNotNull()


def valid(s: Column) -> Column:
    return F.when(s.isNotNull(), F.try_parse_json(s).isNotNull())


def keys(s: Column) -> Column:
    return F.json_object_keys(s)


def array_length(s: Column) -> Column:
    return F.json_array_length(s).cast("long")


#: The dialect's names of JSON kinds.
KINDS = {dict: "OBJECT", list: "ARRAY", str: "VARCHAR", bool: "BOOLEAN", float: "DOUBLE", type(None): "NULL"}


def _kind(v) -> str:
    if type(v) is int:
        return "UBIGINT" if v >= 0 else "BIGINT"
    return KINDS[type(v)]


@F.pandas_udf(T.StringType())
def json_type(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _kind(json.loads(t)))


def _patch(target, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patch(out.get(k), v)
    return out


@F.pandas_udf(T.StringType())
def merge_patch(a: pd.Series, b: pd.Series) -> pd.Series:
    """RFC 7396."""
    return pd.Series([None if x is None or y is None else json.dumps(_patch(json.loads(x), json.loads(y)), separators=(",", ":"), ensure_ascii=False) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def pretty(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=4, ensure_ascii=False))


@F.pandas_udf(T.StringType())
def strip_nulls(s: pd.Series) -> pd.Series:
    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if x is not None}
        return [clean(x) for x in v] if isinstance(v, list) else v

    return s.map(lambda t: None if t is None else json.dumps(clean(json.loads(t)), separators=(",", ":"), ensure_ascii=False))


def value(s: Column, path: str) -> Column:
    """``json_value``: text of a scalar; null for objects, arrays and what is not there."""
    found = F.variant_get(F.try_parse_json(s), path, "variant")
    return F.when(~F.schema_of_variant(found).rlike("^(OBJECT|ARRAY|VOID)"), F.get_json_object(s, path))


def _contains(whole, part) -> bool:
    if isinstance(part, dict) and isinstance(whole, dict) and all(k in whole and _contains(whole[k], v) for k, v in part.items()):
        return True
    if isinstance(part, list) and isinstance(whole, list) and all(any(_contains(w, p) for w in whole) for p in part):
        return True
    if type(whole) is type(part) and not isinstance(part, (dict, list)) and whole == part:
        return True
    inner = whole.values() if isinstance(whole, dict) else whole if isinstance(whole, list) else ()
    return any(_contains(v, part) for v in inner)


@F.pandas_udf(T.BooleanType())
def contains(s: pd.Series, part: pd.Series) -> pd.Series:
    """``json_contains``: whether the part stands anywhere in the value."""
    return pd.Series([None if a is None or b is None else _contains(json.loads(a), json.loads(b)) for a, b in zip(s, part, strict=True)])


def _merged(a, b):
    if a is None or a == "NULL":
        return b
    if b is None or b == "NULL" or a == b:
        return a
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _merged(a.get(k), b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    if isinstance(a, list) and isinstance(b, list):
        return [_merged(a[0] if a else None, b[0] if b else None)]
    return "DOUBLE" if {str(a), str(b)} <= {"UBIGINT", "BIGINT", "DOUBLE"} and "DOUBLE" in (a, b) else "BIGINT" if {str(a), str(b)} <= {"UBIGINT", "BIGINT"} else "JSON"


def _shape(v):
    if isinstance(v, dict):
        return {k: _shape(x) for k, x in v.items()}
    if isinstance(v, list):
        out = None
        for x in v:
            out = _merged(out, _shape(x))
        return [out or "NULL"]
    return _kind(v)


@F.pandas_udf(T.StringType())
def structure(s: pd.Series) -> pd.Series:
    """``json_structure``: the value's shape with kinds in place of scalars."""
    return s.map(lambda t: None if t is None else json.dumps(_shape(json.loads(t)), separators=(",", ":"), ensure_ascii=False))


def transform(s: Column, schema: str) -> Column:
    """``json_transform``: the value as a struct of the given types; what does not fit is null."""
    return F.from_json(s, schema, {"mode": "PERMISSIVE"})
