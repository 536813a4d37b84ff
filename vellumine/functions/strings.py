"""String, pattern, similarity, path and encoding functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strlen(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def concat(*parts: Column) -> Column:
    """The function form: nulls are skipped."""
    return F.concat_ws("", *parts)


def substr(s: Column, start: int, length: int | None = None) -> Column:
    """1-based; places before the first use up length; a negative start counts from the end."""
    if start == 0:
        return F.substring(s, 1, length - 1) if length is not None else s
    return F.substring(s, start, length if length is not None else 2**31 - 1)


def left(s: Column, n: int) -> Column:
    return F.substring(s, 1, n) if n >= 0 else F.substr(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    if n >= 0:
        return F.right(s, F.lit(n))
    return F.substr(s, F.lit(1 - n), F.greatest(F.length(s) + n, F.lit(0)))


def split_part(s: Column, sep: str, n: int) -> Column:
    return F.split_part(s, F.lit(sep), F.lit(n))


def string_split(s: Column, sep: str) -> Column:
    """By a literal separator; an empty one gives the characters."""
    return F.split(s, regex.escape(sep), -1) if sep else F.split(s, "", -1)


def bar(x: Column, low: float, high: float, width: int) -> Column:
    """A bar of whole blocks for a value between two bounds."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return F.rpad(F.repeat(F.lit("█"), F.floor(share * width).cast("int")), width, " ")


def regexp_escape(s: Column) -> Column:
    return F.regexp_replace(s, r"([^A-Za-z0-9_])", r"\\$1")


def regexp_replace_first(s: Column, pattern: str, replacement: str) -> Column:
    """The first match only; the pattern has no groups of its own, the replacement no references."""
    return F.regexp_replace(s, f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{replacement}$2")


def regexp_extract_struct(s: Column, pattern: str, names: list[str]) -> Column:
    """Groups by name, as a struct; empty texts where nothing matches."""
    return F.struct(*[F.regexp_extract(s, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def full_match(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def glob(s: Column, pattern: str) -> Column:
    """``GLOB``: * any run, ? one character, [abc] sets."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inside = pattern[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[:1] == "!" else inside) + "]"
            i = end
        else:
            out += regex.escape(c)
        i += 1
    return s.rlike(f"^{out}$")


def jaccard(a: Column, b: Column) -> Column:
    """Over the sets of characters."""
    x, y = (F.array_distinct(F.split(c, "")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ in texts of one length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("long"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x)


def _damerau(a: str, b: str) -> int:
    """True distance with transpositions of neighbours."""
    most = len(a) + len(b)
    table = {(-1, -1): most}
    last: dict[str, int] = {}
    for i in range(len(a) + 1):
        table[i, -1], table[i, 0] = most, i
    for j in range(len(b) + 1):
        table[-1, j], table[0, j] = most, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            table[i, j] = min(table[i - 1, j - 1] + (not same), table[i, j - 1] + 1, table[i - 1, j] + 1, table[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return table[len(a), len(b)]


def _jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _winkler(a: str, b: str) -> float:
    base = _jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + prefix * 0.1 * (1 - base) if base > 0.7 else base


def _pairwise(function, kind: T.DataType):
    @F.pandas_udf(kind)
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return over


damerau_levenshtein = _pairwise(_damerau, T.LongType())
jaro_similarity = _pairwise(_jaro, T.DoubleType())
jaro_winkler_similarity = _pairwise(_winkler, T.DoubleType())


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def nfc_normalize(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.LongType())
def length_grapheme(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else len(regex.findall(r"\X", v)))


@F.pandas_udf(T.StringType())
def left_grapheme(s: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else "".join(regex.findall(r"\X", v)[: int(k)]) for v, k in zip(s, n, strict=True)])


@F.pandas_udf(T.StringType())
def right_grapheme(s: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else "".join(regex.findall(r"\X", v)[-int(k) :] if k else "") for v, k in zip(s, n, strict=True)])


@F.pandas_udf(T.StringType())
def substring_grapheme(s: pd.Series, start: pd.Series, n: pd.Series) -> pd.Series:
    """From a place counted from 1."""
    return pd.Series([None if v is None else "".join(regex.findall(r"\X", v)[max(int(a) - 1, 0) : max(int(a) - 1 + int(k), 0)]) for v, a, k in zip(s, start, n, strict=True)])


#: Fixed value: a placeholder of ``format``: place, fill and side, sign, width, thousands, decimals, kind.
_BRACES = regex.compile(r"\{\{|\}\}|\{(\d*)(?::(?:(.)?([<>^]))?([+ ]?)(0?)(\d*)(,?)(?:\.(\d+))?([dfxXeosb]?))?\}")


def format_braces(template: str, *values: Column) -> Column:
    """``format('{} {1:>8.2f} ...')``: by place or in order, with fill, side, sign, width, thousands, decimals and kind."""
    pieces, at, given = [], 0, iter(range(len(values)))
    for m in _BRACES.finditer(template):
        pieces.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m.group(0) in ("{{", "}}"):
            pieces.append(F.lit(m.group(0)[0]))
            continue
        place, fill, side, sign, zero, width, thousands, decimals, kind = m.groups()
        value = values[int(place) if place else next(given)]
        if decimals and kind in ("f", "e", ""):
            text = F.format_string(f"%{thousands or ''}.{decimals}{kind or 'f'}", value.cast("double"))
        elif kind in ("x", "X", "o", "d") or thousands:
            text = F.format_string(f"%{thousands or ''}{kind or 'd'}", value.cast("long"))
        elif kind == "b":
            text = F.bin(value.cast("long"))
        else:
            text = value.cast("string")
        if sign:
            text = F.when(value < 0, text).otherwise(F.concat(F.lit(sign), text))
        if width:
            room = F.greatest(F.lit(int(width)) - F.length(text), F.lit(0))
            mark = F.lit("0" if zero and not side else fill or " ")
            default = "<" if kind in ("s",) else None
            how = side or default or (">" if zero or kind or decimals or thousands else "<")
            before = {">": room, "<": F.lit(0), "^": F.floor(room / 2).cast("int")}[how]
            text = F.concat(F.repeat(mark, before), text, F.repeat(mark, (room - before).cast("int")))
        pieces.append(text)
    return F.concat(*pieces, F.lit(template[at:]))


def readable_size(n: Column, unit: int = 1024, names: tuple[str, ...] = ("bytes", "KiB", "MiB", "GiB", "TiB", "PiB")) -> Column:
    """``formatReadableSize``: two decimals of the greatest unit that is not above the size."""
    out = F.concat(n.cast("string"), F.lit(f" {names[0]}"))
    for power, name in enumerate(names[1:], 1):
        out = F.when(F.abs(n) >= unit**power, F.format_string(f"%.2f {name}", n / float(unit**power))).otherwise(out)
    return out


def size_pretty(n: Column) -> Column:
    """``pg_size_pretty``: whole units, the next one from 10240 on, rounded half away from zero."""
    out, scale = F.concat(n.cast("string"), F.lit(" bytes")), 1
    for name in ("kB", "MB", "GB", "TB", "PB"):
        out = F.when(F.abs(n) >= 10 * 1024 * scale, F.concat(F.round(n / float(1024 * scale)).cast("long").cast("string"), F.lit(f" {name}"))).otherwise(out)
        scale *= 1024
    return out


def parse_dirpath(path: Column, sep: str = "/") -> Column:
    """All of a path before its last part."""
    cut_off = F.substring(path, F.lit(1), F.length(path) - F.length(parse_filename(path, sep)) - 1)
    return F.when(F.instr(path, sep) > 0, F.when((F.instr(path, sep) == 1) & (cut_off == ""), F.lit(sep)).otherwise(cut_off)).otherwise(F.lit(""))


def path_join(*parts: Column, sep: str = "/") -> Column:
    """Parts with one separator between them; one that starts with it begins anew."""
    out = parts[0]
    for p in parts[1:]:
        out = F.when(F.startswith(p, F.lit(sep)), p).when((out == "") | F.endswith(out, F.lit(sep)), F.concat(out, p)).otherwise(F.concat(out, F.lit(sep), p))
    return out


def format_bytes(n: Column) -> Column:
    """Powers of 1024, cut to one decimal of the whole number of the unit below."""
    out = F.concat(n.cast("string"), F.when(n == 1, F.lit(" byte")).otherwise(F.lit(" bytes")))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", F.floor(F.floor(n / float(1024 ** (power - 1))) / 1024 * 10) / 10), F.lit(f" {unit}"))).otherwise(out)
    return out


def parse_filename(path: Column, sep: str = "/") -> Column:
    return F.substring_index(path, sep, -1)


def parse_dirname(path: Column, sep: str = "/") -> Column:
    """The first part of a path."""
    return F.when(F.instr(path, sep) > 0, F.when(F.startswith(path, F.lit(sep)), F.lit(sep)).otherwise(F.substring_index(path, sep, 1))).otherwise(F.lit(""))


def parse_path(path: Column, sep: str = "/") -> Column:
    parts = F.filter(F.split(path, regex.escape(sep), -1), lambda p: p != "")
    return F.when(F.startswith(path, F.lit(sep)), F.concat(F.array(F.lit(sep)), parts)).otherwise(parts)


def ord_(s: Column) -> Column:
    """Code point of the first character."""
    return F.conv(F.hex(F.encode(F.substring(s, 1, 1), "UTF-32")), 16, 10).cast("int")


def parse_formatted_bytes(s: Column) -> Column:
    """``1.5 KiB`` or ``2 MB`` to bytes."""
    number = F.regexp_extract(s, r"^\s*([0-9.]+)", 1).cast("double")
    unit = F.upper(F.regexp_extract(s, r"([A-Za-z]+)\s*$", 1))
    scale = F.when(unit.isin("", "B", "BYTE", "BYTES"), F.lit(1.0))
    for power, letter in enumerate("KMGTP", 1):
        scale = scale.when(unit == f"{letter}IB", F.lit(float(1024**power))).when(unit.isin(f"{letter}B", letter), F.lit(float(1000**power)))
    return F.rint(number * scale).cast("long")


def bitstring(s: Column, width: int) -> Column:
    """A text of 0 and 1 padded to a width."""
    return F.lpad(s, width, "0")


def get_bit(bits: Column, i: int) -> Column:
    return F.substring(bits, i + 1, 1).cast("int")


def set_bit(bits: Column, i: int, value: int) -> Column:
    return F.overlay(bits, F.lit(str(value)), i + 1, 1)


def bit_position(part: Column, bits: Column) -> Column:
    return F.instr(bits, part)


def bit_count(bits: Column) -> Column:
    return F.length(F.regexp_replace(bits, "0", "")).cast("long")


def _little_end(hex_: Column, first: int) -> Column:
    """Eight bytes of hex text from a place on, least first, as a number."""
    return F.conv(F.concat(*[F.substring(hex_, i, 2) for i in range(first + 14, first - 1, -2)]), 16, 10).cast("decimal(20,0)")


def md5_number_upper(s: Column) -> Column:
    return _little_end(F.md5(s), 1)


def md5_number_lower(s: Column) -> Column:
    return _little_end(F.md5(s), 17)


def unbin(s: Column) -> Column:
    return F.unhex(F.conv(s, 2, 16))
