"""Lists, vectors, maps, structs and tagged unions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(l: Column, i: int) -> Column:
    """1-based; negative from the end; null outside."""
    return F.try_element_at(l, F.lit(i)) if i else F.lit(None)


def slice_(l: Column, begin: int, end: int, step: int = 1) -> Column:
    """``l[begin:end:step]``, both ends included, negatives from the end."""
    n = F.size(l)
    place = lambda k: F.lit(k) if k >= 0 else n + k + 1
    a, b = F.greatest(place(begin), F.lit(1)), F.least(place(end), n)
    part = F.when(l.isNotNull(), F.when(b >= a, F.slice(l, a, b - a + 1)).otherwise(F.slice(l, 1, 0)))
    return part if step == 1 else F.filter(part, lambda _, i: i % step == 0)


def position(l: Column, x: Column) -> Column:
    """1-based place of the first equal item; null if none."""
    return F.nullif(F.array_position(l, x), F.lit(0).cast("long")).cast("int")


def has_all(l: Column, other: Column) -> Column:
    return F.size(F.array_except(other, l)) == 0


def sort(l: Column, descending: bool = False, nulls_first: bool = False) -> Column:
    """Nulls last unless asked otherwise."""
    known = F.sort_array(F.filter(l, lambda x: x.isNotNull()), asc=not descending)
    nulls = F.filter(l, lambda x: x.isNull())
    return F.concat(nulls, known) if nulls_first else F.concat(known, nulls)


def grade_up(l: Column) -> Column:
    """1-based places of the items in sorted order."""
    return F.transform(F.array_sort(F.transform(l, lambda x, i: F.struct(x.isNull().alias("n"), x.alias("x"), (i + 1).alias("i")))), lambda s: s["i"].cast("long"))


def resize(l: Column, n: int, value: Column) -> Column:
    return F.concat(F.slice(l, 1, n), F.array_repeat(value, F.greatest(F.lit(n) - F.size(l), F.lit(0))))


def where(l: Column, flags: Column) -> Column:
    """Items at places whose flag is true."""
    return F.transform(F.filter(F.arrays_zip(l.alias("x"), flags.alias("keep")), lambda s: s["keep"]), lambda s: s["x"])


def select(l: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.try_element_at(l, i.cast("int")))


def total(l: Column, kind: str = "double") -> Column:
    """Sum of the known items; null if there are none."""
    known = F.filter(l, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind)))


def mean(l: Column) -> Column:
    known = F.filter(l, lambda x: x.isNotNull())
    return total(l) / F.nullif(F.size(known), F.lit(0))


def product(l: Column) -> Column:
    known = F.filter(l, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(1.0), lambda s, x: s * x.cast("double")))


def _known(l: Column) -> Column:
    return F.filter(l, lambda x: x.isNotNull())


def var_pop(l: Column) -> Column:
    """Around the mean, in two passes over the list."""
    middle = mean(l)
    return F.aggregate(_known(l), F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") - middle, F.lit(2.0))) / F.nullif(F.size(_known(l)), F.lit(0))


def var_samp(l: Column) -> Column:
    n = F.size(_known(l))
    return F.when(n > 1, var_pop(l) * n / F.nullif(n - 1, F.lit(0)))


def stddev_pop(l: Column) -> Column:
    return F.sqrt(var_pop(l))


def stddev_samp(l: Column) -> Column:
    return F.sqrt(var_samp(l))


def sem(l: Column) -> Column:
    return F.sqrt(var_pop(l) / F.nullif(F.size(_known(l)), F.lit(0)))


def median(l: Column) -> Column:
    known, n = F.sort_array(_known(l)), F.size(_known(l))
    return F.when(n > 0, (F.get(known, F.floor((n - 1) / 2).cast("int")) + F.get(known, F.floor(n / 2).cast("int"))) / 2.0)


def mode(l: Column) -> Column:
    """The commonest item; of equals the first in the list."""
    known = _known(l)
    times = F.transform(F.array_distinct(known), lambda x: F.struct((-F.size(F.filter(known, lambda y: y == x))).alias("n"), F.array_position(known, x).alias("p"), x.alias("x")))
    return F.array_min(times)["x"]


def first(l: Column) -> Column:
    return F.get(l, 0)


def last(l: Column) -> Column:
    return F.try_element_at(l, F.lit(-1))


def any_value(l: Column) -> Column:
    return F.get(_known(l), 0)


def bool_and(l: Column) -> Column:
    return F.when(F.size(_known(l)) > 0, F.forall(_known(l), lambda x: x))


def bool_or(l: Column) -> Column:
    return F.when(F.size(_known(l)) > 0, F.exists(_known(l), lambda x: x))


def bit_fold(l: Column, how: str) -> Column:
    """``bit_and``, ``bit_or`` or ``bit_xor`` of the items."""
    act = {"and": Column.bitwiseAND, "or": Column.bitwiseOR, "xor": Column.bitwiseXOR}[how]
    return reduce(_known(l), act)


def string_agg(l: Column, sep: str = ",") -> Column:
    return F.when(F.size(_known(l)) > 0, F.array_join(_known(l).cast("array<string>"), sep))


def histogram(l: Column) -> Column:
    """Item -> count, in order of the items."""
    known = _known(l)
    return F.map_from_entries(F.transform(F.sort_array(F.array_distinct(known)), lambda x: F.struct(x, F.size(F.filter(known, lambda y: y == x)).cast("long"))))


def entropy(l: Column) -> Column:
    n = F.size(_known(l)).cast("double")
    return F.when(n > 0, F.log2(n) - F.aggregate(F.map_values(histogram(l)), F.lit(0.0), lambda s, c: s + c * F.log2(c.cast("double"))) / n)


def zip_(lists: list[Column], truncate: bool = False) -> Column:
    """``list_zip``: items by place as structs; ``truncate`` cuts to the shortest, else nulls fill up."""
    zipped = F.arrays_zip(*[F.coalesce(l, F.array()).alias(f"_{i}") for i, l in enumerate(lists)])
    named = F.transform(zipped, lambda s: F.struct(*[s[f"_{i}"].alias(f"_{i}") for i in range(len(lists))]))
    return F.slice(named, 1, F.least(*[F.size(F.coalesce(l, F.array())) for l in lists])) if truncate else named


def union_extract(u: Column, tag: str) -> Column:
    """The member's value if it is the one set."""
    return F.when(u["tag"] == tag, u[tag])


def reduce(l: Column, body) -> Column:
    """Fold from the first item."""
    return F.when(F.size(l) > 0, F.aggregate(F.slice(l, 2, F.greatest(F.size(l) - 1, F.lit(0))), F.get(l, 0), body))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def cosine_similarity(a: Column, b: Column) -> Column:
    return inner_product(a, b) / F.sqrt(inner_product(a, a) * inner_product(b, b))


def cross_product(a: Column, b: Column) -> Column:
    x, y = (lambda i: F.get(a, i)), (lambda i: F.get(b, i))
    return F.array(*[x(i) * y(j) - x(j) * y(i) for i, j in ((1, 2), (2, 0), (0, 1))])


def map_extract(m: Column, key: Column) -> Column:
    """A list of the value, empty if the key is missing."""
    return F.when(F.map_contains_key(m, key), F.array(F.try_element_at(m, key))).otherwise(F.array())


def comparable(m: Column) -> Column:
    """A map as sorted entries, which group and compare."""
    return F.array_sort(F.map_entries(m))


def union_value(tags: list[str], tag: str, value: Column, kinds: dict[str, str]) -> Column:
    """A tagged struct with one member set."""
    return F.struct(F.lit(tag).alias("tag"), *[(value if t == tag else F.lit(None)).cast(kinds[t]).alias(t) for t in tags])


def enum_code(labels: list[str], value: Column) -> Column:
    """0-based place in the declaration."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), value), F.lit(0).cast("long")).cast("int") - 1
