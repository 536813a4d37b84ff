"""Date parts, differences, buckets and formats of the dialect, on timestamps without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    zone_free = t.cast("timestamp_ntz")
    days = F.datediff(zone_free.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    inside = F.hour(zone_free).cast("long") * 3600 + F.minute(zone_free) * 60
    return days * 86_400_000_000 + inside * 1_000_000 + (F.extract(F.lit("SECOND"), zone_free) * 1_000_000).cast("long")


def from_micros(us: Column) -> Column:
    """The session's zone is UTC, so the wall clock is that of the instant."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def dow(t: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(t) - 1).cast("long")


def isodow(t: Column) -> Column:
    return (F.weekday(t) + 1).cast("long")


def isoyear(t: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), t).cast("long")


def yearweek(t: Column) -> Column:
    return isoyear(t) * 100 + F.weekofyear(t)


def decade(t: Column) -> Column:
    return F.floor(F.year(t) / 10).cast("long")


def century(t: Column) -> Column:
    return F.when(F.year(t) > 0, F.floor((F.year(t) - 1) / 100) + 1).otherwise(-F.floor(-F.year(t) / 100) - 1).cast("long")


def millennium(t: Column) -> Column:
    return F.when(F.year(t) > 0, F.floor((F.year(t) - 1) / 1000) + 1).otherwise(-F.floor(-F.year(t) / 1000) - 1).cast("long")


def era(t: Column) -> Column:
    return F.when(F.year(t) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")


def epoch(t: Column) -> Column:
    return micros(t) / 1_000_000.0


def julian(t: Column) -> Column:
    return micros(t) / 86_400_000_000.0 + 2440588


def dayname(t: Column) -> Column:
    return F.date_format(t, "EEEE")


def monthname(t: Column) -> Column:
    return F.date_format(t, "MMMM")


def days_in_month(t: Column) -> Column:
    return F.dayofmonth(F.last_day(t)).cast("long")


_SPANS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86_400 * 10**6}


def _months(t: Column) -> Column:
    return (F.year(t) * 12 + F.month(t) - 1).cast("long")


def date_diff(part: str, a: Column, b: Column) -> Column:
    """Boundaries of ``part`` crossed from ``a`` to ``b``; weeks are whole sevens of the days crossed."""
    if part in _SPANS:
        unit = float(_SPANS[part])
        cut = lambda t: F.floor(micros(t) / unit)
        return (cut(b) - cut(a)).cast("long")
    if part == "week":
        return F.call_function("div", date_diff("day", a, b), F.lit(7).cast("long"))
    size = {"month": 1, "quarter": 3, "year": 12, "decade": 120}[part]
    return (F.floor(_months(b) / size) - F.floor(_months(a) / size)).cast("long")


def date_sub(part: str, a: Column, b: Column) -> Column:
    """Complete units from ``a`` to ``b``; a month is complete on the last day of a shorter month too."""
    if part in _SPANS:
        return F.call_function("div", micros(b) - micros(a), F.lit(_SPANS[part]).cast("long"))
    if part == "week":
        return F.call_function("div", micros(b) - micros(a), F.lit(7 * _SPANS["day"]).cast("long"))
    size = {"month": 1, "quarter": 3, "year": 12, "decade": 120}[part]

    def complete(early: Column, late: Column) -> Column:
        months = _months(late) - _months(early)
        clock = lambda t: micros(t) - F.floor(micros(t) / float(_SPANS["day"])) * _SPANS["day"]
        ended = (F.dayofmonth(late) == F.dayofmonth(F.last_day(late))) & (F.dayofmonth(early) > F.dayofmonth(late))
        short = ~ended & (F.dayofmonth(late) < F.dayofmonth(early)) | ((F.dayofmonth(late) == F.dayofmonth(early)) | ended) & (clock(late) < clock(early))
        return F.floor((months - short.cast("long")) / size)

    forward = micros(b) >= micros(a)
    return F.when(forward, complete(a, b)).otherwise(-complete(b, a)).cast("long")


def time_bucket(width_us: int, t: Column, origin_us: int = 946_857_600_000_000) -> Column:
    """Start of the bucket; buckets of fixed width count from Monday, 3 January 2000."""
    us = micros(t)
    return from_micros(us - F.pmod(us - origin_us, F.lit(width_us)))


def time_bucket_months(months: int, t: Column) -> Column:
    """Start of the bucket of so many months, from January 2000."""
    index = _months(t) - 2000 * 12
    start = index - F.pmod(index, F.lit(months))
    return F.make_date(F.lit(2000) + F.floor(start / 12).cast("int"), F.pmod(start, F.lit(12)).cast("int") + 1, F.lit(1))


#: Format codes and the patterns for them.
CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%j": "DDD", "%%": "%"}


def java_pattern(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            if fmt[i : i + 2] not in CODES:
                raise ValueError(f"format code {fmt[i : i + 2]} is not supported")
            out += CODES[fmt[i : i + 2]]
            i += 2
            continue
        out += f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]
        i += 1
    return out


def strftime(t: Column, fmt: str) -> Column:
    return F.date_format(t, java_pattern(fmt))


def try_strptime(s: Column, *formats: str) -> Column:
    """The first format that fits; null if none."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(java_pattern(f))).cast("timestamp_ntz") for f in formats])


def make_interval_text(months: Column, days: Column, us: Column) -> Column:
    """An interval as a storable struct of its three parts."""
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), us.cast("long").alias("micros"))


def age(a: Column, b: Column) -> Column:
    """From ``b`` to ``a`` in whole months, then days, then microseconds; for ``a`` not before ``b``."""
    months = date_sub("month", b, a)
    moved = b.cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), months.cast("int"))
    left = micros(a) - micros(moved)
    days = F.floor(left / float(_SPANS["day"])).cast("long")
    return make_interval_text(months, days, left - days * _SPANS["day"])


def at_time_zone(t: Column, zone: str) -> Column:
    """A wall clock in ``zone`` to the instant, as wall clock in UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), t.cast("timestamp_ntz"))


def to_zone(t: Column, zone: str) -> Column:
    """A wall clock in UTC to that of ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), t.cast("timestamp_ntz"))


def make_timestamp_ms(ms: Column) -> Column:
    return from_micros(ms * 1000)


#: Months or microseconds of the units that intervals are built from.
UNIT_MONTHS = {"months": 1, "quarters": 3, "years": 12, "decades": 120, "centuries": 1200, "millennia": 12000}
UNIT_DAYS = {"days": 1, "weeks": 7}
UNIT_MICROS = {"microseconds": 1, "milliseconds": 1000, "seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000}


def to_interval(unit: str, n: Column) -> Column:
    """``to_years(n)`` and its kin as a struct of months, days and microseconds."""
    part = lambda units: (n * units[unit] if unit in units else F.lit(0)).cast("long")
    if unit not in UNIT_MONTHS | UNIT_DAYS | UNIT_MICROS:
        raise ValueError(f"no unit {unit}")
    return F.when(n.isNotNull(), F.struct(part(UNIT_MONTHS).alias("months"), part(UNIT_DAYS).alias("days"), part(UNIT_MICROS).alias("micros")))


def normalized_interval(i: Column) -> Column:
    """Microseconds beyond a day become days, days beyond thirty months."""
    day = 86_400_000_000
    cut_off = lambda x, size: (F.when(x < 0, -F.floor(-x / size)).otherwise(F.floor(x / size))).cast("long")
    more_days = cut_off(i["micros"], day)
    days = i["days"] + more_days
    more_months = cut_off(days, 30)
    return F.when(i.isNotNull(), F.struct((i["months"] + more_months).alias("months"), (days - more_months * 30).alias("days"), (i["micros"] - more_days * day).alias("micros")))


def add_interval(t: Column, i: Column) -> Column:
    """A timestamp without zone and an interval struct; the day is cut to the month's last."""
    months = F.add_months(t.cast("date"), i["months"].cast("int"))
    whole = F.date_add(months, i["days"].cast("int"))
    return from_micros(micros(whole.cast("timestamp_ntz")) + micros(t) - micros(t.cast("date").cast("timestamp_ntz")) + i["micros"])


def ago(now: Column, i: Column) -> Column:
    """``ago(interval)`` seen from ``now``."""
    return add_interval(now, F.struct((-i["months"]).alias("months"), (-i["days"]).alias("days"), (-i["micros"]).alias("micros")))


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    return F.make_time(hour, minute, second.cast("decimal(16,6)"))


def make_timestamptz(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: str) -> Column:
    """The instant at which the clocks of a zone show this."""
    return F.make_timestamp_ltz(year, month, day, hour, minute, second.cast("decimal(16,6)"), F.lit(zone))
