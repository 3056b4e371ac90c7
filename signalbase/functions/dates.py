"""Column functions over dates; everything is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMON = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
_CLOCK = r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
CALENDAR = r"^(\d{4})(-?)(\d{2})\2(\d{2})" + _CLOCK
WEEK = r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?" + _CLOCK


def parse_iso(text: Column) -> Column:
    """ISO-8601 text as a timestamp, of calendar or week dates, with or without marks
    between their parts; times without a zone are UTC. Blank and bad texts are null."""
    t = F.trim(text)
    by_week = F.coalesce(t.rlike(WEEK), F.lit(False))
    part = lambda i: F.when(by_week, F.regexp_extract(t, WEEK, i)).otherwise(F.regexp_extract(t, CALENDAR, i))
    given = lambda i, default: F.coalesce(F.nullif(part(i), F.lit("")), F.lit(default))
    fourth = F.to_date(F.concat(part(1), F.lit("-01-04")))
    monday = F.date_sub(fourth, F.weekday(fourth))
    number = lambda i, default: given(i, default).cast("int")
    counted = F.date_add(monday, (number(3, "1") - 1) * 7 + number(4, "1") - 1)
    week = F.when(F.weekofyear(counted) == number(3, "0"), F.date_format(counted, "yyyy-MM-dd"))
    day = F.when(by_week, week).otherwise(F.concat_ws("-", part(1), part(3), part(4)))
    zone = F.regexp_replace(given(9, "Z"), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    zone = F.regexp_replace(zone, r":$", ":00")
    clock = F.concat(F.lit("T"), given(5, "00"), F.lit(":"), given(6, "00"), F.lit(":"), given(7, "00"), F.lit("."), F.rpad(F.left(given(8, "0"), F.lit(6)), 6, "0"), zone)
    # Spark reads the common shape itself; only other texts are taken apart
    return F.when(t.rlike(COMMON), F.try_to_timestamp(t)).otherwise(F.when(by_week | t.rlike(CALENDAR), F.try_to_timestamp(F.concat(day, clock))))


def bad_date(text: Column) -> Column:
    """Whether a text is there but is no date."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & parse_iso(text).isNull()


def parse_compact(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def parse_rfc822(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UT|UTC)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stamp(ts: Column) -> Column:
    """A compact stamp, as file names carry it."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def month_key(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("sin-fecha"))


def days(ts: Column) -> Column:
    """Fractional days since the epoch."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86400e6)


def age_hours(reference: Column, ts: Column) -> Column:
    return F.greatest((F.unix_micros(reference) - F.unix_micros(ts)) / F.lit(3600e6), F.lit(0.0))


def recirculated(published: Column, detected: Column, days_: int = 30) -> Column:
    """An item found more than a month after its own date is not a new event."""
    return F.coalesce(F.datediff(detected, published) > days_, F.lit(False))


def month_sequence(first: Column, last: Column) -> Column:
    """'yyyy-MM' of each month from first to last, both included."""
    return F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
