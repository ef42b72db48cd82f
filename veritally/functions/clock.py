"""Wall-clock arithmetic on timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_weekday(ts: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(ts) + 1


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed from start to end; fractions do not round the difference."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def utc_seconds(ts: Column, zone: str) -> Column:
    """The instant of a local wall-clock time, in unix seconds.

    An hour that happens twice is read as its second occurrence. Spark reads it as the
    first, so the instant one hour on is taken when it shows the same wall clock.
    """
    first = F.to_utc_timestamp(ts, zone)
    second = first + F.expr("INTERVAL 1 HOUR")
    twice = F.from_utc_timestamp(second, zone) == ts.cast("timestamp")
    return F.unix_timestamp(first) + F.when(twice, 3600).otherwise(0)


def local_seconds_between(start: Column, end: Column, zone: str) -> Column:
    """Elapsed seconds between two wall-clock times, across any clock change between them."""
    return utc_seconds(end, zone) - utc_seconds(start, zone)


def clocks_go_back(ts: Column) -> Column:
    """Before 3 am on the first Sunday of November."""
    return (F.month(ts) == 11) & (iso_weekday(ts) == 7) & (F.day(ts) <= 7) & (F.hour(ts) < 3)


def month_index(ts: Column) -> Column:
    """Months since year 0, for comparing months without formatting them."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_text_index(text: Column) -> Column:
    """The same for 'YYYY-MM' text."""
    return F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int") - 1


def month_end(text: Column) -> Column:
    """Last date of a 'YYYY-MM' month."""
    return F.last_day(F.to_date(F.concat(text, F.lit("-01"))))


def days_in_month(text: Column) -> Column:
    return F.day(month_end(text))
