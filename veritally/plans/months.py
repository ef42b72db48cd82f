"""Which months to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _date(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def window(published: DataFrame, keep: int) -> DataFrame:
    """The newest published month and those before it, ``keep`` in all."""
    newest = published.agg(F.max(_date(F.col("month"))).alias("newest")).where("newest IS NOT NULL")
    first = F.add_months("newest", F.lit(1 - keep))
    days = newest.select(F.explode(F.sequence(first, F.col("newest"), F.expr("INTERVAL 1 MONTH"))).alias("start"))
    return days.select(F.date_format("start", "yyyy-MM").alias("month"))


def missing(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Wanted months without results."""
    return wanted.join(done.select("month").distinct(), "month", "left_anti")


def newest(months: DataFrame, n: int) -> DataFrame:
    """At most n months of a run, the newest."""
    return months.orderBy(F.desc("month")).limit(n)


def stale(done: DataFrame, wanted: DataFrame, confirmed: bool) -> DataFrame:
    """Months with results outside the window; none while the window is not confirmed."""
    return done.select("month").distinct().join(wanted, "month", "left_anti").where(F.lit(confirmed))


def choose(
    wanted: DataFrame, done: DataFrame, explicit: list[str] | None = None, everything: bool = False, cap: int | None = None
) -> DataFrame:
    """The months of a run: those named, else the whole window, else the missing ones."""
    if explicit:
        return wanted.sparkSession.createDataFrame([(m,) for m in explicit], "month string")
    months = wanted if everything else missing(wanted, done)
    return newest(months, cap) if cap else months
