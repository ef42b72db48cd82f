"""Operations queries over the daily, hourly and zone summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.measures import metrics, ratio, totals
from veritally.operators.files import BOTH
from veritally.plans.status import compared

ALL = "All boroughs"
KPIS = {
    "trips": ("ratio", "up"),
    "fares": ("ratio", "up"),
    "driver_pay": ("ratio", "up"),
    "platform_share": ("points", None),
    "avg_wait": ("ratio", "down"),
    "avg_miles": ("ratio", None),
}


def filtered(df: DataFrame, month: str | None = None, company: str = BOTH, borough: str = ALL) -> DataFrame:
    if month is not None:
        df = df.where(F.col("month") == month)
    if company != BOTH:
        df = df.where(F.col("company") == company)
    return df if borough == ALL else df.where(F.col("borough") == borough)


def month_metrics(daily: DataFrame, company: str = BOTH, borough: str = ALL) -> DataFrame:
    """Totals and ratios per month, zero where the filter leaves nothing of a month."""
    months = daily.select("month").distinct()
    sums = months.join(filtered(daily, None, company, borough), "month", "left").groupBy("month").agg(*totals())
    return sums.select("*", *[m.alias(name) for name, m in metrics().items()])


def kpis(daily: DataFrame, company: str = BOTH, borough: str = ALL) -> DataFrame:
    """Six measures per month against the month before."""
    return compared(month_metrics(daily, company, borough), KPIS, [])


def trips_per_day(daily: DataFrame, company: str = BOTH, borough: str = ALL, days: int = 7) -> DataFrame:
    """Trips per day and company with the mean of the last ``days`` rows, fewer at the start."""
    sums = filtered(daily, None, company, borough).groupBy("day", "company").agg(F.sum("trips").alias("trips"))
    window = Window.partitionBy("company").orderBy("day").rowsBetween(1 - days, 0)
    return sums.withColumn("average", F.avg("trips").over(window))


def by_month(daily: DataFrame, borough: str = ALL) -> DataFrame:
    return filtered(daily, None, BOTH, borough).groupBy("month", "company").agg(*totals())


def fares_and_pay(daily: DataFrame, company: str = BOTH, borough: str = ALL) -> DataFrame:
    """Gross fares and driver pay per month as long rows."""
    sums = filtered(daily, None, company, borough).groupBy("month").agg(*totals("fares", "driver_pay"))
    return sums.select("month", F.inline(F.array(
        F.struct(F.lit("Gross fares").alias("measure"), F.col("fares").alias("value")),
        F.struct(F.lit("Driver pay").alias("measure"), F.col("driver_pay").alias("value")),
    )))


def market_share(daily: DataFrame, borough: str = ALL) -> DataFrame:
    """Each company's share of a month's trips, whatever the company filter."""
    total = F.sum("trips").over(Window.partitionBy("month"))
    return by_month(daily, borough).select("month", "company", "trips", ratio(F.col("trips"), total).alias("share"))


def demand(hourly: DataFrame, month: str, company: str = BOTH, borough: str = ALL) -> DataFrame:
    """Trips by weekday and hour."""
    return filtered(hourly, month, company, borough).groupBy("dow", "hour").agg(F.sum("trips").alias("trips"))


def demand_matrix(hourly: DataFrame, month: str, company: str = BOTH, borough: str = ALL) -> DataFrame:
    """The same with a column per hour."""
    return filtered(hourly, month, company, borough).groupBy("dow").pivot("hour", list(range(24))).agg(F.sum("trips"))


def wait_by_hour(hourly: DataFrame, month: str, company: str = BOTH, borough: str = ALL) -> DataFrame:
    """Mean minutes from request to pickup, from summed waits."""
    sums = filtered(hourly, month, company, borough).groupBy("company", "hour").agg(
        F.sum("wait_seconds").alias("wait"), F.sum("wait_trips").alias("n")
    )
    return sums.select("company", "hour", (ratio("wait", "n") / 60).alias("minutes"))


def zone_table(zones: DataFrame, month: str, company: str = BOTH, borough: str = ALL) -> DataFrame:
    """Pickup zones of a month with their totals and averages."""
    sums = filtered(zones, month, company, borough).groupBy("zone_id").agg(
        F.min("zone").alias("name"), F.min("borough").alias("borough"), *totals()
    )
    m = metrics()
    return sums.select(
        "zone_id", F.coalesce("name", F.concat(F.lit("Zone "), F.col("zone_id").cast("string"))).alias("zone"), "borough",
        "trips", "fares", m["avg_fare"].alias("avg_fare"), ratio("driver_pay", "trips").alias("pay_per_trip"),
        (m["avg_wait"] / 60).alias("wait_minutes"), m["avg_miles"].alias("miles"), "airport_trips",
    )


def top_zones(table: DataFrame, n: int = 12) -> DataFrame:
    """The n busiest zones with their share of all zones of the table."""
    total = table.agg(F.sum("trips").alias("all_trips"))
    top = table.orderBy(F.desc("trips"), "zone_id").limit(n)
    return top.crossJoin(total).select("zone_id", "zone", "borough", "trips", ratio("trips", "all_trips").alias("share"))


def search_zones(table: DataFrame, query: str) -> DataFrame:
    """Zones whose name or borough holds every word of the query."""
    text = F.lower(F.concat_ws(" ", "zone", "borough"))
    for word in query.lower().split():
        table = table.where(text.contains(word))
    return table


def sort_zones(table: DataFrame, column: str = "trips", descending: bool = True) -> DataFrame:
    key = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return table.orderBy(key, "zone_id")


def boroughs(daily: DataFrame) -> DataFrame:
    """Boroughs for the filter, the two that are none last."""
    last = F.when(F.col("borough").isin("Unknown", "N/A"), 1).otherwise(0)
    return daily.select("borough").distinct().orderBy(last, "borough")


def airport_share(daily: DataFrame, company: str = BOTH, borough: str = ALL) -> DataFrame:
    """Share of trips charged the airport fee, per month and company."""
    sums = filtered(by_month(daily, borough), None, company)
    return sums.select("month", "company", "airport_trips", ratio("airport_trips", "trips").alias("share"))


def total_trips(daily: DataFrame) -> DataFrame:
    return daily.agg(F.sum("trips").alias("trips"))
