"""Trip-shaped rows derived from the star-schema test tables.

The expressions are integer arithmetic on ``lineitem`` columns and the same text for every
SQL engine, but for the few functions a :class:`Dialect` names. Every rule of the ride-hail
pack finds some of these rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import clock


@dataclass(frozen=True)
class Dialect:
    plus_seconds: str
    month_text: str
    long: str = "BIGINT"


SPARK = Dialect("timestampadd(SECOND, CAST({n} AS INT), {ts})", "concat(year({ts}), '-', lpad(month({ts}), 2, '0'))")
DUCKDB = Dialect("({ts} + to_seconds({n}))", "strftime({ts}, '%Y-%m')")

TT = "(30 + (k * 31) % 5400 + CASE WHEN k % 301 = 0 THEN 20000 ELSE 0 END)"
DO_ZONE = "(1 + (l_suppkey * 7) % 265)"
PU_ZONE = "(CASE WHEN k % 509 = 0 THEN 300 ELSE 1 + l_partkey % 265 END)"
FARE = "(CASE WHEN k % 71 = 0 THEN 0 WHEN k % 67 = 0 THEN -l_extendedprice / 1000 ELSE l_extendedprice / 1000 END)"


def base_columns(d: Dialect) -> dict[str, str]:
    """The two columns the others build on."""
    k = "(l_orderkey * 8 + l_linenumber)"
    return {"k": k, "pickup": d.plus_seconds.format(ts="l_shipdate", n=f"({k} * 7919 % 86400)")}


def trip_columns(d: Dialect) -> dict[str, str]:
    def at(n: str) -> str:
        return d.plus_seconds.format(ts="pickup", n=f"({n})")

    return {
        "hvfhs_license_num":
            "CASE WHEN k % 50 = 0 THEN 'HV0004' WHEN l_returnflag = 'A' THEN 'HV0005' ELSE 'HV0003' END",
        "dispatching_base_num": "CASE WHEN l_returnflag = 'A' THEN 'B03406' ELSE 'B03404' END",
        "originating_base_num":
            "CASE WHEN k % 353 = 0 THEN 'X99' WHEN l_returnflag = 'A' AND k % 11 <> 0 THEN NULL ELSE 'B03404' END",
        "request_datetime": at("CASE WHEN k % 53 = 0 THEN 120 WHEN k % 211 = 0 THEN -8000 ELSE -(60 + k % 900) END"),
        "on_scene_datetime":
            f"CASE WHEN k % 463 = 0 THEN NULL ELSE {at('CASE WHEN k % 401 = 0 THEN 5 ELSE -(k % 5) * 10 END')} END",
        "pickup_datetime": "pickup",
        "dropoff_datetime":
            at(f"CASE WHEN k % 389 = 0 THEN -10 WHEN k % 97 = 0 THEN {TT} + 400 ELSE {TT} END"),
        "PULocationID": f"CAST({PU_ZONE} AS INT)",
        "DOLocationID": f"CAST({DO_ZONE} AS INT)",
        "trip_miles":
            "CAST(CASE WHEN k % 307 = 0 THEN 150 WHEN k % 373 = 0 THEN 0 ELSE (k * 13 % 3000) / 100 END AS DOUBLE)",
        "trip_time": f"CAST({TT} AS {d.long})",
        "base_passenger_fare": f"CAST({FARE} AS DOUBLE)",
        "tolls": "CAST(CASE WHEN k % 10 = 0 THEN 6.94 ELSE 0 END AS DOUBLE)",
        "bcf": "CAST(0.5 AS DOUBLE)",
        "sales_tax": "CAST(CASE WHEN k % 6 = 0 THEN 0 ELSE l_tax * 10 END AS DOUBLE)",
        "congestion_surcharge":
            "CAST(CASE WHEN k % 313 = 0 THEN 5.5 WHEN k % 3 = 1 THEN 2.75 WHEN k % 3 = 2 THEN 0.75 ELSE 0 END AS DOUBLE)",
        "airport_fee":
            f"CAST(CASE WHEN k % 317 = 0 THEN 3 WHEN {PU_ZONE} IN (1, 132, 138) OR {DO_ZONE} IN (1, 132, 138) "
            "THEN CASE WHEN k % 7 = 0 THEN 3.5 WHEN k % 9 = 0 THEN 0 ELSE 2.5 END ELSE 0 END AS DOUBLE)",
        "tips": "CAST(CASE WHEN k % 331 = 0 THEN -1 ELSE l_discount * 20 END AS DOUBLE)",
        "driver_pay": "CAST(CASE WHEN k % 367 = 0 THEN NULL WHEN k % 337 = 0 THEN 0 ELSE l_quantity END AS DOUBLE)",
        "shared_request_flag": "CASE WHEN k % 4 = 0 THEN 'Y' ELSE 'N' END",
        "shared_match_flag": "CASE WHEN k % 8 = 0 OR k % 43 = 0 THEN 'Y' ELSE 'N' END",
        "access_a_ride_flag": "CASE WHEN k % 701 = 0 THEN 'X' ELSE 'N' END",
        "wav_request_flag": "CASE WHEN k % 11 = 0 THEN 'Y' ELSE 'N' END",
        "wav_match_flag": "CASE WHEN k % 10 = 0 THEN 'Y' ELSE 'N' END",
        "cbd_congestion_fee": "CAST(CASE WHEN k % 347 = 0 THEN 3 WHEN k % 2 = 0 THEN 1.5 ELSE 0 END AS DOUBLE)",
        "file_month": f"CASE WHEN k % 359 = 0 THEN '1900-01' ELSE {d.month_text.format(ts='l_shipdate')} END",
    }


# Copies: every 997th trip again as it is, every 991st with another tip.
COPIES = {"k % 997 = 0": "tips", "k % 991 = 0": "tips + 1"}
# A task may read so many times its even share of the lines before they are dealt out.
MOST_SHARES = 2
BOROUGHS = ("Bronx", "Brooklyn", "EWR", "Manhattan", "Queens", "Staten Island")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines, dealt out where the scan leaves most of them to few tasks.

    A row group is read by one task, and the smaller test tables are files of one. Large files have many, and are read
    as they are: dealing them out would send every row across the network once for each scan. Rows of a task are
    counted from the footers, without reading a column.
    """
    rows, tasks = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.sparkContext.defaultParallelism
    counts = rows.groupBy(F.spark_partition_id().alias("task")).count()
    most, of_all = counts.agg(F.max("count"), F.sum("count")).first()
    if most is None or most * tasks <= MOST_SHARES * of_all:
        return rows
    return rows.repartition(tasks, "l_orderkey", "l_partkey")


def lines_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines dealt by their trip's month and half of its hours: narrower rows than the trips made of them."""
    base = base_columns(SPARK)
    month = re.sub(r"\bk\b", base["k"], trip_columns(SPARK)["file_month"])
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(F.expr(month), F.expr(f"hour({base['pickup']}) % 2"))


def trips(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The trip fixture, of the given order lines or all; each copy is exploded from its row, so lines are read once."""
    lines = lineitem(spark, sf_dir) if lines is None else lines
    columns = trip_columns(SPARK)
    base = base_columns(SPARK)
    again = [F.when(F.expr(test), F.lit(i)) for i, test in enumerate(COPIES, 1)]
    copy = F.explode(F.array_compact(F.array(F.lit(0), *again)))
    shaped = (
        lines.withColumns({name: F.expr(text) for name, text in base.items()})
        .select("k", *[F.expr(text).alias(name) for name, text in columns.items()])
        .withColumn("copy", copy)
    )
    tips = F.col("tips")
    for i, text in enumerate(COPIES.values(), 1):
        tips = F.when(F.col("copy") == i, F.expr(text)).otherwise(tips)
    return shaped.withColumn("tips", tips).drop("k", "copy")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order belongs to one of 265 zones; a zone's texts are the smallest of its orders."""
    zone = (F.col("o_orderkey") % 265 + 1).cast("int").alias("LocationID")
    borough = F.element_at(F.array(*[F.lit(b) for b in BOROUGHS]), F.col("LocationID") % 6 + 1)
    return (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .groupBy(zone).agg(F.min("o_orderpriority").alias("priority"), F.min("o_orderstatus").alias("service_zone"))
        .select("LocationID", borough.alias("Borough"), F.concat_ws(" ", "priority", "LocationID").alias("Zone"), "service_zone")
    )


# What goes with the trips: a month named 1900-01 holds misfiled rows and was never published.
NO_MONTH = "1900-01"
NOT_DATED = "1996-06"
CAUSES = {
    "1995-12-25": "Christmas Day",
    "1996-07-04": "Independence Day",
    "1997-11-27": "Thanksgiving",
    "1999-01-01": "New Year's Day",
    "2000-12-25": "Christmas Day",
}


def published(trips: DataFrame) -> DataFrame:
    """(month, published): later in the year means later after the month; one month has no date."""
    month = F.col("month")
    number = F.substring(month, 6, 2).cast("int")
    return trips.select(F.col("file_month").alias("month")).where(month != NO_MONTH).distinct().select(
        "month", F.when(month != NOT_DATED, F.date_add(clock.month_end(month), 20 + 7 * number)).alias("published")
    )


def schemas(months: DataFrame, schema: tuple) -> DataFrame:
    """(month, schema): as documented, but for a missing, a swapped, and a retyped and an added column."""

    def listed(fields):
        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in fields])

    first = months.agg(F.min("month").alias("first"))
    retyped = [(n, "double" if n == "trip_time" else t) for n, t in schema] + [("congestion_zone", "int")]
    column = (
        F.when(F.col("month") == F.col("first"), listed(schema[:-1]))
        .when(F.col("month") == "1997-03", listed([schema[1], schema[0], *schema[2:]]))
        .when(F.col("month") == "1998-05", listed(retyped))
        .otherwise(listed(schema))
    )
    return months.crossJoin(first).select("month", column.alias("schema"))


def reference_files(company_trips: DataFrame) -> dict[str, DataFrame]:
    """Published totals with the columns of their files.

    aggregate: no December, a twentieth less in May and October. indicators: trips per day
    written with thousands commas, no November, and a row of another licence class.
    """
    trips = company_trips.where(F.col("month") != NO_MONTH)
    number = F.substring("month", 6, 2).cast("int")
    short = F.when(number % 5 == 0, F.floor(F.col("trips") / 20)).otherwise(0)
    none = F.lit(0).cast("bigint")
    aggregate = trips.where(number != 12).select(
        F.upper("company").alias("base_license_number"), F.substring("month", 1, 4).cast("int").alias("year"),
        number.alias("month"), (F.col("trips") - short).alias("total_dispatched_trips"),
        none.alias("total_dispatched_shared_trips"), none.alias("unique_dispatched_vehicles"),
    )
    per_day = F.floor(F.sum("trips") / F.first(clock.days_in_month(F.col("month"))))
    monthly = trips.where(number != 11).groupBy("month").agg(F.format_number(per_day, 0).alias("Trips Per Day"))
    classes = F.explode(F.array(F.lit("FHV - High Volume"), F.lit("Yellow")))
    indicators = monthly.select(
        F.col("month").alias("Month/Year"), classes.alias("License Class"), "Trips Per Day",
        *[F.lit("0").alias(c) for c in ("Unique Drivers", "Unique Vehicles", "Trips Per Day Shared")],
    )
    return {"aggregate": aggregate, "indicators": indicators}
