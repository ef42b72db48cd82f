"""Landed inputs: trip files, the zone lookup and the published totals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import clock
from veritally.sources import footers

# Column names and types of the published CSV files.
ZONES = "LocationID int, Borough string, Zone string, service_zone string"
AGGREGATE = (
    "base_license_number string, year int, month int, total_dispatched_trips bigint, "
    "total_dispatched_shared_trips bigint, unique_dispatched_vehicles bigint"
)
INDICATORS = (
    "`Month/Year` string, `License Class` string, `Trips Per Day` string, `Unique Drivers` string, "
    "`Unique Vehicles` string, `Trips Per Day Shared` string"
)
INDICATOR_CLASS = "FHV - High Volume"
INDICATORS_FROM = "2024-01"


def read_trips(
    spark: SparkSession, path: str, declared: Sequence[tuple[str, str]], months: list[str] | None = None, found: DataFrame | None = None
) -> DataFrame:
    """Trip files under ``path/file_month=YYYY-MM/`` with the declared columns and types, and file_month.

    Files with the same columns are one scan, with those columns as its schema, so nothing is inferred and the
    types of one month cannot break another. Columns match by name, in any case; a missing one is null, another
    type is cast (null where a value does not fit), undeclared ones are left out. With months, only
    their files are opened. `found` is the footer scan, where there is one already.
    """
    found = footers.footers(spark, path, months) if found is None else found if months is None else found.where(F.col("file_month").isin(months))
    # The driver lists files in any case, as Spark does for every scan; schemas are few.
    groups = found.groupBy("schema").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    frames = [_same_columns(spark, path, declared, group["schema"], group["paths"]) for group in sorted(groups, key=lambda g: g["paths"])]
    if not frames:
        return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in (*declared, ("file_month", "string"))))
    return reduce(DataFrame.unionByName, frames)


def _same_columns(spark: SparkSession, path: str, declared, schema, paths: list[str]) -> DataFrame:
    """One scan of files with the same columns; the month's type is given too, so that 2026-06 stays text."""
    own = {field["name"].lower(): field for field in schema}
    there = [own[name.lower()] for name, _ in declared if name.lower() in own]
    ddl = ", ".join(f"`{field['name']}` {field['type']}" for field in there)
    rows = spark.read.schema(f"{ddl}{', ' * bool(ddl)}file_month string").option("basePath", path).parquet(*paths)
    columns = []
    for name, kind in declared:
        field = own.get(name.lower())
        if field is None:
            columns.append(F.lit(None).cast(kind).alias(name))
        else:
            column = F.col(f"`{field['name']}`")
            columns.append((column if field["type"] == kind else column.try_cast(kind)).alias(name))
    return rows.select(*columns, "file_month")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Tables with differing columns; what one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def landed_files(trips: DataFrame) -> DataFrame:
    """Per month: bytes, rows and modification time of the landed files.

    Rows are counted without reading a column; file attributes come from the scan.
    """
    per_file = trips.groupBy(
        "file_month", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).agg(F.count(F.lit(1)).alias("rows"))
    return per_file.groupBy(F.col("file_month").alias("month")).agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max("modified").alias("last_modified")
    )


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ZONES).csv(path, header=True)


def read_aggregate(spark: SparkSession, path: str, first: str | None = None, bases: Sequence[str] | None = None) -> DataFrame:
    return aggregate_totals(spark.read.schema(AGGREGATE).csv(path, header=True), first, bases)


def aggregate_totals(aggregate: DataFrame, first: str | None = None, bases: Sequence[str] | None = None) -> DataFrame:
    """(month, company, total): year and month padded, the company's name in title case.

    `first` is the first month to take and `bases` the companies, by the upper-case names of the file; None takes all.
    """
    month = F.format_string("%d-%02d", "year", "month")
    if first is not None:
        aggregate = aggregate.where(month >= first)
    if bases is not None:
        aggregate = aggregate.where(F.upper("base_license_number").isin(list(bases)))
    return aggregate.select(
        F.format_string("%d-%02d", "year", "month").alias("month"),
        F.initcap("base_license_number").alias("company"),
        F.col("total_dispatched_trips").alias("total"),
    )


def read_indicators(spark: SparkSession, path: str, first: str = INDICATORS_FROM) -> DataFrame:
    return indicator_totals(select_indicators(spark.read.schema(INDICATORS).csv(path, header=True), first))


def select_indicators(indicators: DataFrame, first: str = INDICATORS_FROM) -> DataFrame:
    """The licence class and months that are used, oldest first."""
    return indicators.where(
        (F.col("License Class") == INDICATOR_CLASS) & (F.col("Month/Year") >= first)
    ).select(
        "Month/Year", "License Class", "Trips Per Day", "Unique Drivers", "Unique Vehicles", "Trips Per Day Shared"
    ).orderBy("Month/Year")


def indicator_totals(indicators: DataFrame) -> DataFrame:
    """(month, total): trips per day, written with commas, times the days of the month."""
    month = F.col("Month/Year")
    return indicators.select(
        month.alias("month"),
        (F.regexp_replace("Trips Per Day", ",", "").cast("bigint") * clock.days_in_month(month)).alias("total"),
    )
