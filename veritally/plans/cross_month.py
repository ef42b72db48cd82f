"""Rules that need more than one month, or something other than trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.operators import files, volume
from veritally.packs import rideshare
from veritally.sources.store import ResultStore

COMPANIES = list(rideshare.COMPANIES.values())


def causes_frame(spark, causes: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(causes.items()), "day string, cause string")


def volume_series(daily: DataFrame, causes: DataFrame) -> DataFrame:
    return volume.volume_series(volume.daily_totals(daily), causes, rideshare.VOLUME_DROP)


def month_results(
    facts: DataFrame, daily: DataFrame, aggregate: DataFrame, indicators: DataFrame, causes: DataFrame,
    expected_schema: list[tuple[str, str]] = list(rideshare.SCHEMA),
) -> DataFrame:
    """(rule, month, company, status, value, detail) for the six rules over files and months."""
    months = facts.select("month")
    trips = facts.select("month", F.explode("trips").alias("company", "trips"))
    codes = facts.select("month", F.explode("rows_by_license").alias("code", "rows"))
    documented = facts.sparkSession.createDataFrame([(c,) for c in rideshare.LICENSES], "code string")
    return files.union(
        files.reconcile(trips, aggregate, indicators, months, COMPANIES, rideshare.RECONCILE_TOLERANCE),
        files.totals_present(aggregate, months, COMPANIES),
        volume.volume_rule(volume_series(daily, causes), months, COMPANIES),
        files.published_late(facts, rideshare.PUBLICATION_LAG_DAYS),
        files.undocumented_codes(codes, "code", documented, months),
        files.schema_drift(facts, expected_schema),
    )


def build(store: ResultStore, aggregate: DataFrame, indicators: DataFrame, causes: DataFrame, expected_schema=None) -> None:
    """Judge every finished month and publish the results and the volume series."""
    facts, daily = store.read("facts"), store.read("daily")
    schema = expected_schema or list(rideshare.SCHEMA)
    store.publish("month_results", month_results(facts, daily, aggregate, indicators, causes, schema))
    store.publish("volume", volume_series(daily, causes))


def metadata(tables: dict[str, DataFrame], rules: int) -> DataFrame:
    """One row: months, rows per table, number of rules, time built."""
    counts = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias(name))
        counts = row if counts is None else counts.crossJoin(row)
    first = next(iter(tables.values()))
    months = first.agg(F.array_sort(F.collect_set("month")).alias("months"))
    return months.crossJoin(counts).select(
        "months", F.struct(*tables).alias("rows"), F.lit(rules).alias("rules"), F.current_timestamp().alias("built_at")
    )
