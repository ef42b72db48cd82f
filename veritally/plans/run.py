"""The unattended run: from landed files to published results, month by month.

The run chooses its months from what has landed, is published and has no finished results; computes
them one after the other, each made visible whole; judges what spans months; writes a document a
month; and retires months outside the window. A month is the unit of recovery: a run that is
lost is started again and goes on at the first month that is not finished, from the same files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.packs import rideshare
from veritally.plans import cross_month, month_job, months
from veritally.session import shared_dir
from veritally.sources import footers, readers
from veritally.sources.store import ResultStore, documents, write_documents

#: Months that an unattended run computes, the newest first.
MOST_MONTHS = 3


@dataclass(frozen=True)
class Landing:
    """Where inputs have landed: trips by month, the zone lookup, both published totals; and when months were published."""

    trips: str
    zones: str
    aggregate: str
    indicators: str
    published: DataFrame
    causes: DataFrame
    first_total: str = readers.INDICATORS_FROM


def run(
    spark: SparkSession, landing: Landing, store: ResultStore, explicit: list[str] | None = None, everything: bool = False,
    keep: int = rideshare.KEEP_MONTHS, cap: int | None = MOST_MONTHS, confirmed: bool = False,
) -> list[str]:
    """The months computed. `confirmed` says that the published window is sure, so that older months may go."""
    shared_dir(spark)
    found = footers.footers(spark, landing.trips).checkpoint()
    there = landing.published.join(found.select(F.col("file_month").alias("month")).distinct(), "month", "left_semi")
    wanted = months.window(there, keep).join(there.select("month"), "month", "left_semi")
    chosen = months.choose(wanted, store.months(), explicit, everything, cap)
    zones = readers.read_zones(spark, landing.zones)
    done = [row["month"] for row in chosen.orderBy("month").collect()]
    for month in done:
        of_month = found.where(F.col("file_month") == month)
        trips = readers.read_trips(spark, landing.trips, rideshare.SCHEMA, [month], found)
        month_job.run_months(trips, zones, there, file_details(of_month), store)
    if store.finished():
        finish(spark, landing, store)
    stale = months.stale(store.months(), wanted, confirmed)
    store.retire(sorted(row["month"] for row in stale.collect()), confirmed)
    return done


def file_details(found: DataFrame) -> DataFrame:
    """(month, schema, others, files, bytes, last_modified) from the footers."""
    return footers.month_schemas(found).join(footers.by_month(found).drop("rows"), "month")


def finish(spark: SparkSession, landing: Landing, store: ResultStore) -> None:
    """What spans months, from every finished month; and each month's document."""
    aggregate = readers.read_aggregate(spark, landing.aggregate, landing.first_total, [c.upper() for c in rideshare.COMPANIES.values()])
    indicators = readers.read_indicators(spark, landing.indicators, landing.first_total)
    cross_month.build(store, aggregate, indicators, landing.causes)
    write_documents(documents(store.read("facts"), store.read("examples")), f"{store.base}/documents")
