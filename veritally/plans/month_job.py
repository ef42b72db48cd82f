"""The month job: from landed trips to the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions import clock
from veritally.functions.measures import MEASURES
from veritally.operators import checks, examples, summaries
from veritally.packs import rideshare
from veritally.session import shared_dir
from veritally.sources.store import ResultStore

GRAINS = {
    "daily": ["month", "day", "company", "borough"],
    "hourly": ["month", "company", "borough", "dow", "hour"],
    "zones": ["month", "company", "borough", "zone_id"],
}
HOURLY = ["trips", "fares", "wait_seconds", "wait_trips"]


def summary_trips(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per trip that began in its file's month, with what the summaries add up.

    Zones are a declared dimension of some hundred rows, so they are broadcast.
    """
    pickup, request = F.col("pickup_datetime"), F.col("request_datetime")
    wait = F.when(
        (pickup >= request) & (pickup < request + F.expr("INTERVAL 2 HOUR")), clock.seconds_between(request, pickup)
    )
    rider_total = sum(
        (F.col(c) for c in ("tolls", "bcf", "sales_tax", "congestion_surcharge")), F.col("base_passenger_fare")
    ) + F.coalesce("airport_fee", F.lit(0)) + F.coalesce("cbd_congestion_fee", F.lit(0)) + F.col("tips")
    lookup = zones.select(F.col("LocationID").alias("zone_id"), F.col("Borough").alias("borough"))
    return (
        trips.where(F.col("hvfhs_license_num").isin(*rideshare.COMPANIES))
        .where(clock.month_index(pickup) == clock.month_text_index(F.col("file_month")))
        .select(
            F.col("file_month").alias("month"), rideshare.company().alias("company"),
            F.to_date(pickup).alias("day"), clock.iso_weekday(pickup).alias("dow"), F.hour(pickup).alias("hour"),
            F.col("PULocationID").alias("zone_id"), F.col("base_passenger_fare").alias("fare"), "driver_pay", "tips",
            rider_total.alias("rider_total"), F.col("trip_miles").alias("miles"),
            F.col("trip_time").alias("trip_seconds"), wait.alias("wait_seconds"),
            (F.col("airport_fee") > 0).alias("airport"), (F.col("shared_match_flag") == "Y").alias("shared"),
            (F.col("wav_request_flag") == "Y").alias("wav"),
        )
        .join(F.broadcast(lookup), "zone_id", "left")
        .withColumn("borough", F.coalesce("borough", F.lit("Unknown")))
    )


# Money and miles are summed in whole hundredths, so that a sum does not depend on its order.
HUNDREDTHS = ("fares", "driver_pay", "tips", "rider_total", "miles")


def hundredths(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def measures() -> dict[str, Column]:
    return {
        "trips": F.count(F.lit(1)),
        "fares": F.sum(hundredths("fare")),
        "driver_pay": F.sum(hundredths("driver_pay")),
        "tips": F.sum(hundredths("tips")),
        "rider_total": F.sum(hundredths("rider_total")),
        "miles": F.sum(hundredths("miles")),
        "trip_seconds": F.sum("trip_seconds"),
        "wait_seconds": F.sum("wait_seconds"),
        "wait_trips": F.count("wait_seconds"),
        "airport_trips": F.count_if("airport"),
        "shared_trips": F.count_if("shared"),
        "wav_trips": F.count_if("wav"),
    }


def _in_units(sums: DataFrame) -> DataFrame:
    return sums.withColumns({name: F.col(name) / 100 for name in HUNDREDTHS})


def summary(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """All three grains, told apart by ``grain``."""
    return _in_units(summaries.grains(summary_trips(trips, zones), GRAINS, measures()))


def one_grain(trips: DataFrame, zones: DataFrame, name: str) -> DataFrame:
    """A single grain, aggregated directly: one shuffle of its own groups."""
    rows = summaries.aggregate(summary_trips(trips, zones), GRAINS[name], measures())
    return _in_units(rows).withColumn("grain", F.lit(name))


def _typed(df: DataFrame) -> DataFrame:
    """Counts as int, sums as double, dates as text: what the reports read."""
    counts = ("trips", "wait_trips", "airport_trips", "shared_trips", "wav_trips")
    return df.select(*[
        F.col(c).cast("int").alias(c) if c in counts
        else F.col(c).cast("double").alias(c) if c in MEASURES
        else F.col(c).cast("string").alias(c) if c == "day" else F.col(c)
        for c in df.columns
    ])


def daily(summary: DataFrame) -> DataFrame:
    return _typed(summaries.pick(summary, "daily", ["day", "month", "company", "borough"], list(MEASURES)))


def hourly(summary: DataFrame) -> DataFrame:
    return _typed(summaries.pick(summary, "hourly", ["month", "company", "borough", "dow", "hour"], HOURLY))


def zone_totals(summary: DataFrame, zones: DataFrame) -> DataFrame:
    """By pickup zone, with the zone's name; trips without a zone are left out."""
    named = F.broadcast(zones.select(F.col("LocationID").alias("zone_id"), F.col("Zone").alias("zone")))
    rows = summaries.pick(summary, "zones", ["month", "company", "zone_id", "borough"], list(MEASURES))
    joined = rows.where(F.col("zone_id").isNotNull()).join(named, "zone_id", "left")
    return _typed(joined.select("month", "company", "zone_id", "zone", "borough", *MEASURES))


def quality(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """(month, day, company, rule, failed, checked) for every rule over trips."""
    results = checks.check(rideshare.trip_view(trips, zones), rideshare.RIDESHARE)
    return results.select(
        F.col("file_month").alias("month"), F.col("day").cast("string").alias("day"), "company", "rule",
        F.col("failed").cast("int").alias("failed"), F.col("checked").cast("int").alias("checked"),
    )


def licence_counts(trips: DataFrame) -> DataFrame:
    """Rows by licence code, of every code in the file."""
    return trips.groupBy(F.col("file_month").alias("month"), "hvfhs_license_num").agg(F.count(F.lit(1)).alias("rows"))


def company_trips(trips: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Trips per month and company, whatever month they began in. counts: those by licence, where there are any already."""
    return (
        (licence_counts(trips) if counts is None else counts).where(F.col("hvfhs_license_num").isin(*rideshare.COMPANIES))
        .groupBy("month", rideshare.company().alias("company")).agg(F.sum("rows").alias("trips"))
    )


def file_facts(trips: DataFrame, published: DataFrame, schemas: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """A row per month: rows, rows by licence, trips by company, publication date and lag, schema.

    published (month, published); schemas (month, schema) and what else is known of a month's files, which
    is passed on. Months are those published. counts: those by licence, where there are any already.
    """
    counts = (licence_counts(trips) if counts is None else counts).withColumn("company", rideshare.company())
    pairs = counts.groupBy("month").agg(
        F.sum("rows").alias("rows"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.coalesce("hvfhs_license_num", F.lit("")).alias("code"), "rows")
        ))).alias("rows_by_license"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("company").isNotNull(), F.struct("company", "rows"))
        ))).alias("trips"),
    )
    lag = F.date_diff("published", clock.month_end(F.col("month")))
    return pairs.join(published, "month").join(schemas, "month", "left").select(
        "month", "rows", "rows_by_license", "trips", "published", lag.alias("lag_days"),
        *[c for c in schemas.columns if c != "month"],
    )


def example_table(trips: DataFrame, zones: DataFrame, n: int = rideshare.EXAMPLES) -> DataFrame:
    """(month, rule, rank, company, day, record): record is JSON of the columns the rule shows."""
    view = rideshare.trip_view(trips, zones)
    found = examples.example_records(view, rideshare.RIDESHARE, n)
    return examples.as_json(found, rideshare.RIDESHARE).withColumnRenamed("file_month", "month")


def run_months(
    trips: DataFrame, zones: DataFrame, published: DataFrame, schemas: DataFrame, store: ResultStore
) -> str:
    """Compute the months of ``trips`` and make them visible together; returns the run's id.

    Each table is one job over the landed files, reading only its own columns. That costs
    less than keeping the trips: a cached copy of every column is larger than the files.
    """
    shared_dir(store.spark)
    run = store.new_run()
    write_quality(trips, zones, store, run)
    write_summaries(trips, zones, published, schemas, store, run)
    write_examples(trips, zones, store, run)
    store.finish(run)
    return run


def write_quality(trips: DataFrame, zones: DataFrame, store: ResultStore, run: str) -> None:
    store.write("quality", quality(trips, zones), run, ("rule", "company", "day"))


def write_summaries(
    trips: DataFrame, zones: DataFrame, published: DataFrame, schemas: DataFrame, store: ResultStore, run: str,
    counts: DataFrame | None = None,
) -> None:
    """The three summaries, which come from one pass (the small result is kept between the writes), and the facts."""
    grains = summary(trips, zones).checkpoint()
    store.write("daily", daily(grains), run, ("day", "company", "borough"))
    store.write("hourly", hourly(grains), run, ("company", "borough", "dow", "hour"))
    store.write("zones", zone_totals(grains, zones), run, ("company", "trips"))
    store.write("facts", file_facts(trips, published, schemas, counts), run)


def write_examples(trips: DataFrame, zones: DataFrame, store: ResultStore, run: str) -> None:
    store.write("examples", example_table(trips, zones), run, ("rule", "rank"))
