"""Rule pack for ride-hail trip files: one row per trip, one file per month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions import clock
from veritally.operators.references import mark_known
from veritally.rules import Rule, RulePack, SameRecord, columns_of

# What the published trip files and their dictionary define.
LICENSES = {"HV0002": "Juno", "HV0003": "Uber", "HV0004": "Via", "HV0005": "Lyft"}
COMPANIES = {"HV0003": "Uber", "HV0005": "Lyft"}
ZONE = "America/New_York"
AIRPORTS = (1, 132, 138)
SCHEMA = (
    ("hvfhs_license_num", "string"),
    ("dispatching_base_num", "string"),
    ("originating_base_num", "string"),
    ("request_datetime", "timestamp_ntz"),
    ("on_scene_datetime", "timestamp_ntz"),
    ("pickup_datetime", "timestamp_ntz"),
    ("dropoff_datetime", "timestamp_ntz"),
    ("PULocationID", "int"),
    ("DOLocationID", "int"),
    ("trip_miles", "double"),
    ("trip_time", "bigint"),
    ("base_passenger_fare", "double"),
    ("tolls", "double"),
    ("bcf", "double"),
    ("sales_tax", "double"),
    ("congestion_surcharge", "double"),
    ("airport_fee", "double"),
    ("tips", "double"),
    ("driver_pay", "double"),
    ("shared_request_flag", "string"),
    ("shared_match_flag", "string"),
    ("access_a_ride_flag", "string"),
    ("wav_request_flag", "string"),
    ("wav_match_flag", "string"),
    ("cbd_congestion_fee", "double"),
)
OPTIONAL = ("originating_base_num", "on_scene_datetime")
FLAGS = ("shared_request_flag", "shared_match_flag", "access_a_ride_flag", "wav_request_flag", "wav_match_flag")
# What is charged beside the fare: the amounts of the schema but for the fare, the pay and the distance.
FEES = tuple(name for name, kind in SCHEMA if kind == "double" and name not in ("base_passenger_fare", "driver_pay", "trip_miles"))
RECONCILE_TOLERANCE = 0.005
PUBLICATION_LAG_DAYS = 62
VOLUME_DROP = 0.25
KEEP_MONTHS = 12
EXAMPLES = 3
DIMENSIONS = {
    "accuracy": "totals against those published elsewhere",
    "completeness": "values that are absent",
    "consistency": "values of one record against each other",
    "integrity": "codes and ids against the tables that list them",
    "reasonability": "speeds, amounts and volumes out of proportion",
    "timeliness": "dates of files and of what is in them",
    "uniqueness": "records that occur again",
    "validity": "values outside their type, format or list",
}

# The dimension that the first letters of an id name.
PREFIXES = {
    "ACC": "accuracy", "CMP": "completeness", "CNS": "consistency", "INT": "integrity",
    "RSN": "reasonability", "TML": "timeliness", "UNQ": "uniqueness", "VAL": "validity",
}

COLUMNS = tuple(name for name, _ in SCHEMA)
REQUIRED = tuple(c for c in COLUMNS if c not in OPTIONAL)
# Copies are looked for within a file; a trip's company and day follow from its key.
FILE = ("file_month", "company", "day")
TRIP_KEY = (
    "company", "request_datetime", "pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID", "trip_miles",
)


def any_of(columns, condition: str) -> str:
    return " OR ".join(f"{c} {condition}" for c in columns)


def trip_view(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Trips of the operating companies, with the columns the rules are written against.

    ``zones`` (LocationID) adds ``pu_known`` and ``do_known``: whether a zone is in the
    lookup, null where the trip names no zone. Columns a query does not use cost nothing;
    the optimiser drops them, and with them the lookup joins.
    """
    pickup, dropoff = F.col("pickup_datetime"), F.col("dropoff_datetime")
    trips = trips.where(F.col("hvfhs_license_num").isin(*COMPANIES))
    if zones is not None:
        # Before the derived columns, so that those end up in the projection that uses them.
        trips = mark_known(trips, {"PULocationID": "pu_known", "DOLocationID": "do_known"}, zones, "LocationID", dimension=True)
    return trips.select(
        "*",
        company().alias("company"),
        F.to_date(pickup).alias("day"),
        clock.seconds_between(pickup, dropoff).alias("elapsed"),
        clock.local_seconds_between(pickup, dropoff, ZONE).alias("elapsed_ny"),
        clock.clocks_go_back(pickup).alias("fall_back"),
        (F.col("PULocationID").isin(*AIRPORTS) | F.col("DOLocationID").isin(*AIRPORTS)).alias("touches_airport"),
        (clock.month_index(pickup) - clock.month_text_index(F.col("file_month"))).alias("months_off"),
    )


def company():
    """The operating company behind a licence; null for any other."""
    out = F.lit(None).cast("string")
    for licence, name in COMPANIES.items():
        out = F.when(F.col("hvfhs_license_num") == licence, name).otherwise(out)
    return out


# The columns that trip_view adds, and the columns of the schema that each is made from.
DERIVED = {
    "elapsed": ("pickup_datetime", "dropoff_datetime"),
    "elapsed_ny": ("pickup_datetime", "dropoff_datetime"),
    "fall_back": ("pickup_datetime",),
    "touches_airport": ("PULocationID", "DOLocationID"),
    "months_off": ("pickup_datetime",),
    "pu_known": ("PULocationID",),
    "do_known": ("DOLocationID",),
}
CONTEXT = ("pickup_datetime", "base_passenger_fare")


def shown(predicate: str) -> tuple[str, ...]:
    """What an example of a failing trip shows: the company, what the predicate is about, and the context, in schema order."""
    names = columns_of(predicate)
    about = names.union(CONTEXT, *(DERIVED[name] for name in names if name in DERIVED))
    return ("company", *(c for c in COLUMNS if c in about))


def on_trip(id: str, title: str, severity: str, verdict: str, fails: str, applies: str | None = None) -> Rule:
    return Rule(id, title, PREFIXES[id[:3]], severity, verdict, fails=fails, applies=applies, shows=shown(fails))


def on_file(id: str, title: str, severity: str, verdict: str, test: str) -> Rule:
    return Rule(id, title, PREFIXES[id[:3]], severity, verdict, test)


def on_copies(id: str, title: str, severity: str, verdict: str, same: SameRecord) -> Rule:
    return Rule(id, title, PREFIXES[id[:3]], severity, verdict, same=same)


# Ids, severities, verdicts, and the conditions with their amounts, codes and bounds. They stand here alone.
RULES = (
    on_trip("CMP-01", "originating_base_num is null", "warning", "defect", "originating_base_num IS NULL"),
    on_trip("CMP-02", "on_scene_datetime is null", "warning", "documentation gap", "on_scene_datetime IS NULL"),
    on_trip("CMP-03", "a required column is null", "error", "defect", any_of(REQUIRED, "IS NULL")),
    on_trip("CMP-04", "a zone is 264", "warning", "defect", "PULocationID = 264 OR DOLocationID = 264"),
    on_trip("CMP-05", "on_scene_datetime = pickup_datetime", "warning", "documentation gap",
            "on_scene_datetime = pickup_datetime"),
    on_copies("UNQ-01", "copies in all columns", "error", "defect", SameRecord(TRIP_KEY, REQUIRED + OPTIONAL, FILE)),
    on_copies("UNQ-02", "copies in the trip key", "error", "defect", SameRecord(TRIP_KEY, scope=FILE)),
    on_trip("VAL-01", "a flag other than Y, N", "error", "defect", any_of(FLAGS, "NOT IN ('Y', 'N')")),
    on_trip("VAL-02", "a base other than B and 5 digits", "error", "defect",
            r"NOT dispatching_base_num RLIKE r'^B\d{5}\z' OR NOT originating_base_num RLIKE r'^B\d{5}\z'"),
    on_trip("VAL-03", "base_passenger_fare < 0", "warning", "business rule", "base_passenger_fare < 0"),
    on_trip("VAL-04", "base_passenger_fare = 0", "warning", "defect", "base_passenger_fare = 0"),
    on_trip("VAL-05", "an amount beside the fare < 0", "error", "defect", any_of(FEES, "< 0")),
    on_trip("VAL-06", "driver_pay <= 0", "warning", "defect", "driver_pay <= 0"),
    on_trip("VAL-07", "trip_miles <= 0", "warning", "defect", "trip_miles <= 0"),
    on_trip("VAL-08", "a surcharge outside its list", "warning", "defect",
            "congestion_surcharge NOT IN (0, 0.75, 2.75) OR cbd_congestion_fee NOT IN (0, 1.5) "
            "OR airport_fee NOT IN (0, 1.25, 2.5, 5, 1.75, 3.5, 7)"),
    on_trip("VAL-09", "airport_fee outside 1.25, 2.5, 5", "warning", "documentation gap",
            "airport_fee > 0 AND airport_fee NOT IN (2.5, 1.25, 5)", "airport_fee > 0"),
    on_file("VAL-10", "columns or types differ", "error", "defect",
            "the file's columns and types are not SCHEMA, or not those of the month before"),
    on_trip("VAL-11", "pickup_datetime in the hour left out", "error", "defect",
            "month(pickup_datetime) = 3 AND weekday(pickup_datetime) = 6 "
            "AND day(pickup_datetime) BETWEEN 8 AND 14 AND hour(pickup_datetime) = 2"),
    on_trip("VAL-12", "pickup_datetime in the hour lived twice", "warning", "documentation gap",
            "fall_back AND hour(pickup_datetime) = 1"),
    on_trip("CNS-01", "request_datetime > pickup_datetime", "warning", "business rule", "request_datetime > pickup_datetime"),
    on_trip("CNS-02", "on_scene_datetime < request_datetime", "warning", "business rule", "on_scene_datetime < request_datetime"),
    on_trip("CNS-03", "on_scene_datetime > pickup_datetime", "error", "defect", "on_scene_datetime > pickup_datetime"),
    on_trip("CNS-04", "dropoff_datetime <= pickup_datetime", "error", "defect",
            "dropoff_datetime <= pickup_datetime AND NOT (fall_back AND trip_time - elapsed BETWEEN 3300 AND 3900)"),
    # The plain difference settles nearly every trip; only the rest need time-zone rules.
    on_trip("CNS-05", "trip_time over 300 s off the clock", "warning", "defect",
            "CASE WHEN abs(trip_time - elapsed) <= 300 THEN false ELSE least(abs(trip_time - elapsed_ny), "
            "CASE WHEN fall_back THEN abs(trip_time - elapsed - 3600) ELSE 1e9 END) > 300 END"),
    on_trip("CNS-06", "driver_pay > fare, tips and tolls", "warning", "business rule",
            "driver_pay > base_passenger_fare + tips + tolls"),
    on_trip("CNS-07", "shared_match_flag Y, shared_request_flag N", "warning", "defect",
            "shared_match_flag = 'Y' AND shared_request_flag = 'N'"),
    on_trip("CNS-08", "wav_match_flag Y, wav_request_flag N", "warning", "business rule",
            "wav_match_flag = 'Y' AND wav_request_flag = 'N'"),
    on_trip("CNS-09", "airport_fee > 0, no airport zone", "error", "defect", "airport_fee > 0 AND NOT touches_airport",
            "airport_fee > 0"),
    on_trip("CNS-10", "airport_fee = 0, an airport zone", "warning", "defect", "airport_fee = 0 AND touches_airport",
            "touches_airport"),
    on_trip("CNS-11", "sales_tax = 0 between city zones", "warning", "documentation gap",
            "sales_tax = 0 AND base_passenger_fare > 0 AND PULocationID NOT IN (1, 264, 265) "
            "AND DOLocationID NOT IN (1, 264, 265)"),
    on_trip("CNS-12", "sum of fare and amounts beside it < 0", "error", "defect",
            "base_passenger_fare + tolls + bcf + sales_tax + congestion_surcharge + airport_fee "
            "+ cbd_congestion_fee + tips < 0"),
    on_trip("ACC-01", "a zone is 265", "warning", "business rule", "PULocationID = 265 OR DOLocationID = 265"),
    on_file("ACC-02", "trips against totals", "error", "defect",
            f"trips of a company or of all differ from the published total by over {RECONCILE_TOLERANCE:.1%}"),
    on_file("RSN-01", "trips of a day against its weekday", "warning", "defect",
            f"trips of a day are over {VOLUME_DROP:.0%} under the median of the same weekday, four weeks each way"),
    on_trip("RSN-02", "trip_time < 60", "warning", "documentation gap", "trip_time < 60"),
    on_trip("RSN-03", "over 80 miles an hour", "error", "defect",
            "trip_time > 0 AND try_divide(trip_miles, trip_time) * 3600 > 80"),
    on_trip("RSN-04", "trip_miles > 100 or trip_time > 18000", "warning", "business rule",
            "trip_miles > 100 OR trip_time > 18000"),
    on_trip("RSN-05", "fare a mile < 0.5", "warning", "documentation gap",
            "trip_miles > 1 AND base_passenger_fare > 0 AND try_divide(base_passenger_fare, trip_miles) < 0.5",
            "trip_miles > 1 AND base_passenger_fare > 0"),
    on_trip("RSN-06", "fare a mile > 50", "warning", "business rule",
            "trip_miles > 1 AND base_passenger_fare > 0 AND try_divide(base_passenger_fare, trip_miles) > 50",
            "trip_miles > 1 AND base_passenger_fare > 0"),
    on_trip("RSN-07", "pickup_datetime over 2 h after request_datetime", "warning", "business rule",
            "pickup_datetime > request_datetime + INTERVAL 2 HOUR"),
    on_file("TML-01", "lag of publication", "warning", "documentation gap",
            f"published over {PUBLICATION_LAG_DAYS} days after the last day of the month"),
    on_file("TML-02", "month without totals", "warning", "defect", "no published total of a company for a published month"),
    on_trip("INT-01", "a zone outside the lookup", "error", "defect", "NOT pu_known OR NOT do_known"),
    on_trip("INT-02", "pickup_datetime in another month", "error", "defect", "months_off <> 0"),
    on_file("INT-03", "a licence outside the list", "error", "defect", "hvfhs_license_num not in LICENSES"),
)

# Order in which example records are drawn: a multiplicative hash of five columns that any
# SQL engine with 64-bit integers computes alike. Every step stays below 2^62.
_PRIME = 2147483647
_STEPS = (
    "unix_timestamp(request_datetime)", "unix_timestamp(pickup_datetime)", "PULocationID", "DOLocationID",
    "CAST(round(trip_miles * 100) AS BIGINT)",
)


def sample_order(steps=_STEPS, remainder: str = "pmod({value}, {prime})") -> str:
    text = "CAST(17 AS BIGINT)"
    for step in steps:
        text = remainder.format(value=f"{text} * 48271 + coalesce({step}, 0)", prime=_PRIME)
    return remainder.format(value=f"{text} * 1103515245", prime=_PRIME)


RIDESHARE = RulePack(
    name="rideshare",
    rules=RULES,
    keys=("file_month", "company", "day"),
    dimensions=DIMENSIONS,
    sample_order=sample_order(),
    sample_span=(0, _PRIME - 1),
)
