"""Trips made by hand with the rules they must fail, for the plans and for the SQL that checks them."""

import datetime as dt

import duckdb
import pytest

from oracle.base import CTES
from oracle.trips import FAILS
from veritally.packs.rideshare import RIDESHARE, SCHEMA, trip_view


def at(text, day="2026-01-10"):
    return dt.datetime.fromisoformat(f"{day} {text}")


def times(day, request, scene, pickup, dropoff):
    moments = (at(t, day) for t in (request, scene, pickup, dropoff))
    return dict(zip(("request_datetime", "on_scene_datetime", "pickup_datetime", "dropoff_datetime"), moments), file_month=day[:7])


SOUND = {
    "hvfhs_license_num": "HV0003", "dispatching_base_num": "B02764", "originating_base_num": "B02764",
    **times("2026-01-10", "10:00", "10:04", "10:05", "10:25"),
    "PULocationID": 100, "DOLocationID": 100, "trip_miles": 5.0, "trip_time": 1200,
    "base_passenger_fare": 20.0, "tolls": 0.0, "bcf": 0.5, "sales_tax": 1.7, "congestion_surcharge": 2.75,
    "airport_fee": 0.0, "tips": 2.0, "driver_pay": 15.0, "cbd_congestion_fee": 1.5,
    **dict.fromkeys(("shared_request_flag", "shared_match_flag", "access_a_ride_flag", "wav_request_flag", "wav_match_flag"), "N"),
}
ZONES = [1, 100, 132, 264, 265]
SPRING = times("2026-03-08", "02:00", "02:04", "02:05", "02:25")
AUTUMN = times("2026-11-01", "01:00", "01:04", "01:05", "01:25")
# What differs from the sound trip, and the rules it fails.
CASES = [
    ({}, ""),
    ({"originating_base_num": None}, "CMP-01"),
    ({"on_scene_datetime": None}, "CMP-02"),
    ({"tips": None}, "CMP-03"),
    ({"PULocationID": None}, "CMP-03"),
    ({"PULocationID": 264}, "CMP-04"),
    ({"on_scene_datetime": at("10:05")}, "CMP-05"),
    ({"access_a_ride_flag": " "}, "VAL-01"),
    ({"originating_base_num": "B2764"}, "VAL-02"),
    ({"dispatching_base_num": "B02764\n"}, "VAL-02"),
    ({"base_passenger_fare": -1.0, "driver_pay": 0.5}, "VAL-03"),
    ({"base_passenger_fare": 0.0, "driver_pay": 1.0}, "VAL-04"),
    ({"bcf": -0.5}, "VAL-05"),
    ({"driver_pay": 0.0}, "VAL-06"),
    ({"trip_miles": 0.0}, "VAL-07"),
    ({"congestion_surcharge": 1.0}, "VAL-08"),
    ({"airport_fee": 3.5, "PULocationID": 132}, "VAL-09"),
    ({"airport_fee": 2.5, "PULocationID": 132}, ""),
    (SPRING, "VAL-11"),
    ({**SPRING, **times("2026-03-15", "02:00", "02:04", "02:05", "02:25")}, ""),
    (AUTUMN, "VAL-12"),
    ({"request_datetime": at("10:10"), "on_scene_datetime": None}, "CNS-01 CMP-02"),
    ({"on_scene_datetime": at("09:59")}, "CNS-02"),
    ({"on_scene_datetime": at("10:06")}, "CNS-03"),
    ({"dropoff_datetime": at("10:05"), "trip_time": 60, "trip_miles": 1.0}, "CNS-04"),
    # Across the hour that is lived twice the dropoff may show the earlier time.
    (times("2026-11-01", "01:40", "01:45", "01:50", "01:10"), "VAL-12"),
    ({"trip_time": 1600}, "CNS-05"),
    ({"trip_time": 1500}, ""),
    ({"driver_pay": 22.01}, "CNS-06"),
    ({"driver_pay": 22.0}, ""),
    ({"shared_match_flag": "Y"}, "CNS-07"),
    ({"wav_match_flag": "Y"}, "CNS-08"),
    ({"wav_match_flag": "Y", "wav_request_flag": "Y"}, ""),
    ({"airport_fee": 2.5}, "CNS-09"),
    ({"DOLocationID": 132}, "CNS-10"),
    ({"sales_tax": 0.0}, "CNS-11"),
    ({"base_passenger_fare": -30.0, "driver_pay": -40.0}, "CNS-12 VAL-03 VAL-06"),
    ({"sales_tax": 0.0, "DOLocationID": 265}, "ACC-01"),
    ({"dropoff_datetime": at("10:05:59"), "trip_time": 59, "trip_miles": 1.0}, "RSN-02"),
    ({"trip_miles": 26.7}, "RSN-03"),
    ({"trip_miles": 26.6}, ""),
    ({"trip_miles": 5.0, "trip_time": 0, "dropoff_datetime": at("10:05:01")}, "RSN-02"),
    ({"trip_time": 18001, "dropoff_datetime": at("15:05:01")}, "RSN-04"),
    ({"base_passenger_fare": 2.4, "driver_pay": 1.0}, "RSN-05"),
    ({"base_passenger_fare": 2.5, "driver_pay": 1.0}, ""),
    ({"base_passenger_fare": 251.0}, "RSN-06"),
    ({"base_passenger_fare": 250.0}, ""),
    ({"request_datetime": at("08:04:59")}, "RSN-07"),
    ({"request_datetime": at("08:05")}, ""),
    ({"PULocationID": 300}, "INT-01"),
    ({"file_month": "2025-12"}, "INT-02"),
]
NAMES = ["trip", "file_month", *(name for name, _ in SCHEMA)]
TYPES = ["int", "string", *(kind for _, kind in SCHEMA)]
EXPECTED = [set(rules.split()) for _, rules in CASES]


@pytest.fixture(scope="module")
def trips(spark):
    rows = [tuple(({**SOUND, **change, "trip": i})[name] for name in NAMES) for i, (change, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(NAMES, TYPES)))


def test_every_rule_has_a_trip():
    assert set().union(*EXPECTED) == {r.id for r in RIDESHARE.record_rules}


def test_plans(spark, trips):
    zones = spark.createDataFrame([(z,) for z in ZONES], "LocationID int")
    flags = [f"CASE WHEN {r.fails} THEN '{r.id}' END" for r in RIDESHARE.record_rules]
    found = trip_view(trips, zones).selectExpr("trip", f"array_compact(array({', '.join(flags)})) AS rules").collect()
    assert [set(row.rules) for row in sorted(found, key=lambda row: row.trip)] == EXPECTED


def test_sql(trips):
    con = duckdb.connect()
    con.register("x_raw", trips.toArrow())
    con.execute(f"CREATE TABLE x_zones AS SELECT unnest({ZONES}) AS zone_id")
    flags = ", ".join(f"CASE WHEN {test} THEN '{rule}' END" for rule, test in FAILS.items())
    found = con.execute(f"WITH x_trips AS ({CTES['x_trips']}) SELECT [{flags}] FROM x_trips ORDER BY trip").fetchall()
    assert [{rule for rule in rules if rule} for (rules,) in found] == EXPECTED


def test_examples_show_what_the_condition_is_about():
    shows = {r.id: r.shows for r in RIDESHARE.record_rules}
    assert shows["CNS-09"] == ("company", "pickup_datetime", "PULocationID", "DOLocationID", "base_passenger_fare", "airport_fee")
    assert shows["VAL-12"] == ("company", "pickup_datetime", "base_passenger_fare")
    assert "Y" not in shows["CNS-07"] and "shared_match_flag" in shows["CNS-07"]
