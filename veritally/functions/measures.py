"""Ratios and comparisons over summed measures. A ratio without a denominator is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = (
    "trips", "fares", "driver_pay", "tips", "rider_total", "miles", "trip_seconds", "wait_seconds", "wait_trips",
    "airport_trips", "shared_trips", "wav_trips",
)
COUNTS = ("trips", "wait_trips", "airport_trips", "shared_trips", "wav_trips")


def totals(*names: str) -> list[Column]:
    """Sums of the named measures (all by default), zero where there is nothing to add.

    Summed as decimals: every measure is whole in hundredths, so no order of addition matters.
    """
    return [
        F.coalesce(F.sum(n) if n in COUNTS else F.sum(F.col(n).cast("decimal(20,2)")).cast("double"), F.lit(0)).alias(n)
        for n in (names or MEASURES)
    ]


def ratio(over: str | Column, under: str | Column) -> Column:
    return F.try_divide(
        F.col(over) if isinstance(over, str) else over, F.col(under) if isinstance(under, str) else under
    )


def metrics() -> dict[str, Column]:
    """The ratios reported from summed measures."""
    return {
        "platform_share": 1 - ratio("driver_pay", "fares"),
        "avg_fare": ratio("fares", "trips"),
        "avg_wait": ratio("wait_seconds", "wait_trips"),
        "avg_miles": ratio("miles", "trips"),
        "avg_minutes": ratio("trip_seconds", "trips") / 60,
        "tip_rate": ratio("tips", "fares"),
        "airport_share": ratio("airport_trips", "trips"),
    }


def change(value: Column, prior: Column, kind: str = "ratio") -> Column:
    """Movement against the period before: a ratio, or a difference of shares ("points")."""
    moved = value - prior if kind == "points" else F.try_divide(value, prior) - 1
    return F.when(prior.isNotNull() & (prior != 0), moved)


def tone(moved: Column, better: str | None) -> Column:
    """good or bad by the direction that is better; null where too small to tell or neither is."""
    if better is None:
        return F.lit(None).cast("string")
    good = moved > 0 if better == "up" else moved < 0
    return F.when(F.abs(moved) >= 0.0005, F.when(good, "good").otherwise("bad"))
