"""Daily volume against the same weekday nearby."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.operators import files

WEEKS = 4


def daily_totals(daily: DataFrame) -> DataFrame:
    """Trips per day, month and company from the daily summary."""
    return daily.groupBy(F.col("day").cast("date").alias("day"), "month", "company").agg(F.sum("trips").alias("trips"))


def volume_series(totals: DataFrame, causes: DataFrame, drop: float) -> DataFrame:
    """Each day with its expected volume: the median of its weekday within four weeks.

    totals (day, month, company, trips); causes (day, cause). Same weekday within 28 days
    means 7, 14, 21 or 28 days off, so the range join is an equi-join on eight shifted dates.
    """
    offsets = [7 * w for w in range(-WEEKS, WEEKS + 1) if w]
    shifted = totals.select(
        "company", F.col("trips").alias("near"),
        F.explode(F.array(*[F.date_add("day", n) for n in offsets])).alias("day"),
    )
    expected = totals.join(shifted, ["company", "day"], "left").groupBy("day", "month", "company", "trips").agg(
        F.median("near").alias("expected")
    )
    deviation = F.try_divide(F.col("trips"), F.col("expected")) - 1
    low = deviation < -drop
    return (
        expected.withColumn("deviation", deviation)
        .join(causes.withColumn("day", F.col("day").cast("date")), "day", "left")
        .select(
            F.col("day").cast("string").alias("day"), "month", "company", "trips",
            F.when(F.col("expected") != 0, F.bround("expected", 0).cast("bigint")).alias("expected"),
            F.round("deviation", 4).alias("deviation"),
            F.when(low, F.when(F.col("cause").isNotNull(), "explained").otherwise("unexplained")).alias("flag"),
            F.when(low, F.col("cause")).alias("cause"),
        )
    )


def volume_rule(series: DataFrame, months: DataFrame, companies: list[str], rule: str = "RSN-01") -> DataFrame:
    """Per month and company: fails on a low day without a known cause; value counts those."""
    text = F.concat(
        F.col("day"), F.lit(" "), F.round(F.col("deviation") * 100, 0).cast("bigint").cast("string"), F.lit("%"),
        F.coalesce(F.concat(F.lit(" ("), F.col("cause"), F.lit(")")), F.lit("")),
    )
    low = series.where(F.col("flag").isNotNull()).groupBy("month", "company").agg(
        F.count_if(F.col("flag") == "unexplained").alias("unexplained"),
        F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("days"),
    )
    judged = files.grid(months, companies).join(low, ["month", "company"], "left")
    count = F.coalesce("unexplained", F.lit(0))
    return files.verdicts(
        judged, rule, F.col("company"), F.when(count > 0, "fail").otherwise("pass"), count,
        F.coalesce(F.concat("days", F.lit(".")), F.lit("No day is far below its expected volume.")),
    )
