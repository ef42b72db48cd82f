"""Additive measures at several grains from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """One grain: measures per key combination."""
    return df.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])


def grains(df: DataFrame, sets: dict[str, list[str]], measures: dict[str, Column]) -> DataFrame:
    """Every grain in ``sets``, told apart by the column ``grain``.

    The measures are sums and counts, so the table is first reduced to the finest
    combination of all keys. GROUPING SETS then expands those rows, not the records.
    """
    keys = list(dict.fromkeys(k for grain in sets.values() for k in grain))
    fine = aggregate(df, keys, measures)
    # grouping_id has a bit for each key, the first key highest, set where it is not grouped by.
    ids = {
        name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in grain)
        for name, grain in sets.items()
    }
    label = F.lit(None).cast("string")
    for name, number in ids.items():
        label = F.when(F.grouping_id() == number, name).otherwise(label)
    return fine.groupingSets([[F.col(k) for k in grain] for grain in sets.values()], *[F.col(k) for k in keys]).agg(
        label.alias("grain"), *[F.sum(name).alias(name) for name in measures]
    )


def pick(summary: DataFrame, grain: str, keys: list[str], measures: list[str]) -> DataFrame:
    return summary.where(F.col("grain") == grain).select(*keys, *measures)
