"""Checks against reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_known(df: DataFrame, flags: dict[str, str], reference: DataFrame, key: str, dimension: bool = False) -> DataFrame:
    """For each column → flag: true where the column is a key of the reference, null where null.

    A reference declared as a dimension, of some hundred keys, is broadcast whatever its estimate says. How to join
    any other is left to adaptive execution, which knows its size and splits a frequent key.
    """
    keys = reference.select(F.col(key).alias("known_key")).where("known_key IS NOT NULL").distinct()
    keys = F.broadcast(keys) if dimension else keys
    for column, flag in flags.items():
        found = df.join(keys, F.col(column) == F.col("known_key"), "left")
        df = found.withColumn(flag, F.when(F.col(column).isNotNull(), F.col("known_key").isNotNull())).drop("known_key")
    return df
