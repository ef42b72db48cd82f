"""Places of rows in a sorted order, by group, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm.components import kept

#: Rows of the table of starts (one for each partition and group) up to which it is broadcast.
MOST_STARTS = 100_000


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with `place`, from 0 within the group in the given order, and `total`, the group's rows.

    Rows are dealt out by ranges of group and order and kept; a row's place is its place in its
    partition plus what earlier partitions hold of the group. Rows equal in the order follow each other
    as they come and may lie in several partitions, so no key is too hot. Groups must not be null.
    """
    keys = [F.col(group), *order, F.col("_come")]
    come = rows.withColumn("_come", F.monotonically_increasing_id())
    dealt = kept(come.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    # The number's upper bits are the partition's.
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = kept(counts.select(group, "_part", "_low", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total")))
    starts = F.broadcast(starts) if starts.count() <= MOST_STARTS else starts
    placed = dealt.join(starts, [group, "_part"]).withColumn("place", F.col("_at") - F.col("_low") + F.col("_before"))
    return placed.drop("_come", "_at", "_part", "_low", "_before")
