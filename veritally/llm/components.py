"""Connected components of members that share something, and tables cut off from their history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.session import shared_dir


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the checkpoint folder all executors share; it outlives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a small column or two that one task may hold.
TASK_ROWS = 200_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that so many narrow rows are worth: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def connected(members: np.ndarray, vias: np.ndarray) -> np.ndarray:
    """By member number, the smallest member connected with it; members of one via are connected."""
    label = np.arange(int(members.max(initial=-1)) + 1)
    while True:
        low = np.full(int(vias.max(initial=-1)) + 1, len(label))
        np.minimum.at(low, vias, label[members])
        new = label.copy()
        np.minimum.at(new, members, low[vias])
        np.minimum.at(new, label, new.copy())  # what a member learned, its root knows too
        while ((ahead := new[new]) != new).any():
            new = ahead
        if (new == label).all():
            return label
        label = new


def _numbers(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of values in their order, and the distinct values, ascending."""
    distinct = pc.unique(values)
    distinct = distinct.take(pc.sort_indices(distinct))
    return pc.index_in(values, value_set=distinct).to_numpy().astype(np.int64), distinct


def contracted(pairs: DataFrame) -> DataFrame:
    """Stars of each task's pairs: root, the smallest member connected with it in the task, for each member and each via.

    However many pairs of a task have it, a member or via leaves the task once for `TASK_ROWS` pairs.
    """
    kinds = dict(pairs.dtypes)

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        (members, names), (vias, through) = _numbers(rows.column("member")), _numbers(rows.column("via"))
        label = connected(members, vias)
        low = np.zeros(len(through), np.int64)
        low[vias] = label[members]
        columns = [
            names.take(pa.array(np.concatenate([label, low]))),
            pa.concat_arrays([names, pa.nulls(len(through), names.type)]),
            pa.concat_arrays([pa.nulls(len(names), through.type), through]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["root", "member", "via"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TASK_ROWS:
                yield stars(held)
                held.clear()
        if held:
            yield stars(held)

    return pairs.select("member", "via").mapInArrow(run, f"root {kinds['member']}, member {kinds['member']}, via {kinds['via']}")


def components(pairs: DataFrame) -> DataFrame:
    """member and root, the smallest member of its component, for pairs of member and via.

    Members of one `via` are connected. Tasks connect what they hold first, as many as the rows are worth; the roots of different
    tasks that meet in a member or via are connected next: by one task if they are no more than it may hold, else in rounds.
    """
    rows = kept(pairs.select("member", "via"))
    tasks = tasks_for(rows.sparkSession, rows.count())
    stars = kept(contracted(rows.coalesce(tasks)))
    met = stars.groupBy("member", "via").agg(F.collect_set("root").alias("roots")).coalesce(tasks).filter(F.size("roots") > 1)
    links = kept(met.select(F.explode("roots").alias("member"), F.array_min("roots").alias("via")).distinct().coalesce(tasks))
    own = stars.filter(F.col("member").isNotNull()).select("member", "root")
    if not (n := links.count()):
        return own.distinct()
    found = contracted(links.coalesce(1)).filter(F.col("member").isNotNull()) if n <= TASK_ROWS else _spread(links)
    found = found.select(F.col("member").alias("root"), F.col("root").alias("low"))
    return kept(own.join(found, "root", "left").select("member", F.coalesce("low", "root").alias("root")).coalesce(tasks).distinct())


def _spread(pairs: DataFrame) -> DataFrame:
    """member and root, the smallest member of its component, in rounds.

    Each round passes the smallest root through every `via`;
    from the fourth on, roots of roots are followed too, so that long chains shorten. Every step
    sums in each task first; one table is written in a round. As many tasks as the rows are worth
    read and write it: each writes a shuffle file for every step, and small tables take many steps.
    """
    rows = pairs.select("member", "via", F.col("member").alias("root"))
    tasks = tasks_for(rows.sparkSession, rows.count())
    rows = rows.coalesce(tasks)
    turn = 0
    while True:
        turn += 1
        low = rows.groupBy("via").agg(F.min("root").alias("low"))
        near = rows.join(low, "via").coalesce(tasks).groupBy("member").agg(F.min("low").alias("new"))
        if turn > 3:
            ahead = rows.select(F.col("member").alias("new"), F.col("root").alias("next")).distinct()
            near = near.coalesce(tasks).join(ahead.coalesce(tasks), "new").coalesce(tasks).select("member", F.least("new", "next").alias("new"))
        rows = kept(rows.join(near, "member").coalesce(tasks))
        # A round that changes nothing is the last.
        if rows.filter("new <> root").isEmpty():
            return rows.select("member", "root").distinct()
        rows = rows.select("member", "via", F.col("new").alias("root"))
