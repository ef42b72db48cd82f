"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

A row's number is its file's offset plus its place in the file, so numbering needs no sort and
no shuffle and does not depend on how the files are split into tasks. The permutation is a
Feistel network over the smallest square of a power of two that holds all numbers; results
beyond the last row are permuted again (cycle walking), which keeps it a bijection. Shard and
slot of a row follow from its permuted number alone: the remainder and the quotient by the
number of shards. Shard counts differ by one at most, slots have no gaps.

Null texts count as empty, texts of any length by their bytes; null ids change nothing. Equal
rows are different rows and get different slots, so ties do not arise. Where there are no rows
there is nothing to number. `row`, `shard` and `slot` replace columns of these names, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAW = "rows"
ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0 .. size - 1 that the seed decides."""

    size: int
    seed: int = 2024

    @property
    def half(self) -> int:
        """Bits of each half."""
        return max(1, (max(1, self.size - 1).bit_length() + 1) // 2)

    def _round(self, values: np.ndarray, turn: int) -> np.ndarray:
        """A well mixed function of one half, the round and the seed."""
        key = (self.seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & (1 << 64) - 1
        x = values + np.uint64(key)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) & np.uint64((1 << self.half) - 1)

    def _once(self, values: np.ndarray, back: bool) -> np.ndarray:
        bits = np.uint64(self.half)
        left, right = values >> bits, values & np.uint64((1 << self.half) - 1)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(left, turn), left
            else:
                left, right = right, left ^ self._round(right, turn)
        return left << bits | right

    def apply(self, numbers: np.ndarray, back: bool = False) -> np.ndarray:
        """The permuted numbers, or with `back` the numbers that lead to these."""
        values = np.asarray(numbers).astype(np.uint64)
        out = self._once(values, back)
        while len(beyond := np.flatnonzero(out >= self.size)):
            out[beyond] = self._once(out[beyond], back)
        return out.astype(np.int64)


def unused(rows: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of rows has it."""
    taken = {column.lower() for column in rows.columns}
    while name in taken:
        name = "_" + name
    return name


def quoted(names) -> list[str]:
    return ["`" + name.replace("`", "``") + "`" for name in names]


def numbered(spark: SparkSession, path: str, column: str = "row") -> DataFrame:
    """The rows of parquet files with their global numbers, by file name and place in the file.

    The number of rows of each file is counted first; that table has one row per file. The numbers
    take the place of a column of their name; all other columns stay, whatever their names.
    """
    rows = spark.read.parquet(path)
    names = [name for name in rows.columns if name.lower() != column.lower()]
    file, at, offset = (unused(rows, name) for name in ("_file", "_at", "_offset"))
    place = rows.metadataColumn("_metadata")
    rows = rows.select(*quoted(names), place["file_path"].alias(file), place["row_index"].alias(at))
    counts = sorted((row[0], row[1]) for row in rows.groupBy(file).agg(F.count("*")).collect())
    offsets = np.cumsum([0, *(n for _, n in counts)]).tolist()
    table = spark.createDataFrame([(name, start) for (name, _), start in zip(counts, offsets)], f"{file} string, {offset} bigint")
    return rows.join(F.broadcast(table), file).select(*quoted(names), (F.col(offset) + F.col(at)).alias(column))


def total(rows: DataFrame, column: str = "row") -> int:
    """The number of numbered rows."""
    return rows.select(F.coalesce(F.max(column) + 1, F.lit(0))).first()[0]


def assign(rows: DataFrame, n: int, shards: int, column: str = "row", seed: int = 2024) -> DataFrame:
    """rows with shard and slot, from each row's number alone; n is the number of rows.

    They take the place of columns of their names.
    """
    to = unused(rows, "_to")
    permutation = Permutation(n, seed)

    @F.pandas_udf("bigint")
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(permutation.apply(numbers.to_numpy()))

    return (
        rows.withColumn(to, permuted(F.col(column)))
        .withColumns({"shard": (F.col(to) % shards).cast("int"), "slot": F.expr(f"{to} div {shards}")})
        .drop(to)
    )


def row_of(shard: int, slot: int, n: int, shards: int, seed: int = 2024) -> int:
    """The number of the row in a slot of a shard, without looking at any row."""
    return int(Permutation(n, seed).apply(np.array([slot * shards + shard]), back=True)[0])


def described(rows: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, which only a law by key has."""
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return rows.select(
        "doc_id",
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("bigint").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
