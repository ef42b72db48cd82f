"""A few failing records per rule, the same ones on every run."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.rules import RulePack
from veritally.session import shared_dir

_ORDER = "sample_order"
# One in so many records by their order is looked at first; groups up to so many go to every task.
EARLY, MOST_GROUPS = 16, 10_000


def _order(pack: RulePack) -> Column:
    return (F.expr(pack.sample_order) if pack.sample_order else F.xxhash64(*pack.shown_columns)).cast("bigint")


def _early(pack: RulePack) -> Column | None:
    """Whether a record is among the first in the order, where the span of the order is known."""
    low, high = (-(2**63), 2**63 - 1) if pack.sample_order is None else pack.sample_span or (None, None)
    if low is None:
        return None
    return F.coalesce(_order(pack) <= F.lit(low + (high - low) // EARLY), F.lit(True))


def _first(df: DataFrame, pack: RulePack, n: int, by: tuple[str, ...], done: bool = False) -> DataFrame:
    """The n first failing records per group and rule, of the rules that are not done in their group."""
    failed = []
    for i, r in enumerate(pack.record_rules):
        fails = F.expr(r.fails)
        failed.append(F.when(~F.coalesce(F.col("_done")[i], F.lit(False)) & fails if done else fails, F.lit(r.id)))
    flagged = df.select(*pack.shown_columns, _order(pack).alias(_ORDER), F.array_compact(F.array(*failed)).alias("failed"))
    hits = flagged.select(*pack.shown_columns, _ORDER, F.explode("failed").alias("rule"))
    ties = [F.col(c).asc_nulls_first() for c in pack.shown_columns if c not in by]
    window = Window.partitionBy(*by, "rule").orderBy(_ORDER, *ties)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def example_records(df: DataFrame, pack: RulePack, n: int = 3, by: tuple[str, ...] = ("file_month",)) -> DataFrame:
    """Up to n failing records per group and record rule: rule, rank and the columns examples show.

    Records early in the order are looked at first. A rule that n of them fail in a group is done there, as no later
    record comes before them; then one scan of all records evaluates the rules that are not. Each task keeps the n first
    of its records per group and rule before anything is shuffled, so n records per task, group and rule are all that
    meet, however many fail. Ordering by every shown column after the hash leaves ties only between equal examples.
    """
    early, rules = _early(pack), [r.id for r in pack.record_rules]
    if early is None or not rules:
        return _first(df, pack, n, by)
    shared_dir(df.sparkSession)
    same = Window.partitionBy(*by, "rule")
    found = _first(df.where(early), pack, n, by).withColumn("all", F.max("rank").over(same))
    found = found.where(F.col("all") == n).drop("all").checkpoint()
    keys = [F.col(k).alias(f"_by_{k}") for k in by]
    # One array a group: with a column a rule, planning would take longer than the scan.
    done = found.groupBy(*keys).agg(F.array(*[F.max(F.col("rule") == rule) for rule in rules]).alias("_done")).checkpoint()
    groups = done.count()
    if not groups:
        return _first(df, pack, n, by)
    done = F.broadcast(done) if groups <= MOST_GROUPS else done
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by])
    rows = df.join(done, on, "left").where(~F.coalesce(F.forall("_done", lambda d: d), F.lit(False)))
    return found.unionByName(_first(rows, pack, n, by, done=True))


def as_json(records: DataFrame, pack: RulePack, by: tuple[str, ...] = ("file_month",)) -> DataFrame:
    """Each example as JSON of the columns its rule shows."""
    options = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "ignoreNullFields": "false"}
    record = F.lit(None)
    for rule in pack.record_rules:
        shown = F.to_json(F.struct(*(rule.shows or pack.keys)), options)
        record = F.when(F.col("rule") == rule.id, shown).otherwise(record)
    return records.select(*by, "rule", "rank", *[k for k in pack.keys if k not in by], record.alias("record"))
