"""Evaluation of a rule pack over a table, in one pass."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.operators.duplicates import group_failures
from veritally.rules import RulePack

RECORDS = "records"


def _denominators(pack: RulePack) -> dict[str, str]:
    """Each distinct ``applies`` text → the column holding it; rules often share one."""
    texts = dict.fromkeys(r.applies for r in pack.record_rules if r.applies)
    return {text: f"applies_{i}" for i, text in enumerate(texts)}


def _true(predicate: str) -> Column:
    return F.coalesce(F.expr(predicate), F.lit(False))


def record_flags(df: DataFrame, pack: RulePack) -> DataFrame:
    """Keys, then one boolean per record rule and one per distinct denominator.

    A predicate that is null marks no failure. Every predicate is written out once here, so
    the aggregates above count finished booleans instead of evaluating it again.
    """
    return df.select(
        *pack.keys,
        *[_true(r.fails).alias(r.id) for r in pack.record_rules],
        *[_true(text).alias(name) for text, name in _denominators(pack).items()],
    )


def check_frame(df: DataFrame, pack: RulePack) -> DataFrame:
    """One row per key combination: records, failures per rule and roll-up, denominators."""
    measures = [F.count(F.lit(1)).alias(RECORDS)]
    measures += [F.count_if(F.col(f"`{r.id}`")).alias(r.id) for r in pack.record_rules]
    measures += [F.count_if(F.col(name)).alias(name) for name in _denominators(pack).values()]
    measures += [
        F.count_if(reduce(or_, [F.col(f"`{i}`") for i in ids])).alias(rollup) for rollup, ids in pack.rollups.items()
    ]
    return record_flags(df, pack).groupBy(*pack.keys).agg(*measures)


def long_results(frame: DataFrame, pack: RulePack, rollups: bool = True, groups: bool = False) -> DataFrame:
    """The frame's rules and roll-ups as rows: keys, rule, failed, checked."""
    names = _denominators(pack)
    rows = [(r.id, F.col(f"`{r.id}`"), F.col(names[r.applies] if r.applies else RECORDS)) for r in pack.record_rules]
    if rollups and pack.record_rules:
        rows += [(rollup, F.col(f"`{rollup}`"), F.col(RECORDS)) for rollup in pack.rollups]
    if groups:
        rows += [(r.id, F.coalesce(F.col(f"`{r.id}`"), F.lit(0)), F.col(RECORDS)) for r in pack.group_rules]
    packed = F.array(*[F.struct(F.lit(i).alias("rule"), f.alias("failed"), c.alias("checked")) for i, f, c in rows])
    return frame.select(*pack.keys, F.inline(packed))


def check(df: DataFrame, pack: RulePack, records: DataFrame | None = None) -> DataFrame:
    """Every rule and roll-up of the pack: keys, rule, failed, checked.

    The frame is built once; failures of the group rules, with zeros, are joined to it by its few key combinations.
    records: the same records, for the group rules, where they can be had with fewer joins than ``df``.
    """
    frame = check_frame(df, pack)
    if pack.group_rules:
        counts = group_failures(df if records is None else records, pack)
        same = reduce(and_, [F.col(f"frame.{k}").eqNullSafe(F.col(f"counts.{k}")) for k in pack.keys])
        joined = frame.alias("frame").join(counts.alias("counts"), same, "left")
        frame = joined.select("frame.*", *[F.col(f"counts.`{r.id}`") for r in pack.group_rules])
    return long_results(frame, pack, groups=bool(pack.group_rules))


def rule_result(df: DataFrame, pack: RulePack, rule_id: str) -> DataFrame:
    """One rule on its own: keys, failed, checked."""
    return check(df, pack.only(rule_id)).where(F.col("rule") == rule_id).drop("rule")


def failed_totals(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Failures per rule over all keys, roll-ups left out."""
    return (
        results.where(~F.col("rule").startswith("@"))
        .groupBy(*by, "rule")
        .agg(F.sum("failed").alias("failed"))
    )
