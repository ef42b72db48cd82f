"""Rules over groups of records that agree on a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.rules import RulePack
from veritally.session import shared_dir

# Eight bytes each; more are joined through a shuffle of the table.
BROADCAST_HASHES = 1_000_000


def repeated_records(
    df: DataFrame, by: tuple[str, ...], key: tuple[str, ...], exact: tuple[str, ...] = (), scope: tuple[str, ...] = ()
) -> DataFrame:
    """Surplus copies per ``by``: ``same_key`` by the key, ``same_record`` by all columns.

    Records are compared within ``scope``. Of those that agree, the first in the order of ``by`` is
    the record, the others are copies and count where they are. Null key values match each
    other for ``same_key``; a record with one never counts for ``same_record``.

    One eight-byte hash per record crosses the shuffle first; only records whose hash occurs twice
    are grouped by their values, once, and both counts come from those groups. Groupings combine
    on the map side, so a key holding much of the table still reaches its reducer as a few partial counts.

    The hashes are found before the join is planned: in one plan the table would begin to cross the
    network whole while they are still counted. Up to `BROADCAST_HASHES` go to the tasks instead.
    """
    group = list(dict.fromkeys((*scope, *key)))
    apart = [c for c in by if c not in group]
    whole = list(dict.fromkeys((*group, *apart, *exact)))
    rows = df.select(*whole)
    shared_dir(df.sparkSession)
    hashes = rows.select(F.xxhash64(*group).alias("h")).groupBy("h").count().where("count > 1").select("h").checkpoint()
    if hashes.count() <= BROADCAST_HASHES:
        hashes = F.broadcast(hashes)
    rows = rows.join(hashes, F.xxhash64(*group) == F.col("h"), "left_semi")
    equal = rows.groupBy(*whole).agg(F.count(F.lit(1)).alias("copies"))
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])

    def surplus(columns: list[str]) -> DataFrame:
        """Copies per ``columns`` and ``by``, without the first record of each ``columns``."""
        counts = equal.groupBy(*list(dict.fromkeys((*columns, *apart)))).agg(F.sum("copies").alias("copies"))
        if not apart:
            return counts.withColumn("copies", F.col("copies") - 1)
        first = F.row_number().over(Window.partitionBy(*columns).orderBy(*apart)) == 1
        return counts.withColumn("copies", F.col("copies") - F.when(first, 1).otherwise(0))

    keyed = surplus(group).select(*by, F.col("copies").alias("same_key"), F.lit(0).alias("same_record"))
    if not exact:
        return _summed(keyed, by)
    # As a filter, completeness would be pushed to the scan, and the two uses of the groups no longer be one.
    records = surplus([c for c in whole if c not in apart or c in exact])
    counted = F.when(complete, F.col("copies")).otherwise(0).alias("same_record")
    return _summed(keyed.unionByName(records.select(*by, F.lit(0).alias("same_key"), counted)), by)


def _summed(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    sums = rows.groupBy(*by).agg(F.sum("same_key").alias("same_key"), F.sum("same_record").alias("same_record"))
    return sums.where("same_key > 0 OR same_record > 0")


def group_failures(df: DataFrame, pack: RulePack) -> DataFrame:
    """Keys and one column of failures per group rule; keys without a failure have no row."""
    by = pack.keys
    shared: dict[tuple[str, ...], list] = {}
    for rule in pack.group_rules:
        if rule.same:
            shared.setdefault(rule.same.key, []).append(rule)
    frames = []
    for key, rules in shared.items():
        exact = tuple(dict.fromkeys(c for r in rules for c in r.same.exact))
        if len({r.same.scope for r in rules}) > 1:
            raise ValueError(f"rules on one key compare within different scopes: {[r.id for r in rules]}")
        if len({r.same.exact for r in rules if r.same.exact}) > 1:
            raise ValueError(f"rules on one key compare different columns: {[r.id for r in rules]}")
        counts = repeated_records(df, by, key, exact, rules[0].same.scope)
        frames.append(counts.select(
            *by, *[F.col("same_record" if r.same.exact else "same_key").alias(r.id) for r in rules]
        ))
    for rule in pack.group_rules:
        if rule.group_sql:
            found = df.sparkSession.sql(rule.group_sql, records=df)
            frames.append(found.groupBy(*by).agg(F.sum("failed").alias(rule.id)))
    return reduce(lambda a, b: a.join(b, list(by), "full"), frames)
