"""Rules as data.

A rule over single records is a SQL predicate that is true for a failing record, with an
optional second predicate naming the records it applies to (its denominator). A rule over
groups of records is a :class:`SameRecord` or a SQL query over ``{records}``. A rule over
whole files carries neither; the functions in ``operators.files`` and ``operators.volume``
evaluate it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_QUOTED = re.compile(r"'(?:[^']|'')*'")


def columns_of(predicate: str) -> set[str]:
    """The names a predicate holds outside quoted texts."""
    return set(re.findall(r"[A-Za-z_]\w*", _QUOTED.sub("", predicate)))


@dataclass(frozen=True)
class SameRecord:
    """Records agreeing on ``key``; with ``exact``, on those further columns too.

    Missing key values match each other when only the key is compared, and never match
    when whole records are. Records are compared within ``scope``, the whole table by default.
    """

    key: tuple[str, ...]
    exact: tuple[str, ...] = ()
    scope: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    dimension: str
    severity: str
    verdict: str
    test: str = ""
    fails: str | None = None
    applies: str | None = None
    same: SameRecord | None = None
    group_sql: str | None = None
    shows: tuple[str, ...] = ()

    @property
    def grain(self) -> str:
        return "month" if not (self.fails or self.same or self.group_sql) else "trip"


@dataclass(frozen=True)
class RulePack:
    name: str
    rules: tuple[Rule, ...]
    keys: tuple[str, ...]
    dimensions: dict[str, str]
    verdicts: tuple[str, ...] = ("defect", "business rule", "documentation gap")
    severities: tuple[str, ...] = ("error", "warning")
    sample_order: str | None = None
    # The values of sample_order, a hash, are spread evenly from the first to the second of these.
    sample_span: tuple[int, int] | None = None

    def __post_init__(self) -> None:
        problems = list(self._problems())
        if problems:
            raise ValueError(f"rule pack {self.name}: " + "; ".join(problems))

    def _problems(self):
        seen = set()
        for rule in self.rules:
            if rule.id in seen:
                yield f"{rule.id} is defined twice"
            seen.add(rule.id)
            if rule.id.startswith("@"):
                yield f"{rule.id}: ids starting with @ are kept for roll-ups"
            if rule.dimension not in self.dimensions:
                yield f"{rule.id}: unknown dimension {rule.dimension}"
            if rule.severity not in self.severities:
                yield f"{rule.id}: unknown severity {rule.severity}"
            if rule.verdict not in self.verdicts:
                yield f"{rule.id}: unknown verdict {rule.verdict}"
            if sum(x is not None for x in (rule.fails, rule.same, rule.group_sql)) > 1:
                yield f"{rule.id}: more than one of fails, same and group_sql"
            if rule.applies and not rule.fails:
                yield f"{rule.id}: applies without fails"
            for text in (rule.fails, rule.applies):
                # Under ANSI mode a plain division raises on zero, and the optimiser may
                # evaluate it ahead of the condition that guards it.
                if text and "/" in _QUOTED.sub("", text):
                    yield f"{rule.id}: use try_divide, not /"

    @property
    def record_rules(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.fails)

    @property
    def group_rules(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.same or r.group_sql)

    @property
    def file_rules(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.grain == "month")

    @property
    def rollups(self) -> dict[str, list[str]]:
        """Roll-up id → the record rules whose failing records it counts once each."""
        out: dict[str, list[str]] = {}
        for rule in self.record_rules:
            for scope in (rule.dimension, "all"):
                out.setdefault(f"@{scope}/{rule.verdict}", []).append(rule.id)
        return out

    @property
    def shown_columns(self) -> list[str]:
        """The keys and every column an example record shows."""
        return list(dict.fromkeys([*self.keys, *(c for r in self.record_rules for c in r.shows)]))

    def only(self, *ids: str) -> "RulePack":
        """The same pack with fewer rules."""
        missing = set(ids) - {r.id for r in self.rules}
        if missing:
            raise KeyError(f"no such rule: {sorted(missing)}")
        return RulePack(
            self.name, tuple(r for r in self.rules if r.id in ids), self.keys, self.dimensions,
            self.verdicts, self.severities, self.sample_order, self.sample_span,
        )


REGISTRY = T.StructType([
    T.StructField("position", T.IntegerType(), False),
    T.StructField("rule", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("dimension", T.StringType(), False),
    T.StructField("dimension_position", T.IntegerType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("verdict", T.StringType(), False),
    T.StructField("grain", T.StringType(), False),
    T.StructField("test", T.StringType(), False),
    T.StructField("fails_sql", T.StringType(), True),
    T.StructField("applies_sql", T.StringType(), True),
    T.StructField("group_sql", T.StringType(), True),
    T.StructField("shows", T.ArrayType(T.StringType()), False),
])


def registry_frame(spark: SparkSession, pack: RulePack) -> DataFrame:
    """One row per rule, in registry order."""
    dimensions = list(pack.dimensions)
    return spark.createDataFrame(
        [
            (
                position, r.id, r.title, r.dimension, dimensions.index(r.dimension), r.severity, r.verdict, r.grain,
                r.test or r.fails or "", r.fails, r.applies,
                r.group_sql or (f"same {', '.join(r.same.key + r.same.exact)}" if r.same else None), list(r.shows),
            )
            for position, r in enumerate(pack.rules)
        ],
        REGISTRY,
    )
