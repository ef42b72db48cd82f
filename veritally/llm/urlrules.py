"""URL rules found by the rarest literal token of their pattern.

Every rule has a regular expression over `host/path` and literal tokens that each URL it fits
must contain. Tokens are counted over all URLs; a rule is filed under its rarest token. A URL's
distinct tokens fetch the rules filed under them, and only these run their expressions.

Counting sums by token in each task first, and keeps only tokens that some rule has, so a host
that many rows share does no harm. Up to `PLANNED_RULES` rules the index is part of the plan;
judging a URL needs its row alone and no shuffle. More rules are a table, joined to the tokens of
the distinct URLs by the rarest token; both ways give the same rows.

Null URLs and URLs without `://` have an empty host and path and fit no rule. Equal rows all stay and get
the same verdict; of rules that tie the first counts. Empty tables give empty ones. `host`, `path`, `rule` and
`verdict` take the place of columns of their names; others stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm.sharding import quoted, unused

#: Rules that travel in the plan; more of them are joined as a table.
PLANNED_RULES = 1_000
TABLE = "turn bigint, verdict string, host string, path string, name string, expression string, tokens array<string>"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """verdict, host (with all its subdomains) and the start of the path; or a pattern of its own.

    `name` is what results call a listed rule. A rule without a name gives the verdict only where no named one fits.
    """

    verdict: str
    host: str = ""
    path: str = ""
    name: str | None = None
    pattern: str | None = None
    literals: tuple[str, ...] = ()

    @property
    def expression(self) -> str:
        return self.pattern or rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> tuple[str, ...]:
        """Tokens that stand whole in every URL the rule fits: not the path's last, which may go on."""
        if self.pattern:
            return self.literals
        inner = re.findall(rf"{TOKEN}(?=[^a-z0-9])", self.path)
        return tuple(dict.fromkeys([*re.findall(TOKEN, self.host), *inner]))


#: Listed rules: fixed values.
LISTED = (
    Rule("allow", "com", "/", "com/"),
    Rule("block", "example.com", "/en/", "example.com/en/"),
    Rule("allow", "www.example.com", "/en/", "www.example.com/en/"),
    Rule("block", "net", "/es/", "net/es/"),
    Rule("block", "net", "/fr/", "net/fr/"),
)
#: Of the method itself: words in a host that sell rather than tell.
GENERAL = tuple(
    Rule("block", pattern=rf"^(?:[^/]*[.-])?{word}[.-]", literals=(word,))
    for word in ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "viagra")
)
DEFAULT = "allow"
SCHEME_END = "://"


def split(url):
    """host and path of a URL column; A-Z of the host lower-cased, both empty for null and without `://`."""
    rest = F.coalesce(F.substring_index(url, SCHEME_END, 1), F.lit(""))
    known = F.coalesce(F.instr(url, SCHEME_END) > 0, F.lit(False))
    rest = F.when(known, F.substr(url, F.length(rest) + len(SCHEME_END) + 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rarest(tokens: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """Token and the rules filed under it; tokens has one row per URL with its distinct `tokens`."""
    wanted = sorted({token for rule in rules for token in rule.tokens})
    if not wanted:
        return {}
    met = tokens.select(F.explode("tokens").alias("token")).filter(F.col("token").isin(wanted))
    counts = dict(met.groupBy("token").count().collect())
    filed: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        if not rule.tokens:
            raise ValueError(f"no literal token in {rule}")
        filed.setdefault(min(rule.tokens, key=lambda token: (counts.get(token, 0), token)), []).append(number)
    return filed


def judge(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + GENERAL, url: str = "url") -> DataFrame:
    """pages with host, path, rule (name of the longest named rule that fits) and verdict.

    Without a named rule the verdict is block where any rule that blocks fits, else the default.
    """
    if len(rules) > PLANNED_RULES:
        return judge_by_table(pages, table(pages.sparkSession, rules), url)
    parted = _parted(pages, url)
    filed = rarest(parted.select(_tokens().alias("tokens")), rules)
    index = F.create_map(*[part for token, numbers in filed.items() for part in (F.lit(token), F.array(*[_entry(n, rules[n]) for n in numbers]))])
    fetched = F.flatten(F.transform(F.array_intersect(_tokens(), F.array(*map(F.lit, filed))), lambda token: index[token]))
    fits = F.filter(fetched, lambda rule: F.rlike(F.concat("host", "path"), rule["expression"]))
    best = unused(pages, "_best")
    return _judged(pages, parted.withColumn(best, F.array_max(F.transform(fits, lambda rule: rule.dropFields("expression")))), best)


def table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules as rows; `turn` is their order. A longer list can be read from files with these columns."""
    rows = [(n, r.verdict, r.host, r.path, r.name, r.expression, list(r.tokens)) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, TABLE)


def judge_by_table(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """What `judge` returns, for any number of rules as a table of `TABLE`'s columns.

    Only distinct URLs meet rules, so a URL that many rows share is judged once. A rule without a token is an error.
    """
    parted = _parted(pages, url)
    urls = parted.select("host", "path").distinct().withColumn("token", F.explode(_tokens()))
    counts = urls.groupBy("token").agg(F.count("*").alias("n"))
    none = F.raise_error(F.concat(F.lit("no literal token in "), "expression")).cast("array<string>")
    ruled = rules.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(none)))
    length = F.length(F.coalesce("host", F.lit(""))) + F.length(F.coalesce("path", F.lit("")))
    order = F.struct(
        F.col("name").isNotNull().alias("named"), length.alias("length"), (F.col("verdict") == "block").alias("blocks"),
        (-F.col("turn")).alias("turn"), "name", "verdict",
    )
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)), F.col("token")))["token"]
    filed = ruled.join(counts, "token", "left").groupBy("expression", order.alias("order")).agg(rare.alias("token"))
    best = unused(pages, "_best")
    fits = urls.join(filed, "token").filter(F.rlike(F.concat("host", "path"), F.col("expression")))
    return _judged(pages, parted.join(fits.groupBy("host", "path").agg(F.max("order").alias(best)), ["host", "path"], "left"), best)


def _parted(pages: DataFrame, url: str) -> DataFrame:
    host, path = split(F.col(url))
    return pages.drop("rule", "verdict").withColumns({"host": host, "path": path})


def _tokens():
    """Distinct tokens of host and path."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", F.lit("/"), "path")), F.lit(f"({TOKEN})"), F.lit(1)))


def _judged(pages: DataFrame, found: DataFrame, best: str) -> DataFrame:
    """The columns of pages, and what the struct `best` says; null says the default."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return found.select(
        *quoted(kept), "host", "path", F.col(best)["name"].alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit(DEFAULT)).alias("verdict")
    )


def _entry(number: int, rule: Rule):
    """A rule as a value whose order is precedence: named, longest, blocking, first."""
    return F.struct(
        F.lit(rule.name is not None).alias("named"),
        F.lit(len(rule.host) + len(rule.path)).alias("length"),
        F.lit(rule.verdict == "block").alias("blocks"),
        F.lit(-number).alias("turn"),
        F.lit(rule.name).cast("string").alias("name"),
        F.lit(rule.verdict).alias("verdict"),
        F.lit(rule.expression).alias("expression"),
    )
