"""Rules over a month's file as a whole.

Every function returns rows of (rule, month, company, status, value, detail); status is
pass, fail or pending. Inputs are small: a row per month, or per month and company.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOTH = "Both"
COLUMNS = ("rule", "month", "company", "status", "value", "detail")


def verdicts(df: DataFrame, rule: str, company, status: Column, value: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), "month", (F.lit(company) if isinstance(company, str) else company).alias("company"),
        status.alias("status"), value.cast("double").alias("value"), detail.alias("detail"),
    )


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def grid(months: DataFrame, companies: list[str]) -> DataFrame:
    """Every month with every company, so that what is missing shows as a row."""
    return months.select("month").distinct().withColumn(
        "company", F.explode(F.array(*[F.lit(c) for c in companies]))
    )


def compare_totals(ours: DataFrame, rule: str, tolerance: float) -> DataFrame:
    """Rows of (month, company, ours, theirs) judged against the tolerance."""
    diff = F.col("ours") - F.col("theirs")
    detail = F.concat(
        F.lit("Landed "), F.format_number("ours", 0), F.lit(", published "), F.format_number("theirs", 0), F.lit(": "),
        F.when(diff == 0, "equal").otherwise(
            F.concat(F.format_number(F.abs(diff), 0), F.when(diff > 0, " more").otherwise(" fewer"))
        ), F.lit("."),
    )
    status = (
        F.when(F.col("theirs").isNull(), "pending")
        .when(F.abs(diff) > F.col("theirs") * F.lit(tolerance), "fail").otherwise("pass")
    )
    return verdicts(
        ours, rule, F.col("company"), status, F.try_divide(diff, F.col("theirs")),
        F.coalesce(detail, F.lit("No published total for this month yet.")),
    )


def reconcile(
    ours: DataFrame, by_company: DataFrame, overall: DataFrame, months: DataFrame, companies: list[str],
    tolerance: float, rule: str = "ACC-02",
) -> DataFrame:
    """Counts per month and company against published ones, and all together.

    ours (month, company, trips); by_company (month, company, total); overall (month, total).
    """
    counted = grid(months, companies).join(ours, ["month", "company"], "left").select(
        "month", "company", F.coalesce("trips", F.lit(0)).cast("bigint").alias("ours")
    )
    each = counted.join(by_company.withColumnRenamed("total", "theirs"), ["month", "company"], "left")
    together = (
        counted.groupBy("month").agg(F.sum("ours").alias("ours")).withColumn("company", F.lit(BOTH))
        .join(overall.withColumnRenamed("total", "theirs"), "month", "left")
    )
    return union(compare_totals(each, rule, tolerance), compare_totals(together, rule, tolerance))


def totals_present(
    by_company: DataFrame, months: DataFrame, companies: list[str], rule: str = "TML-02"
) -> DataFrame:
    """Whether the published totals hold every company for the month."""
    found = (
        grid(months, companies)
        .join(by_company.select("month", "company", F.lit(1).alias("there")), ["month", "company"], "left")
        .groupBy("month").agg(F.count("there").alias("n"))
    )
    present = F.col("n") >= len(companies)
    return verdicts(
        found, rule, BOTH, F.when(present, "pass").otherwise("fail"), F.lit(None),
        F.when(present, "The published totals cover this month.")
        .otherwise("The published totals do not cover this month yet."),
    )


def published_late(facts: DataFrame, max_days: int, rule: str = "TML-01") -> DataFrame:
    """facts (month, published, lag_days)."""
    lag = F.col("lag_days")
    return verdicts(
        facts, rule, BOTH,
        F.when(lag.isNull(), "pending").when(lag > max_days, "fail").otherwise("pass"), lag,
        F.when(lag.isNull(), "No publication date is recorded.").otherwise(
            F.concat(F.lit("Published "), F.col("published").cast("string"), F.lit(", "), lag.cast("string"),
                     F.lit(" days after the month."))
        ),
    )


def undocumented_codes(
    counts: DataFrame, code: str, documented: DataFrame, months: DataFrame, rule: str = "INT-03"
) -> DataFrame:
    """counts (month, code, rows) against documented (code)."""
    unknown = (
        counts.join(documented, code, "left_anti").withColumn(code, F.coalesce(F.nullif(F.col(code), F.lit("")), F.lit("(no code)"))).groupBy("month")
        .agg(F.sum("rows").alias("rows"), F.array_join(F.array_sort(F.collect_set(code)), ", ").alias("codes"))
    )
    judged = months.select("month").distinct().join(unknown, "month", "left")
    found = F.col("rows").isNotNull()
    return verdicts(
        judged, rule, BOTH, F.when(found, "fail").otherwise("pass"), F.coalesce("rows", F.lit(0)),
        F.when(found, F.concat(F.lit("Not documented: "), F.col("codes"), F.lit(".")))
        .otherwise("Every code is documented."),
    )


def differences(schema: Column, expected: list[tuple[str, str]]) -> Column:
    """How a list of columns departs from the expected one, as texts. Names compare with case."""
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in expected])
    types = F.map_from_entries(wanted)
    names, known = F.transform(schema, lambda c: c["name"]), F.map_keys(types)
    added = F.transform(F.array_except(names, known), lambda n: F.concat(n, F.lit(" is not documented")))
    gone = F.transform(F.array_except(known, names), lambda n: F.concat(n, F.lit(" is missing")))
    retyped = F.transform(
        F.filter(schema, lambda c: F.try_element_at(types, c["name"]) != c["type"]),
        lambda c: F.concat(c["name"], F.lit(" is "), c["type"], F.lit(", expected "), F.try_element_at(types, c["name"])),
    )
    listed = F.concat(added, gone, retyped)
    order = F.array(F.lit("the columns are in another order"))
    return F.when((schema != wanted) & (F.size(listed) == 0), order).otherwise(listed)


def schema_drift(schemas: DataFrame, expected: list[tuple[str, str]], rule: str = "VAL-10") -> DataFrame:
    """schemas (month, schema array<struct<name,type>>) against the expected one and the month before.

    The month before is the one before among those given. Where a column `others` holds different lists of
    columns of the month's other files, each is compared too.
    """
    none = F.array().cast("array<string>")
    previous = F.lag("schema").over(Window.orderBy("month"))
    df = schemas.withColumn("previous", previous)
    since = F.when(F.col("schema") != F.col("previous"), F.array(F.lit("the schema changed from the month before"))).otherwise(none)
    among = none
    if "others" in schemas.columns:
        each = F.transform("others", lambda s: F.concat(F.lit("other files: "), F.array_join(differences(s, expected), ", ")))
        among = F.coalesce(each, none)
    judged = df.select("month", F.concat(differences(F.col("schema"), expected), since, among).alias("problems"))
    count = F.size("problems")
    return verdicts(
        judged, rule, BOTH, F.when(count > 0, "fail").otherwise("pass"), count,
        F.when(count > 0, F.concat(F.array_join("problems", "; "), F.lit("."))).otherwise("The schema is as documented."),
    )
