"""Status, scorecard and trend queries over landed results.

Inputs are the result tables: ``quality`` rows, month results and the registry, all small.
The company filter Both covers every company; its rows are part of each result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.measures import change, tone
from veritally.operators.files import BOTH

# From best to worst. A dimension shows the worst of its rules; pending yields to clean.
ORDER = ("pending", "clean", "warning", "error")


def _rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in ORDER]), status)


def _worst(status: str) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ORDER]), F.max(_rank(F.col(status))).cast("int"))


def _found(status: str = "status") -> Column:
    return F.col(status).isin("warning", "error")


def rule_stats(quality: DataFrame) -> DataFrame:
    """(rule, month, company, failed, checked, share) over days; Both adds the companies up."""
    both = F.when(F.grouping("company") == 1, BOTH).otherwise(F.col("company"))
    keys = [F.col("rule"), F.col("month"), F.col("company")]
    return quality.groupingSets([keys, keys[:2]], *keys).agg(
        both.alias("company_filter"), F.sum("failed").alias("failed"), F.sum("checked").alias("checked")
    ).select(
        "rule", "month", F.col("company_filter").alias("company"), "failed", "checked",
        F.try_divide("failed", "checked").alias("share"),
    )


def filters(months: DataFrame, companies: list[str]) -> DataFrame:
    """Every month with every setting of the company filter."""
    return months.select("month").distinct().withColumn(
        "company", F.explode(F.array(*[F.lit(c) for c in [BOTH, *companies]]))
    )


def stats_grid(stats: DataFrame, ids: DataFrame, months: DataFrame, companies: list[str]) -> DataFrame:
    """A row for each of ``ids`` (rule), month and company filter; zero where nothing was counted.

    The grid is months by filters by the rules of a pack, all declared and few; rules are broadcast.
    """
    wanted = filters(months, companies).crossJoin(F.broadcast(ids.select("rule").distinct()))
    joined = wanted.join(stats, ["rule", "month", "company"], "left")
    return joined.select(
        "rule", "month", "company", F.coalesce("failed", F.lit(0)).alias("failed"),
        F.coalesce("checked", F.lit(0)).alias("checked"), "share",
    )


def month_rows(results: DataFrame, months: DataFrame, companies: list[str]) -> DataFrame:
    """Month results under each company filter, as ``filter``; those for Both always show."""
    shown = filters(months, companies).withColumnRenamed("company", "filter")
    return results.join(shown, "month").where(
        (F.col("filter") == BOTH) | (F.col("company") == BOTH) | (F.col("company") == F.col("filter"))
    )


def rule_status(
    stats: DataFrame, results: DataFrame, registry: DataFrame, months: DataFrame, companies: list[str]
) -> DataFrame:
    """(month, company, rule, grain, status, failed, checked, share) for every rule and filter."""
    rules = registry.select("rule", "dimension", "severity", "verdict", "grain")
    trip = (
        stats_grid(stats, rules.where("grain = 'trip'"), months, companies).join(rules, "rule")
        .withColumn("status", F.when(F.col("failed") > 0, F.col("severity")).otherwise("clean"))
    )
    judged = month_rows(results, months, companies).groupBy("rule", "month", F.col("filter").alias("company")).agg(
        F.count_if(F.col("status") == "fail").alias("failed"), F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )
    month = (
        filters(months, companies).crossJoin(F.broadcast(rules.where("grain = 'month'")))
        .join(judged, ["rule", "month", "company"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("failed", "checked", "pending")})
        .withColumn("status", F.when(F.col("failed") > 0, F.col("severity")).when(
            (F.col("checked") > 0) & (F.col("pending") == F.col("checked")), "pending").otherwise("clean"))
        .withColumn("share", F.lit(None).cast("double"))
    )
    columns = ["month", "company", "rule", "dimension", "severity", "verdict", "grain", "status", "failed", "checked", "share"]
    return trip.select(*columns).unionByName(month.select(*columns))


def shown_rules(status: DataFrame, verdict: str | None = None, found_only: bool = False) -> DataFrame:
    """The rule list under its two filters."""
    if verdict:
        status = status.where(F.col("verdict") == verdict)
    return status.where(_found()) if found_only else status


def rules_found(status: DataFrame) -> DataFrame:
    """Rules that found something, of all, per month and company filter."""
    return status.groupBy("month", "company").agg(
        F.count_if(_found()).alias("found"), F.count(F.lit(1)).alias("rules")
    )


def dimension_status(status: DataFrame) -> DataFrame:
    return status.groupBy("month", "company", "dimension").agg(_worst("status").alias("status"))


def dimension_defects(stats: DataFrame, registry: DataFrame, months: DataFrame, companies: list[str]) -> DataFrame:
    """Trips with a defect, per dimension: counted once where trips were, else the largest rule.

    Rules over groups overlap (an identical record is also the same trip), so they do not add.
    """
    dimensions = registry.select("dimension").distinct()
    rollup = stats_grid(
        stats, dimensions.select(F.concat(F.lit("@"), "dimension", F.lit("/defect")).alias("rule")), months, companies
    ).select(F.regexp_extract("rule", "^@(.*)/", 1).alias("dimension"), "month", "company", "failed", "checked", "share")
    rules = registry.where("grain = 'trip' AND verdict = 'defect'").select("rule", "dimension", "position")
    largest = (
        stats_grid(stats, rules, months, companies).join(rules, "rule").groupBy("dimension", "month", "company").agg(
            F.max_by(F.struct("failed", "checked", "share"), F.struct("failed", -F.col("position"))).alias("most")
        )
    )
    counted = F.col("checked") > 0
    fallback = rollup.join(largest, ["dimension", "month", "company"], "left")
    return fallback.select("dimension", "month", "company", *[
        F.when(counted | F.col("most").isNull(), F.col(c)).otherwise(F.col("most")[c]).alias(c)
        for c in ("failed", "checked", "share")
    ])


def dimension_cards(
    status: DataFrame, stats: DataFrame, registry: DataFrame, months: DataFrame, companies: list[str]
) -> DataFrame:
    """The scorecard: status, rules clean and with findings, defects, and trips explained otherwise.

    ``explained`` adds business rules and documentation gaps, and may count a trip in each.
    """
    card = status.groupBy("month", "company", "dimension").agg(
        _worst("status").alias("status"), F.count(F.lit(1)).alias("rules"), F.count_if(_found()).alias("found"),
        F.count_if((F.col("grain") == "trip") & (F.col("verdict") == "defect")).alias("defect_rules"),
    )
    other = stats.where(F.col("rule").rlike("^@.*/(business rule|documentation gap)$")).groupBy(
        F.regexp_extract("rule", "^@(.*)/", 1).alias("dimension"), "month", "company"
    ).agg(F.sum("failed").alias("explained"))
    keys = ["month", "company", "dimension"]
    has = F.col("defect_rules") > 0
    return (
        card.join(dimension_defects(stats, registry, months, companies), keys).join(other, keys, "left")
        .select(
            *keys, "status", "rules", "found", (F.col("rules") - F.col("found")).alias("clean"),
            F.when(has, F.col("failed")).alias("defects"), F.when(has, F.col("share")).alias("defect_share"),
            F.coalesce("explained", F.lit(0)).alias("explained"),
        )
    )


def dimension_trend(stats: DataFrame, registry: DataFrame, months: DataFrame, companies: list[str]) -> DataFrame:
    return dimension_defects(stats, registry, months, companies).select(
        "dimension", "month", "company", F.coalesce("share", F.lit(0.0)).alias("share")
    )


def verdict_cards(status: DataFrame, stats: DataFrame) -> DataFrame:
    """Per verdict: trips failing a rule of it, their share, and rules hit of all."""
    hits = status.groupBy("month", "company", "verdict").agg(
        F.count_if(_found()).alias("hits"), F.count(F.lit(1)).alias("rules")
    )
    trips = stats.where(F.col("rule").startswith("@all/")).select(
        F.substring_index("rule", "/", -1).alias("verdict"), "month", "company", "failed", "share"
    )
    return hits.join(trips, ["month", "company", "verdict"], "left").select(
        "month", "company", "verdict", F.coalesce("failed", F.lit(0)).alias("trips"), "share", "hits", "rules"
    )


def compared(values: DataFrame, measures: dict[str, tuple[str, str | None]], by: list[str]) -> DataFrame:
    """Each measure against the month before, of the months there are, as long rows.

    measures: name → (ratio or points, the better direction or None).
    """
    long = values.select("month", *by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures
    ])))
    before = F.lag("value").over(Window.partitionBy(*by, "measure").orderBy("month"))
    rows = long.withColumn("prior", before)
    moved, toned = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, (kind, better) in measures.items():
        step = change(F.col("value"), F.col("prior"), kind)
        moved = F.when(F.col("measure") == name, step).otherwise(moved)
        toned = F.when(F.col("measure") == name, tone(F.col("change"), better)).otherwise(toned)
    return rows.withColumn("change", moved).withColumn("tone", toned)


QUALITY_KPIS = {
    "checked": ("ratio", None),
    "defect_share": ("points", "down"),
    "found": ("ratio", "down"),
    "lag_days": ("ratio", "down"),
}


def quality_kpis(
    status: DataFrame, stats: DataFrame, registry: DataFrame, facts: DataFrame, months: DataFrame, companies: list[str]
) -> DataFrame:
    """Trips checked, share with a defect, rules that found something and lag, against the month before."""
    ids = registry.sparkSession.createDataFrame([("@all/defect",)], "rule string")
    defects = stats_grid(stats, ids, months, companies).select("month", "company", "checked", F.col("share").alias("defect_share"))
    found = rules_found(status).select("month", "company", "found")
    values = defects.join(found, ["month", "company"]).join(facts.select("month", "lag_days"), "month")
    return compared(values, QUALITY_KPIS, ["company"])


def rule_table(stats: DataFrame, registry: DataFrame, months: DataFrame, companies: list[str]) -> DataFrame:
    """Failed, checked and share per rule, month and company: a rule's table and its trend."""
    return stats_grid(stats, registry.where("grain = 'trip'"), months, companies).where(F.col("company") != BOTH)


def reconcile_matrix(results: DataFrame, months: DataFrame, companies: list[str], rule: str = "ACC-02") -> DataFrame:
    """Month by company: the share off, "exact" where none, "pending" where not published."""
    text = F.when(F.col("status") == "pending", "pending").when(F.col("value") == 0, "exact").otherwise(
        F.concat(F.when(F.col("value") > 0, "+").otherwise(""), F.format_number(F.col("value") * 100, 2), F.lit("%"))
    )
    wide = results.where(F.col("rule") == rule).groupBy("month").pivot("company", [*companies, BOTH]).agg(F.first(text))
    return months.select("month").distinct().join(wide, "month", "left").select(
        "month", *[F.coalesce(c, F.lit("pending")).alias(c.lower()) for c in [*companies, BOTH]]
    )


def month_strip(status: DataFrame) -> DataFrame:
    """A month rule's status month by month, over all companies."""
    return status.where((F.col("grain") == "month") & (F.col("company") == BOTH)).select("rule", "month", "status")


def lag_categories(facts: DataFrame, max_days: int) -> DataFrame:
    return facts.select(
        "month", "published", "lag_days",
        F.when(F.col("lag_days") > max_days, "Later than two months").otherwise("Within two months").alias("status"),
    )


def volume_rows(series: DataFrame) -> DataFrame:
    """The days of the volume chart with a label."""
    label = F.when(F.col("flag") == "explained", "Drop with a known cause").when(
        F.col("flag") == "unexplained", "Drop with no known cause").otherwise("Within 25 percent")
    return series.where(F.col("deviation").isNotNull()).withColumn("status", label)


def examples_for(examples: DataFrame, company: str) -> DataFrame:
    """Example records of a company; all of a rule's where none is of that company."""
    if company == BOTH:
        return examples
    mine = F.max(F.col("company") == company).over(Window.partitionBy("month", "rule"))
    return examples.withColumn("mine", mine).where(~F.col("mine") | (F.col("company") == company)).drop("mine")


def total_checked(stats: DataFrame, months: DataFrame) -> DataFrame:
    """Trips checked over all months."""
    rows = stats.where((F.col("rule") == "@all/defect") & (F.col("company") == BOTH)).join(months.distinct(), "month")
    return rows.agg(F.sum("checked").alias("trips"))


def checked_unpublished(quality: DataFrame, months: DataFrame) -> DataFrame:
    """Trips checked in each month that is not among the published ones; total_checked leaves these out."""
    rows = quality.where(F.col("rule") == "@all/defect").join(months.distinct(), "month", "left_anti")
    return rows.groupBy("month").agg(F.sum("checked").alias("trips"))


def selected_months(months: DataFrame, month: str) -> DataFrame:
    """Months with their half-open date range, and whether each is the selected one."""
    start = F.to_date(F.concat("month", F.lit("-01")))
    return months.select("month").distinct().select(
        "month", start.alias("start"), F.add_months(start, 1).alias("end"), (F.col("month") == month).alias("selected")
    )


def selected_trend(trend: DataFrame, months: DataFrame, month: str) -> DataFrame:
    """A trend by month with each month's date range and whether it is the selected one: line and band in one frame.

    Months without a row of the trend have one with no values.
    """
    return selected_months(months, month).join(trend, "month", "left")
