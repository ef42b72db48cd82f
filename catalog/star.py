"""The star-schema packs over the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import Inputs, Query, rounded
from oracle import star as sql
from oracle.base import query
from veritally.operators import checks, files, volume
from veritally.packs import star


def _lines(spark, d) -> DataFrame:
    i = Inputs(spark, d)
    lines, orders = i.table("lineitem"), i.table("orders")
    return checks.check(star.line_view(lines, orders, i.table("part")), star.LINES, star.line_records(lines, orders))


def _events(spark, d) -> DataFrame:
    found = checks.check(star.event_view(Inputs(spark, d).table("events")), star.EVENTS)
    return found.withColumn("day", F.col("day").cast("string"))


def _labels(spark, d) -> DataFrame:
    i = Inputs(spark, d)
    return checks.check(star.label_view(i.table("labels"), i.table("documents").select("doc_id")), star.LABELS)


def _revenue(spark, d) -> DataFrame:
    """Line revenue against order totals, in cents; orders without lines count with none, lines without an order by themselves."""
    i = Inputs(spark, d)
    cents = lambda column: F.round(F.col(column) * 100).cast("bigint")
    own = lambda column: F.when(F.col("ordered"), column).otherwise("no order")
    lines = i.table("lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("lines"))
    orders = i.table("orders").withColumn("ordered", F.lit(True))
    heads = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "full")
        .join(i.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .groupBy(own(F.date_format("o_orderdate", "yyyy-MM")).alias("month"), own(F.coalesce("c_mktsegment", F.lit("unknown"))).alias("company"))
        .agg(F.sum(F.coalesce("lines", F.lit(0))).alias("trips"), F.sum(F.coalesce(cents("o_totalprice"), F.lit(0))).alias("total"))
    )
    return rounded(files.compare_totals(heads.withColumnsRenamed({"trips": "ours", "total": "theirs"}), "ACC-02", 0.005)).drop("detail")


def _event_volume(spark, d) -> DataFrame:
    totals = star.event_view(Inputs(spark, d).table("events")).groupBy(
        "day", F.date_format("day", "yyyy-MM").alias("month"), F.col("event_type").alias("company")
    ).agg(F.count(F.lit(1)).alias("trips"))
    causes = spark.createDataFrame([], "day string, cause string")
    return volume.volume_series(totals, causes, 0.25).select("day", "company", "trips", "expected", "deviation")


def queries() -> dict[str, Query]:
    return {
        "star_lines": _lines,
        "star_events": _events,
        "star_labels": _labels,
        "star_revenue": _revenue,
        "star_event_volume": _event_volume,
    }


def oracle() -> dict[str, str]:
    return {
        "star_lines": query(sql.lines()),
        "star_events": query(sql.events()),
        "star_labels": query(sql.labels()),
        "star_revenue": query(sql.revenue()),
        "star_event_volume": query(sql.event_volume()),
    }
