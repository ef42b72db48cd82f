"""Rule packs for a star schema of orders and for an event log: the same engine, other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.operators.references import mark_known
from veritally.rules import Rule, RulePack, SameRecord

DIMENSIONS = {
    "completeness": "values that are absent",
    "consistency": "values of one record against each other",
    "integrity": "keys against the tables that hold them",
    "reasonability": "amounts and delays out of proportion",
    "uniqueness": "records that occur again",
    "validity": "values outside their range or list",
}


def line_view(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Order lines with their order's date and status, and whether their part is known."""
    heads = orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    lines = _dated(lineitem).join(heads, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return mark_known(lines, {"l_partkey": "part_known"}, part, "p_partkey")


def line_records(lineitem: DataFrame, orders: DataFrame) -> DataFrame | None:
    """The records of the line view for rules on copies: the lines alone, unless an order that occurs twice repeats its lines there."""
    keys = orders.where("o_orderkey IS NOT NULL").groupBy("o_orderkey").count()
    return _dated(lineitem) if keys.where("count > 1").isEmpty() else None


def _dated(lineitem: DataFrame) -> DataFrame:
    return lineitem.withColumn("ship_month", F.date_format("l_shipdate", "yyyy-MM"))


LINES = RulePack(
    name="order lines",
    keys=("ship_month", "l_returnflag"),
    dimensions=DIMENSIONS,
    rules=(
        Rule("LIN-01", "Quantity out of range", "validity", "error", "defect", "l_quantity is not from 1 to 50.",
             fails="l_quantity NOT BETWEEN 1 AND 50", shows=("l_orderkey", "l_linenumber", "l_quantity")),
        Rule("LIN-02", "Discount at the limit", "validity", "warning", "business rule", "l_discount is 0.09 or more.",
             fails="l_discount >= 0.09", shows=("l_orderkey", "l_linenumber", "l_discount")),
        Rule("LIN-03", "No tax", "completeness", "warning", "documentation gap", "l_tax is zero.",
             fails="l_tax = 0", shows=("l_orderkey", "l_linenumber", "l_tax")),
        Rule("LIN-04", "Order unknown", "integrity", "error", "defect", "The order is not in orders.",
             fails="o_orderkey IS NULL", shows=("l_orderkey", "l_linenumber")),
        Rule("LIN-05", "Shipped before ordered", "consistency", "error", "defect", "l_shipdate is before o_orderdate.",
             fails="l_shipdate < o_orderdate", shows=("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")),
        Rule("LIN-06", "Shipped late", "reasonability", "warning", "business rule",
             "The line of a finished order shipped over 120 days after the order.",
             fails="o_orderstatus = 'F' AND l_shipdate > o_orderdate + INTERVAL 120 DAY", applies="o_orderstatus = 'F'",
             shows=("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")),
        Rule("LIN-07", "Line number twice", "uniqueness", "error", "defect", "Two lines share order and line number.",
             same=SameRecord(("l_orderkey", "l_linenumber"))),
        Rule("LIN-08", "Open line of a finished order", "consistency", "warning", "defect",
             "The line is open though its order is finished.",
             fails="l_linestatus = 'O' AND o_orderstatus = 'F'", applies="o_orderstatus = 'F'",
             shows=("l_orderkey", "l_linenumber", "l_linestatus", "o_orderstatus")),
        Rule("LIN-09", "Dear unit", "reasonability", "warning", "business rule", "A unit costs more than 3000.",
             fails="try_divide(l_extendedprice, l_quantity) > 3000",
             shows=("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")),
        Rule("LIN-10", "Part unknown", "integrity", "error", "defect", "The part is not in part.",
             fails="NOT part_known", shows=("l_orderkey", "l_linenumber", "l_partkey")),
        Rule("LIN-11", "Busy order line", "uniqueness", "warning", "business rule",
             "An order has more than one line of the same part.",
             same=SameRecord(("l_orderkey", "l_partkey"))),
    ),
)


def event_view(events: DataFrame) -> DataFrame:
    return events.withColumn("day", F.to_date("ts"))


EVENTS = RulePack(
    name="events",
    keys=("day",),
    dimensions=DIMENSIONS,
    rules=(
        Rule("EVT-01", "Unknown type", "validity", "error", "defect", "event_type is not one of the five.",
             fails="event_type NOT IN ('view', 'click', 'signup', 'purchase', 'error')",
             shows=("event_id", "event_type")),
        Rule("EVT-02", "Properties not JSON", "validity", "error", "defect", "props has no number k.",
             fails="get_json_object(props, '$.k') IS NULL", shows=("event_id", "props")),
        Rule("EVT-03", "Value out of range", "reasonability", "warning", "business rule",
             "The value of a purchase is over 200.",
             fails="event_type = 'purchase' AND value > 200", applies="event_type = 'purchase'",
             shows=("event_id", "event_type", "value")),
        Rule("EVT-04", "Error without properties over ten", "consistency", "warning", "documentation gap",
             "An error event has k of ten or less.",
             fails="event_type = 'error' AND CAST(get_json_object(props, '$.k') AS INT) <= 10",
             applies="event_type = 'error'", shows=("event_id", "event_type", "props")),
        Rule("EVT-05", "Event twice", "uniqueness", "error", "defect", "Two events share their id.",
             same=SameRecord(("event_id",))),
    ),
)


def label_view(labels: DataFrame, documents: DataFrame) -> DataFrame:
    return mark_known(labels, {"doc_id": "document_known"}, documents, "doc_id")


LABELS = RulePack(
    name="labels",
    keys=("toxic",),
    dimensions=DIMENSIONS,
    rules=(
        Rule("LBL-01", "Document unknown", "integrity", "error", "defect", "The document is not in documents.",
             fails="NOT document_known", shows=("doc_id",)),
        Rule("LBL-02", "Good and toxic", "consistency", "warning", "defect", "The label is both good and toxic.",
             fails="quality = 1 AND toxic = 1", shows=("doc_id", "quality", "toxic")),
        Rule("LBL-03", "Quality out of range", "validity", "error", "defect", "quality is not 0 or 1.",
             fails="quality NOT IN (0, 1)", shows=("doc_id", "quality")),
    ),
)
