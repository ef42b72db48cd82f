"""Results of the star-schema packs."""

from __future__ import annotations

from oracle.base import cte

cte("s_lines", """
SELECT l.*, o.o_orderkey, o.o_orderdate, o.o_orderstatus, strftime(l.l_shipdate, '%Y-%m') AS ship_month,
  l.l_partkey IN (SELECT p_partkey FROM part) AS part_known
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey""")
cte("s_events", "SELECT *, ts::DATE::VARCHAR AS day FROM events")
cte("s_labels", "SELECT *, doc_id IN (SELECT doc_id FROM documents) AS document_known FROM labels")


def _long(table: str, keys: str, rules: dict, rollups: dict, groups: dict) -> str:
    parts = []
    for rule, (fails, applies, _) in rules.items():
        parts.append(f"SELECT {keys}, '{rule}' AS rule, count(*) FILTER (WHERE {fails}) AS failed, "
                     f"count(*) FILTER (WHERE {applies}) AS checked FROM {table} GROUP BY ALL")
    for name, members in rollups.items():
        either = " OR ".join(f"coalesce({rules[m][0]}, false)" for m in members)
        parts.append(f"SELECT {keys}, '{name}', count(*) FILTER (WHERE {either}), count(*) FROM {table} GROUP BY ALL")
    ordered = ", ".join(f"{k} NULLS FIRST" for k in keys.split(", "))
    for rule, key in groups.items():
        parts.append(
            f"SELECT {keys}, '{rule}', coalesce(failed, 0)::BIGINT, n FROM (SELECT {keys}, count(*) AS n FROM {table} GROUP BY ALL) "
            f"LEFT JOIN (SELECT {keys}, count(*) AS failed FROM (SELECT {keys}, row_number() OVER (PARTITION BY {key} ORDER BY {ordered}) AS nth "
            f"FROM {table}) WHERE nth > 1 GROUP BY ALL) USING ({keys})")
    return " UNION ALL ".join(parts)


def _rollups(rules: dict) -> dict:
    out: dict = {}
    for rule, (_, _, (dimension, verdict)) in rules.items():
        for scope in (dimension, "all"):
            out.setdefault(f"@{scope}/{verdict}", []).append(rule)
    return out


LINES = {
    "LIN-01": ("l_quantity < 1 OR l_quantity > 50", "true", ("validity", "defect")),
    "LIN-02": ("l_discount >= 0.09", "true", ("validity", "business rule")),
    "LIN-03": ("l_tax = 0", "true", ("completeness", "documentation gap")),
    "LIN-04": ("o_orderkey IS NULL", "true", ("integrity", "defect")),
    "LIN-05": ("o_orderdate > l_shipdate", "true", ("consistency", "defect")),
    "LIN-06": ("o_orderstatus = 'F' AND date_diff('day', o_orderdate, l_shipdate) > 120", "o_orderstatus = 'F'",
               ("reasonability", "business rule")),
    "LIN-08": ("l_linestatus || o_orderstatus = 'OF'", "o_orderstatus = 'F'", ("consistency", "defect")),
    "LIN-09": ("l_extendedprice / l_quantity > 3000", "true", ("reasonability", "business rule")),
    "LIN-10": ("NOT part_known", "true", ("integrity", "defect")),
}
EVENTS = {
    "EVT-01": ("event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view')", "true", ("validity", "defect")),
    "EVT-02": ("json_extract_string(props, '$.k') IS NULL", "true", ("validity", "defect")),
    "EVT-03": ("event_type = 'purchase' AND value > 200", "event_type = 'purchase'", ("reasonability", "business rule")),
    "EVT-04": ("event_type = 'error' AND json_extract_string(props, '$.k')::INT <= 10", "event_type = 'error'",
               ("consistency", "documentation gap")),
}
LABELS = {
    "LBL-01": ("NOT document_known", "true", ("integrity", "defect")),
    "LBL-02": ("quality + toxic = 2", "true", ("consistency", "defect")),
    "LBL-03": ("quality NOT IN (0, 1)", "true", ("validity", "defect")),
}


def lines() -> str:
    groups = {"LIN-07": "l_orderkey, l_linenumber", "LIN-11": "l_orderkey, l_partkey"}
    return _long("s_lines", "ship_month, l_returnflag", LINES, _rollups(LINES), groups)


def events() -> str:
    return _long("s_events", "day", EVENTS, _rollups(EVENTS), {"EVT-05": "event_id"})


def labels() -> str:
    return _long("s_labels", "toxic", LABELS, _rollups(LABELS), {})


def revenue() -> str:
    """Line revenue of an order month and segment against the order totals; orders without lines and lines without an order count."""
    return """
SELECT 'ACC-02' AS rule, month, company,
  CASE WHEN abs(ours - theirs) > 0.005::DOUBLE * theirs THEN 'fail' ELSE 'pass' END AS status,
  round((ours - theirs) / nullif(theirs, 0), 6) AS value
FROM (SELECT CASE WHEN o_orderkey IS NULL THEN 'no order' ELSE strftime(o_orderdate, '%Y-%m') END AS month,
        CASE WHEN o_orderkey IS NULL THEN 'no order' ELSE coalesce(c_mktsegment, 'unknown') END AS company, sum(coalesce(lines, 0))::BIGINT AS ours,
        sum(coalesce(round(o_totalprice * 100)::BIGINT, 0))::BIGINT AS theirs
  FROM orders FULL JOIN (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT) AS lines FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  GROUP BY ALL)"""


def event_volume() -> str:
    return """
SELECT a.day, a.event_type AS company, a.n AS trips, round_even(median(b.n), 0)::BIGINT AS expected, round(a.n / median(b.n) - 1, 4) AS deviation
FROM (SELECT ts::DATE AS d, day, event_type, count(*) AS n FROM s_events GROUP BY ALL) a
LEFT JOIN (SELECT ts::DATE AS d, event_type, count(*) AS n FROM s_events GROUP BY ALL) b
  ON a.event_type = b.event_type AND a.d <> b.d AND abs(a.d - b.d) <= 28 AND (a.d - b.d) % 7 = 0
GROUP BY a.day, a.event_type, a.n"""
