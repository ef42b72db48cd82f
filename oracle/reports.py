"""Rules over files, and the report queries."""

from __future__ import annotations

from oracle.base import cte, literal
from oracle.trips import REALS, rounded
from veritally.functions.measures import MEASURES
from veritally.packs.rideshare import DIMENSIONS, RIDESHARE, SCHEMA
from veritally.plans.operations import KPIS
from veritally.plans.status import QUALITY_KPIS
from veritally.sources import trip_fixture as fixture


def values(rows, *columns: str) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) v({', '.join(columns)})"


RULES = RIDESHARE.rules
cte("y_registry", values(
    [(i, r.id, r.title, r.dimension, r.severity, r.verdict, r.grain) for i, r in enumerate(RULES)],
    "position", "rule", "title", "dimension", "severity", "verdict", "grain",
))
cte("y_companies", "SELECT unnest(['Both', 'Uber', 'Lyft']) AS company")

# File facts.
cte("y_licences", "SELECT file_month AS month, hvfhs_license_num, count(*) AS rows FROM x_raw GROUP BY ALL")
cte("y_company_trips", """
SELECT month, CASE hvfhs_license_num WHEN 'HV0003' THEN 'Uber' ELSE 'Lyft' END AS company, sum(rows)::BIGINT AS trips
FROM y_licences WHERE hvfhs_license_num IN ('HV0003', 'HV0005') GROUP BY ALL""")
cte("y_published", f"""
SELECT month, CASE WHEN month <> '{fixture.NOT_DATED}' THEN (last_day((month || '-01')::DATE) + (20 + 7 * month[6:7]::INT))::DATE END AS published
FROM (SELECT DISTINCT file_month AS month FROM x_raw WHERE file_month <> '{fixture.NO_MONTH}')""")
cte("y_lag", """SELECT month, published,
  date_diff('day', last_day((month || '-01')::DATE), published)::INT AS lag_days FROM y_published""")


def _schema(fields) -> str:
    return "[" + ", ".join(literal(f"{n} {t}") for n, t in fields) + "]"


_retyped = [(n, "double" if n == "trip_time" else t) for n, t in SCHEMA] + [("congestion_zone", "int")]
cte("y_schema", f"""
SELECT month, CASE WHEN month = (SELECT min(month) FROM y_published) THEN {_schema(SCHEMA[:-1])}
  WHEN month = '1997-03' THEN {_schema([SCHEMA[1], SCHEMA[0], *SCHEMA[2:]])}
  WHEN month = '1998-05' THEN {_schema(_retyped)} ELSE {_schema(SCHEMA)} END AS fields
FROM y_published""")
cte("y_expected", values([(i, n, t) for i, (n, t) in enumerate(SCHEMA)], "position", "name", "type"))
cte("y_aggregate", """
SELECT month, company, trips - CASE WHEN month[6:7]::INT % 5 = 0 THEN floor(trips / 20)::BIGINT ELSE 0 END AS total
FROM y_company_trips WHERE month[6:7] <> '12' AND month IN (SELECT month FROM y_published)""")
cte("y_indicators", """
SELECT month, floor(sum(trips) / day(last_day((month || '-01')::DATE)))::BIGINT * day(last_day((month || '-01')::DATE)) AS total
FROM y_company_trips WHERE month[6:7] <> '11' AND month IN (SELECT month FROM y_published) GROUP BY month""")

# Rules over files.
cte("y_acc_02", """
SELECT 'ACC-02' AS rule, month, company,
  CASE WHEN theirs IS NULL THEN 'pending' WHEN abs(ours - theirs) > 0.005::DOUBLE * theirs THEN 'fail' ELSE 'pass' END AS status,
  (ours - theirs) / theirs AS value,
  CASE WHEN theirs IS NULL THEN 'No published total for this month yet.'
    ELSE 'Landed ' || format('{:,}', ours) || ', published ' || format('{:,}', theirs) || ': ' ||
      CASE WHEN ours = theirs THEN 'equal' WHEN ours > theirs THEN format('{:,}', ours - theirs) || ' more'
           ELSE format('{:,}', theirs - ours) || ' fewer' END || '.' END AS detail
FROM (
  SELECT p.month, c.company, coalesce(t.trips, 0)::BIGINT AS ours, a.total::BIGINT AS theirs
  FROM y_published p CROSS JOIN (SELECT unnest(['Uber', 'Lyft']) AS company) c
  LEFT JOIN y_company_trips t USING (month, company) LEFT JOIN y_aggregate a USING (month, company)
  UNION ALL
  SELECT p.month, 'Both', (SELECT sum(trips) FROM y_company_trips t WHERE t.month = p.month)::BIGINT, i.total::BIGINT
  FROM y_published p LEFT JOIN y_indicators i ON i.month = p.month)""")
cte("y_tml_02", """
SELECT 'TML-02' AS rule, p.month, 'Both' AS company, CASE WHEN count(DISTINCT a.company) = 2 THEN 'pass' ELSE 'fail' END AS status,
  NULL::DOUBLE AS value, CASE WHEN count(DISTINCT a.company) = 2 THEN 'The published totals cover this month.'
    ELSE 'The published totals do not cover this month yet.' END AS detail
FROM y_published p LEFT JOIN y_aggregate a USING (month) GROUP BY p.month""")
cte("y_causes", values(list(fixture.CAUSES.items()), "day", "cause"))
cte("y_totals", "SELECT day::DATE AS day, month, company, sum(trips)::BIGINT AS trips FROM x_daily GROUP BY ALL")
cte("y_expect", """
SELECT a.day, a.month, a.company, a.trips, (
  SELECT median(b.trips) FROM y_totals b WHERE b.company = a.company AND b.day <> a.day
    AND dayofweek(b.day) = dayofweek(a.day) AND b.day BETWEEN a.day - 28 AND a.day + 28) AS expected
FROM y_totals a""")
cte("y_judged", "SELECT *, CASE WHEN expected > 0 THEN trips / expected - 1 END AS deviation, day::VARCHAR AS d FROM y_expect")
cte("y_volume", """
SELECT j.d AS day, j.month, j.company, j.trips,
  CASE WHEN expected > 0 THEN round_even(expected, 0)::BIGINT END AS expected, round(deviation, 4) AS deviation,
  CASE WHEN deviation < -0.25 THEN CASE WHEN c.cause IS NULL THEN 'unexplained' ELSE 'explained' END END AS flag,
  CASE WHEN deviation < -0.25 THEN c.cause END AS cause
FROM y_judged j LEFT JOIN y_causes c ON c.day = j.d""")
cte("y_rsn_01", """
SELECT 'RSN-01' AS rule, p.month, c.company, CASE WHEN count(*) FILTER (WHERE v.flag = 'unexplained') > 0 THEN 'fail' ELSE 'pass' END AS status,
  (count(*) FILTER (WHERE v.flag = 'unexplained'))::DOUBLE AS value,
  coalesce(string_agg(v.day || ' ' || round(v.deviation * 100)::BIGINT || '%' || coalesce(' (' || v.cause || ')', ''), '; ' ORDER BY v.day)
    FILTER (WHERE v.flag IS NOT NULL) || '.', 'No day is far below its expected volume.') AS detail
FROM y_published p CROSS JOIN (SELECT unnest(['Uber', 'Lyft']) AS company) c
LEFT JOIN y_volume v ON v.month = p.month AND v.company = c.company GROUP BY p.month, c.company""")
cte("y_tml_01", """
SELECT 'TML-01' AS rule, month, 'Both' AS company,
  CASE WHEN lag_days IS NULL THEN 'pending' WHEN lag_days > 62 THEN 'fail' ELSE 'pass' END AS status, lag_days::DOUBLE AS value,
  coalesce('Published ' || published || ', ' || lag_days || ' days after the month.', 'No publication date is recorded.') AS detail
FROM y_lag""")
cte("y_int_03", """
SELECT 'INT-03' AS rule, p.month, 'Both' AS company, CASE WHEN count(l.rows) > 0 THEN 'fail' ELSE 'pass' END AS status,
  coalesce(sum(l.rows), 0)::DOUBLE AS value,
  CASE WHEN count(l.rows) > 0 THEN 'Not documented: ' || string_agg(l.hvfhs_license_num, ', ' ORDER BY l.hvfhs_license_num) || '.'
    ELSE 'Every code is documented.' END AS detail
FROM y_published p LEFT JOIN y_licences l ON l.month = p.month AND l.hvfhs_license_num NOT IN ('HV0002', 'HV0003', 'HV0004', 'HV0005')
GROUP BY p.month""")
cte("y_fields", """
SELECT month, i AS position, split_part(fields[i], ' ', 1) AS name, split_part(fields[i], ' ', 2) AS type
FROM (SELECT month, fields, unnest(range(1, len(fields) + 1)) AS i FROM y_schema)""")
cte("y_problems", """
SELECT f.month, 1 AS kind, f.position, f.name || ' is not documented' AS problem
FROM y_fields f ANTI JOIN y_expected e ON e.name = f.name
UNION ALL SELECT p.month, 2, e.position, e.name || ' is missing' FROM y_published p CROSS JOIN y_expected e
WHERE NOT EXISTS (SELECT 1 FROM y_fields f WHERE f.month = p.month AND f.name = e.name)
UNION ALL SELECT f.month, 3, f.position, f.name || ' is ' || f.type || ', expected ' || e.type
FROM y_fields f JOIN y_expected e ON e.name = f.name AND e.type <> f.type""")
cte("y_val_10", f"""
SELECT 'VAL-10' AS rule, month, 'Both' AS company, CASE WHEN len(problems) > 0 THEN 'fail' ELSE 'pass' END AS status,
  len(problems)::DOUBLE AS value, CASE WHEN len(problems) > 0 THEN array_to_string(problems, '; ') || '.' ELSE 'The schema is as documented.' END AS detail
FROM (
  SELECT s.month, list_concat(
    CASE WHEN q.n IS NULL AND s.fields <> {_schema(SCHEMA)} THEN ['the columns are in another order'] ELSE coalesce(q.problems, []) END,
    CASE WHEN s.fields <> s.before THEN ['the schema changed from the month before'] ELSE [] END) AS problems
  FROM (SELECT *, lag(fields) OVER (ORDER BY month) AS before FROM y_schema) s
  LEFT JOIN (SELECT month, count(*) AS n, list(problem ORDER BY kind, position) AS problems FROM y_problems GROUP BY month) q USING (month))""")
MONTH_RULES = ("ACC-02", "TML-02", "RSN-01", "TML-01", "INT-03", "VAL-10")
cte("y_results", " UNION ALL ".join(f"SELECT * FROM y_{r.lower().replace('-', '_')}" for r in MONTH_RULES))

# Results by rule, month and company filter.
cte("y_months", "SELECT month FROM y_published WHERE month IN (SELECT month FROM x_daily)")
cte("y_quality", "SELECT * FROM x_quality WHERE month IN (SELECT month FROM y_months)")
cte("y_each", "SELECT rule, month, company, sum(failed)::BIGINT AS failed, sum(checked)::BIGINT AS checked FROM y_quality GROUP BY ALL")
cte("y_counts", """SELECT * FROM y_each UNION ALL
SELECT rule, month, 'Both', sum(failed)::BIGINT, sum(checked)::BIGINT FROM y_each GROUP BY ALL""")
cte("y_stats", "SELECT *, CASE WHEN checked > 0 THEN failed / checked END AS share FROM y_counts")
cte("y_names", "SELECT DISTINCT rule FROM y_each UNION SELECT rule FROM y_registry WHERE grain = 'trip' "
               "UNION SELECT '@' || dimension || '/defect' FROM y_registry UNION SELECT '@all/defect'")
cte("y_grid", """
SELECT n.rule, m.month, c.company, coalesce(s.failed, 0) AS failed, coalesce(s.checked, 0) AS checked, s.share
FROM y_names n CROSS JOIN y_months m CROSS JOIN y_companies c LEFT JOIN y_stats s USING (rule, month, company)""")
cte("y_shown", """
SELECT r.rule, r.month, c.company, count(*) FILTER (WHERE r.status = 'fail') AS failed, count(*) AS checked,
  count(*) FILTER (WHERE r.status = 'pending') AS pending
FROM y_results r JOIN y_companies c ON c.company = 'Both' OR r.company IN ('Both', c.company) GROUP BY ALL""")
cte("y_status", """
SELECT g.month, g.company, r.rule, r.dimension, r.severity, r.verdict, r.grain,
  CASE WHEN g.failed > 0 THEN r.severity ELSE 'clean' END AS status, g.failed, g.checked, g.share
FROM y_grid g JOIN y_registry r ON r.rule = g.rule AND r.grain = 'trip'
UNION ALL
SELECT m.month, c.company, r.rule, r.dimension, r.severity, r.verdict, r.grain,
  CASE WHEN s.failed > 0 THEN r.severity WHEN s.checked > 0 AND s.pending = s.checked THEN 'pending' ELSE 'clean' END,
  coalesce(s.failed, 0), coalesce(s.checked, 0), NULL
FROM y_registry r CROSS JOIN y_months m CROSS JOIN y_companies c LEFT JOIN y_shown s USING (rule, month, company)
WHERE r.grain = 'month'""")
WORST = """CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'warning') THEN 'warning'
  WHEN bool_or(status = 'clean') THEN 'clean' ELSE 'pending' END"""
FOUND = "count(*) FILTER (WHERE status IN ('error', 'warning'))"
cte("y_largest", """
SELECT r.dimension, g.month, g.company, g.failed, g.checked, g.share
FROM y_grid g JOIN y_registry r ON r.rule = g.rule AND r.grain = 'trip' AND r.verdict = 'defect'
QUALIFY row_number() OVER (PARTITION BY r.dimension, g.month, g.company ORDER BY g.failed DESC, r.position) = 1""")
cte("y_defects", f"""
SELECT d.dimension, g.month, g.company,
  CASE WHEN g.checked > 0 THEN g.failed ELSE coalesce(l.failed, g.failed) END AS failed,
  CASE WHEN g.checked > 0 THEN g.checked ELSE coalesce(l.checked, g.checked) END AS checked,
  CASE WHEN g.checked > 0 THEN g.share ELSE l.share END AS share
FROM (SELECT unnest({list(DIMENSIONS)!r}) AS dimension) d JOIN y_grid g ON g.rule = '@' || d.dimension || '/defect'
LEFT JOIN y_largest l ON l.dimension = d.dimension AND l.month = g.month AND l.company = g.company""")
cte("y_explained", """
SELECT split_part(rule[2:], '/', 1) AS dimension, month, company, sum(failed)::BIGINT AS explained FROM y_stats
WHERE rule LIKE '@%/business rule' OR rule LIKE '@%/documentation gap' GROUP BY ALL""")
cte("y_found", f"SELECT month, company, {FOUND} AS found, count(*) AS rules FROM y_status GROUP BY ALL")


def compared(table: str, measures: dict, by: list[str], places: int = 6) -> str:
    """Long rows of measures against the row before, as the KPI tiles compare them."""
    keys = "".join(f"{b}, " for b in by)
    long = " UNION ALL ".join(
        f"SELECT month, {keys}'{m}' AS measure, '{kind}' AS kind, {literal(better)} AS better, {m}::DOUBLE AS value FROM {table}"
        for m, (kind, better) in measures.items()
    )
    return f"""
SELECT month, {keys}measure, round(value, {places}) AS value, round(prior, {places}) AS prior, round(change, {places}) AS change,
  CASE WHEN better IS NULL OR abs(change) < 0.0005 OR change IS NULL THEN NULL
       WHEN (change > 0) = (better = 'up') THEN 'good' ELSE 'bad' END AS tone
FROM (SELECT *, CASE WHEN prior = 0 THEN NULL WHEN kind = 'points' THEN value - prior ELSE value / prior - 1 END AS change
  FROM (SELECT *, lag(value) OVER (PARTITION BY {keys}measure ORDER BY month) AS prior FROM ({long})))"""


cte("y_kpi_values", """
SELECT g.month, g.company, g.checked, g.share AS defect_share, f.found, l.lag_days
FROM y_grid g JOIN y_found f USING (month, company) JOIN y_lag l ON l.month = g.month WHERE g.rule = '@all/defect'""")

# Operations.
SUMMED = ", ".join(
    f"coalesce(sum({m}), 0) AS {m}" if m.endswith("trips") else f"coalesce(sum({m}::DECIMAL(20, 2))::DOUBLE, 0) AS {m}" for m in MEASURES
)
RATIOS = """CASE WHEN fares <> 0 THEN 1 - driver_pay / fares END AS platform_share, CASE WHEN trips > 0 THEN fares / trips END AS avg_fare,
  CASE WHEN wait_trips > 0 THEN wait_seconds / wait_trips END AS avg_wait, CASE WHEN trips > 0 THEN miles / trips END AS avg_miles,
  CASE WHEN trips > 0 THEN trip_seconds / trips / 60 END AS avg_minutes, CASE WHEN fares <> 0 THEN tips / fares END AS tip_rate,
  CASE WHEN trips > 0 THEN airport_trips / trips END AS airport_share"""
cte("z_month", f"SELECT *, {RATIOS} FROM (SELECT month, {SUMMED} FROM x_daily GROUP BY month)")
cte("z_ewr", f"""SELECT *, {RATIOS} FROM (SELECT m.month, {SUMMED} FROM (SELECT DISTINCT month FROM x_daily) m
LEFT JOIN (SELECT * FROM x_daily WHERE borough = 'EWR' AND company = 'Lyft') d ON d.month = m.month GROUP BY m.month)""")
cte("z_company", f"SELECT month, company, {SUMMED} FROM x_daily GROUP BY ALL")


def zone_sql(month: str) -> str:
    return f"""
SELECT zone_id, coalesce(name, 'Zone ' || zone_id) AS zone, borough, trips::BIGINT AS trips, round(fares, 9) AS fares,
  round(CASE WHEN trips > 0 THEN fares / trips END, 9) AS avg_fare, round(CASE WHEN trips > 0 THEN driver_pay / trips END, 9) AS pay_per_trip,
  round(CASE WHEN wait_trips > 0 THEN wait_seconds / wait_trips / 60 END, 9) AS wait_minutes,
  round(CASE WHEN trips > 0 THEN miles / trips END, 9) AS miles, airport_trips::BIGINT AS airport_trips
FROM (SELECT zone_id, min(zone) AS name, min(borough) AS borough, {SUMMED} FROM x_zone_rows WHERE month = '{month}' GROUP BY zone_id)"""
