"""Queries over trips: rules, examples, summaries, file facts and rules over files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import Inputs, Query, keyed, landed, results, rounded
from oracle import trips as sql
from oracle.base import query
from oracle import reports as rsql
from veritally.functions.measures import MEASURES
from veritally.operators import checks, files, volume
from veritally.packs import rideshare
from veritally.packs.rideshare import RIDESHARE
from veritally.plans import cross_month, month_job, months
from veritally.sources import footers, readers, trip_fixture
from veritally.sources.store import complete_months, documents, prefer, read_documents, write_documents

TRIP_RULES = [r.id for r in RIDESHARE.rules if r.grain == "trip"]
DAILY = ["day", "month", "company", "borough", *MEASURES]
ZONES = ["month", "company", "zone_id", "zone", "borough", *MEASURES]


def _rule(rule: str) -> Query:
    def run(spark, d):
        i = Inputs(spark, d)
        # Only the zone rule needs the lookup.
        view = i.view if rule == "INT-01" else rideshare.trip_view(i.trips)
        return keyed(checks.rule_result(view, RIDESHARE, rule))
    return run


def _frame(spark, d) -> DataFrame:
    frame = keyed(checks.check_frame(Inputs(spark, d).view, RIDESHARE))
    names = checks._denominators(RIDESHARE)
    kept = [F.col(f"`{c}`") for c in frame.columns if c not in names.values()]
    checked = [F.col(names[r.applies]).alias(f"{r.id}:checked") for r in RIDESHARE.record_rules if r.applies]
    return frame.select(*kept, *checked)


def _rollups(spark, d) -> DataFrame:
    frame = checks.check_frame(Inputs(spark, d).view, RIDESHARE)
    return keyed(checks.long_results(frame, RIDESHARE)).where(F.col("rule").startswith("@"))


def _quality(spark, d) -> DataFrame:
    i = Inputs(spark, d)
    return month_job.quality(i.trips, i.zones)


def _failed_totals(spark, d) -> DataFrame:
    return checks.failed_totals(_quality(spark, d), ("month",))


def _examples(spark, d) -> DataFrame:
    i = Inputs(spark, d)
    return month_job.example_table(i.trips, i.zones).withColumn("day", F.col("day").cast("string"))


def _grain(name: str, pick) -> Query:
    def run(spark, d):
        i = Inputs(spark, d)
        return rounded(pick(month_job.one_grain(i.trips, i.zones, name), i.zones))
    return run


def _grains(spark, d) -> DataFrame:
    i = Inputs(spark, d)
    return month_job.summary(i.trips, i.zones).groupBy("grain").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("trips").alias("trips"), F.sum("wait_trips").alias("wait_trips")
    )


def _facts(spark, d) -> DataFrame:
    def text(column: str):
        pairs = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
        return F.array_join(pairs, ",")

    return Inputs(spark, d).facts().select(
        "month", "rows", text("rows_by_license").alias("rows_by_license"), text("trips").alias("trips"),
        F.col("published").cast("string").alias("published"), "lag_days", F.size("schema").alias("columns"),
    )


def _landed(spark, d) -> DataFrame:
    """Rows of the landed files by their footers, and whether listing and scan agree on their bytes."""
    base = landed(spark, d)
    scanned = readers.landed_files(spark.read.schema("file_month string").parquet(base)).select("month", F.col("bytes").alias("scanned"), F.col("rows").alias("read"))
    found = footers.by_month(footers.footers(spark, base)).join(scanned, "month", "full")
    return found.select("month", "rows", (F.col("rows") == F.col("read")).alias("same_rows"), (F.col("bytes") == F.col("scanned")).alias("same_bytes"))


def _published_footers(spark, d) -> DataFrame:
    found = footers.footers(spark, landed(spark, d))
    return found.where(F.col("file_month") != trip_fixture.NO_MONTH)


def _columns(spark, d) -> DataFrame:
    """Each month's columns, in file order, from the footers."""
    schemas = footers.month_schemas(_published_footers(spark, d))
    return schemas.select("month", F.posexplode("schema").alias("at", "c")).select("month", (F.col("at") + 1).cast("bigint").alias("position"), "c.name", "c.type")


def _landed_drift(spark, d) -> DataFrame:
    return rounded(files.schema_drift(footers.month_schemas(_published_footers(spark, d)), list(rideshare.SCHEMA)))


def _documents(spark, d) -> DataFrame:
    """The months' JSON documents, written and read again."""
    store = results(spark, d)
    path = f"{store.base}/documents-{uuid.uuid4().hex}"
    write_documents(documents(store.read("facts"), results(spark, d, "examples").read("examples")), path)
    read = read_documents(spark, path, "month string, rows bigint, lag_days int, examples array<struct<rule:string,rank:int,company:string,day:string,record:string>>")
    rules = F.array_distinct(F.transform("examples", lambda e: e["rule"]))
    return read.select("month", "rows", "lag_days", F.size("examples").cast("bigint").alias("examples"), F.size(rules).cast("bigint").alias("rules"))


def _file_rule(rule: str) -> Query:
    def run(spark, d):
        i = Inputs(spark, d)
        months_ = i.published().select("month")
        companies = cross_month.COMPANIES
        if rule == "ACC-02":
            ours = month_job.company_trips(i.trips)
            out = files.reconcile(ours, i.aggregate(), i.indicators(), months_, companies, rideshare.RECONCILE_TOLERANCE)
        elif rule == "TML-02":
            out = files.totals_present(i.aggregate(), months_, companies)
        elif rule == "RSN-01":
            out = volume.volume_rule(_series(spark, d), months_, companies)
        elif rule == "TML-01":
            out = files.published_late(i.facts(), rideshare.PUBLICATION_LAG_DAYS)
        elif rule == "INT-03":
            documented = spark.createDataFrame([(c,) for c in rideshare.LICENSES], "hvfhs_license_num string")
            out = files.undocumented_codes(month_job.licence_counts(i.trips), "hvfhs_license_num", documented, months_)
        else:
            out = files.schema_drift(trip_fixture.schemas(months_, rideshare.SCHEMA), list(rideshare.SCHEMA))
        return rounded(out)
    return run


def _daily(spark, d) -> DataFrame:
    i = Inputs(spark, d)
    trips = month_job.summary_trips(i.trips, i.zones)
    return trips.groupBy("day", "month", "company", "borough").agg(F.count(F.lit(1)).alias("trips"))


def _series(spark, d) -> DataFrame:
    return cross_month.volume_series(_daily(spark, d), Inputs(spark, d).causes)


def _all_months(spark, d) -> DataFrame:
    return Inputs(spark, d).published().select("month")


def _done(spark, d) -> DataFrame:
    """A past run that computed two months of three."""
    return _all_months(spark, d).where(F.substring("month", 6, 2).cast("int") % 3 != 0)


def _window(spark, d) -> DataFrame:
    return months.window(_all_months(spark, d), rideshare.KEEP_MONTHS)


def _precedence(spark, d) -> DataFrame:
    """Licence counts of the even months as primary, of all months as cached ones one row higher."""
    counts = month_job.licence_counts(Inputs(spark, d).trips)
    primary = counts.where(F.substring("month", 6, 2).cast("int") % 2 == 0)
    return prefer(primary, counts.withColumn("rows", F.col("rows") + 1))


def _complete(spark, d) -> DataFrame:
    i = Inputs(spark, d)
    return complete_months([month_job.licence_counts(i.trips), _daily(spark, d), i.facts(), _done(spark, d)])


def _later_column(spark, d) -> DataFrame:
    """Landed files whose columns differ, read as one."""
    trips = readers.read_trips(spark, landed(spark, d), rideshare.SCHEMA)
    return trips.groupBy(F.col("file_month").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("cbd_congestion_fee").alias("with_fee"), F.count_if(F.col("tips") > 0).alias("tipped"),
        F.sum("trip_time").alias("seconds"), F.count("originating_base_num").alias("bases"),
    )


def _derived(spark, d) -> DataFrame:
    """The columns the trip view adds, summed up by company and hour."""
    return Inputs(spark, d).view.groupBy("company", F.hour("pickup_datetime").alias("hour")).agg(
        F.sum("elapsed").alias("elapsed"), F.sum("elapsed_ny").alias("elapsed_ny"),
        F.count_if("fall_back").alias("fall_back"), F.count_if("touches_airport").alias("airport"),
        F.count_if(~F.col("pu_known")).alias("unknown"),
    )


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"rule_{r.replace('-', '_')}": _rule(r) for r in TRIP_RULES}
    out |= {
        "trip_view": _derived,
        "quality_frame": _frame,
        "quality_long": _quality,
        "quality_rollups": _rollups,
        "rule_failed_totals": _failed_totals,
        "examples_by_rule": _examples,
        "summary_grains": _grains,
        "summary_daily": _grain("daily", lambda g, z: month_job.daily(g)),
        "summary_hourly": _grain("hourly", lambda g, z: month_job.hourly(g)),
        "summary_zones": _grain("zones", month_job.zone_totals),
        "file_rows_by_license": lambda s, d: month_job.licence_counts(Inputs(s, d).trips),
        "file_trips_by_company": lambda s, d: month_job.company_trips(Inputs(s, d).trips),
        "file_facts": _facts,
        "file_landed": _landed,
        "file_schema_evolution": _later_column,
        "file_columns": _columns,
        "file_drift": _landed_drift,
        "file_documents": _documents,
        "reference_aggregate": lambda s, d: Inputs(s, d).aggregate(),
        "reference_indicators": lambda s, d: Inputs(s, d).indicators(),
        "volume_series": lambda s, d: _series(s, d),
        "months_window": _window,
        "months_missing": lambda s, d: months.missing(_window(s, d), _done(s, d)),
        "months_newest": lambda s, d: months.choose(_window(s, d), _done(s, d), cap=3),
        "months_stale": lambda s, d: months.stale(_done(s, d), _window(s, d), True),
        "months_complete": _complete,
        "months_precedence": _precedence,
    }
    out |= {f"month_{r.replace('-', '_')}": _file_rule(r) for r in rsql.MONTH_RULES}
    return out


_WINDOW = """SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(last - INTERVAL 11 MONTH, last, INTERVAL 1 MONTH)) AS m
FROM (SELECT max((month || '-01')::DATE) AS last FROM y_published))"""
_DONE = "SELECT month FROM y_published WHERE month[6:7]::INT % 3 <> 0"


def oracle() -> dict[str, str]:
    out = {f"rule_{r.replace('-', '_')}": query(sql.rule_query(r)) for r in TRIP_RULES}
    long = "SELECT file_month AS month, company, day::VARCHAR AS day, rule, failed, checked FROM x_predicates"
    out |= {
        "trip_view": query("""SELECT company, hour(pickup_datetime)::INT AS hour, sum(elapsed)::BIGINT AS elapsed, sum(elapsed_ny)::BIGINT AS elapsed_ny,
            count(*) FILTER (WHERE fall_back) AS fall_back,
            count(*) FILTER (WHERE PULocationID IN (1, 132, 138) OR DOLocationID IN (1, 132, 138)) AS airport,
            count(*) FILTER (WHERE PULocationID NOT IN (SELECT zone_id FROM x_zones)) AS unknown FROM x_trips GROUP BY ALL"""),
        "quality_frame": query(sql.frame_query()),
        "quality_long": query("SELECT * FROM x_quality"),
        "quality_rollups": query(f"{long} WHERE rule LIKE '@%'"),
        "rule_failed_totals": query(
            "SELECT month, rule, sum(failed)::BIGINT AS failed FROM x_quality WHERE rule[1] <> '@' GROUP BY ALL"),
        "examples_by_rule": query("SELECT * REPLACE (record::VARCHAR AS record) FROM x_examples"),
        "summary_grains": query("""SELECT 'daily' AS grain, count(*) AS rows, sum(trips)::BIGINT AS trips, sum(wait_trips)::BIGINT AS wait_trips FROM x_daily
            UNION ALL SELECT 'hourly', count(*), sum(trips)::BIGINT, sum(wait_trips)::BIGINT FROM x_hourly
            UNION ALL SELECT 'zones', count(*), sum(trips)::BIGINT, sum(wait_trips)::BIGINT FROM x_zone_rows"""),
        "summary_daily": query(sql.rounded(DAILY, "x_daily")),
        "summary_hourly": query(sql.rounded(["month", "company", "borough", "dow", "hour", *month_job.HOURLY], "x_hourly")),
        "summary_zones": query(sql.rounded(ZONES, "x_zone_rows")),
        "file_rows_by_license": query("SELECT * FROM y_licences"),
        "file_trips_by_company": query("SELECT * FROM y_company_trips"),
        "file_facts": query("""SELECT l.month, sum(rows)::BIGINT AS rows,
            string_agg(hvfhs_license_num || ':' || rows, ',' ORDER BY hvfhs_license_num) AS rows_by_license,
            string_agg(CASE hvfhs_license_num WHEN 'HV0003' THEN 'Uber:' || rows WHEN 'HV0005' THEN 'Lyft:' || rows END, ','
              ORDER BY hvfhs_license_num DESC) AS trips,
            g.published::VARCHAR AS published, g.lag_days, len(s.fields)::INT AS columns
            FROM y_licences l JOIN y_lag g USING (month) JOIN y_schema s USING (month) GROUP BY l.month, g.published, g.lag_days, s.fields"""),
        "file_landed": query("SELECT file_month AS month, count(*) AS rows, true AS same_rows, true AS same_bytes FROM x_raw GROUP BY ALL"),
        "file_schema_evolution": query("""SELECT file_month AS month, count(*) AS rows,
            count(CASE WHEN file_month <> (SELECT min(month) FROM y_published) THEN cbd_congestion_fee END) AS with_fee,
            count(*) FILTER (WHERE tips > 0) AS tipped, sum(trip_time)::BIGINT AS seconds, count(originating_base_num) AS bases FROM x_raw GROUP BY ALL"""),
        "file_columns": query("SELECT month, position, name, type FROM y_fields"),
        "file_drift": query("SELECT rule, month, company, status, round(value, 6) AS value, detail FROM y_val_10"),
        "file_documents": query("""SELECT l.month, l.rows, g.lag_days, coalesce(e.n, 0) AS examples, coalesce(e.rules, 0) AS rules
            FROM (SELECT month, sum(rows)::BIGINT AS rows FROM y_licences GROUP BY month) l JOIN y_lag g USING (month)
            LEFT JOIN (SELECT month, count(*) AS n, count(DISTINCT rule) AS rules FROM x_examples GROUP BY month) e USING (month)"""),
        "reference_aggregate": query("SELECT month, company, total::BIGINT AS total FROM y_aggregate"),
        "reference_indicators": query("SELECT month, total::BIGINT AS total FROM y_indicators"),
        "volume_series": query("SELECT * FROM y_volume"),
        "months_window": query(_WINDOW),
        "months_missing": query(f"{_WINDOW} EXCEPT {_DONE}"),
        "months_newest": query(f"SELECT * FROM ({_WINDOW} EXCEPT {_DONE}) ORDER BY month DESC LIMIT 3"),
        "months_stale": query(f"{_DONE} EXCEPT {_WINDOW}"),
        "months_complete": query(f"SELECT DISTINCT month FROM x_daily WHERE month IN ({_DONE})"),
        "months_precedence": query("SELECT month, hvfhs_license_num, rows + month[6:7]::INT % 2 AS rows FROM y_licences"),
    }
    out |= {
        f"month_{r.replace('-', '_')}": query(
            f"SELECT rule, month, company, status, round(value, 6) AS value, detail FROM y_{r.lower().replace('-', '_')}")
        for r in rsql.MONTH_RULES
    }
    return out
