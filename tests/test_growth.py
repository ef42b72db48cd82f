"""What a query costs as tables grow: the passes a report runs, and how often rows cross the network."""

import shutil

import pyarrow.parquet as pq
import pytest

from catalog import common, reports
from tests.conftest import FOLDER
from veritally.operators import checks
from veritally.plans import month_job
from veritally.sources import footers, trip_fixture


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _copy(tmp_path, files=1):
    """A folder of its own, with lineitem in so many files."""
    for name in ("orders", "part", "lineitem"):
        if name != "lineitem" or files == 1:
            shutil.copy(f"{FOLDER}/{name}.parquet", tmp_path)
    if files > 1:
        lines = pq.read_table(f"{FOLDER}/lineitem.parquet")
        (tmp_path / "lineitem.parquet").mkdir()
        for i in range(files):
            a, b = len(lines) * i // files, len(lines) * (i + 1) // files
            pq.write_table(lines.slice(a, b - a), tmp_path / "lineitem.parquet" / f"{i:03d}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("report, unread", [("rpt_selected_months", ("quality", "example_table")), ("rpt_rules_shown", ("example_table",))])
def test_a_report_runs_the_passes_it_reads(spark, tmp_path, monkeypatch, report, unread):
    """Months and rows are those of the whole job all the same."""
    whole = sorted(map(tuple, reports.queries()[report](spark, FOLDER).collect()))

    def refused(*_):
        raise AssertionError("a table that the report does not read")

    for name in unread:
        monkeypatch.setattr(month_job, name, refused)
    assert sorted(map(tuple, reports.queries()[report](spark, _copy(tmp_path)).collect())) == whole and whole


def test_passes_finish_the_same_months(spark):
    """The month of misfiled rows has quality rows, but none of the other tables, and stays unfinished in each store."""
    stores = {name: common.results(spark, FOLDER, name) for name in common.PASSES}
    months = {name: sorted(store.finished()) for name, store in stores.items()}
    assert len(set(map(tuple, months.values()))) == 1 and trip_fixture.NO_MONTH not in months["quality"]
    assert trip_fixture.NO_MONTH in {r.month for r in stores["quality"].read_written("quality").select("month").distinct().collect()}


def test_lines_are_dealt_out_only_where_few_tasks_read_them(spark, tmp_path):
    few, many = trip_fixture.trips(spark, FOLDER), trip_fixture.trips(spark, _copy(tmp_path, 64))
    assert "Exchange" in _plan(few) and "Exchange" not in _plan(many)
    assert few.exceptAll(many).count() == 0 and few.count() == many.count()


def test_landing_keeps_no_second_copy(spark, tmp_path, monkeypatch):
    """Files hold every trip with its month's columns; the trips are not written a first time to be read for that."""
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda *_: pytest.fail("trips are kept before they are written"))
    folder = _copy(tmp_path)
    found = footers.footers(spark, common.landed(spark, folder)).collect()
    assert sum(r.rows for r in found) == trip_fixture.trips(spark, folder).count()
    assert len({tuple(c.name for c in r.schema) for r in found}) == 4
    plan = _plan(trip_fixture.trips(spark, folder, trip_fixture.lines_by_month(spark, folder)).where("file_month = '1997-03'"))
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Filter")
