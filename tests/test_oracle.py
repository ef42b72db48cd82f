"""Registered queries against their SQL. Single rules are all part of quality_long."""

import pytest

import __spark_entry__ as registered
import compare
from oracle.base import query as oracle_query
from tests.conftest import FOLDER

# Queries of the optional part have their tests in their own folder.
OWN = [n for n in registered.queries() if not n.startswith("op") or n.startswith("ops_")]
OWN = [n for n in OWN if n != "pipeline"]
NAMES = [n for n in OWN if not n.startswith("rule_")] + ["rule_CNS_05", "rule_UNQ_01", "rule_INT_01"]


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    assert compare.compare(spark, con, FOLDER, name) is None


def test_every_query_has_sql():
    assert set(OWN) <= set(registered.oracle_sql())


def test_every_report_sql_has_a_query():
    """The other direction: SQL without a registered query is a report that was lost."""
    own = {n for n in registered.oracle_sql() if not n.startswith("op") or n.startswith("ops_")}
    assert own - set(OWN) == set()


def test_checked_trips_are_counted_once_published_or_not(spark, con):
    got = {n: registered.queries()[n](spark, FOLDER).collect() for n in ("rpt_total_checked", "rpt_checked_unpublished")}
    checked = con.execute(oracle_query("SELECT sum(checked) FROM x_quality WHERE rule = '@all/defect'")).fetchone()[0]
    assert sum(row.trips for rows in got.values() for row in rows) == checked
    assert [row.month for row in got["rpt_checked_unpublished"]] == ["1900-01"]


def test_lines_without_an_order_are_reconciled(spark, tmp_path):
    for table in ("customer", "lineitem"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{FOLDER}/{table}.parquet")
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    orders.where("o_orderkey % 5 <> 0").write.parquet(f"{tmp_path}/orders.parquet")
    rows = registered.queries()["star_revenue"](spark, str(tmp_path)).where("month = 'no order'").collect()
    assert [(row.company, row.status, row.value) for row in rows] == [("no order", "fail", None)]
