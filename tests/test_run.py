"""Footers, scans of files that differ, the run over landed files, and runs that cross each other."""

import datetime as dt
import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from tests.test_plans import _table, _write
from veritally.operators import files
from veritally.packs import rideshare
from veritally.plans import cross_month, month_job, run as job
from veritally.sources import footers, readers, trip_fixture
from veritally.sources.store import TABLES, Conflict, ResultStore

MONTHS = ("1997-03", "1997-04", "1997-05")


def _file(folder, month, name="a", **columns):
    path = Path(folder) / f"file_month={month}"
    path.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path / f"{name}.parquet")


@pytest.fixture()
def mixed(tmp_path):
    """An int month, a double month, one of two files that differ, and one without a column."""
    when = pa.array([dt.datetime(2026, 1, 5)] * 2, pa.timestamp("us"))
    _file(tmp_path, "2026-01", a=pa.array([1, 2], pa.int32()), b=["x", "y"], c=when)
    _file(tmp_path, "2026-02", a=pa.array([3.5, None], pa.float64()), b=["x", "z"], c=when)
    _file(tmp_path, "2026-03", a=pa.array([5], pa.int64()), b=["p"], c=when[:1])
    _file(tmp_path, "2026-03", "b", B=["q", "r"], extra=pa.array([1, 2], pa.uint16()), a=["6", "seven"])
    _file(tmp_path, "2026-04", b=["only"])
    return str(tmp_path)


DECLARED = (("a", "int"), ("b", "string"), ("c", "timestamp_ntz"))


def test_footers_say_what_the_files_hold(spark, mixed):
    found = {Path(r.path).name + r.file_month: r for r in footers.footers(spark, mixed).collect()}
    assert len(found) == 5 and all(r.bytes == Path(r.path.removeprefix("file:")).stat().st_size and r.modified for r in found.values())
    schemas = {k: [tuple(c) for c in r.schema] for k, r in found.items()}
    assert schemas["a.parquet2026-01"] == [("a", "int"), ("b", "string"), ("c", "timestamp_ntz")]
    assert schemas["b.parquet2026-03"] == [("B", "string"), ("extra", "int"), ("a", "string")]
    months = {r.month: tuple(r) for r in footers.by_month(footers.footers(spark, mixed)).collect()}
    assert [(months[m][1], months[m][3]) for m in sorted(months)] == [(1, 2), (1, 2), (2, 3), (1, 1)]
    assert footers.footers(spark, mixed, ["2026-04"]).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        footers.footers(spark, mixed, ["2020-01"])


def test_a_file_that_is_not_parquet_is_named(spark, tmp_path):
    (tmp_path / "file_month=2026-01").mkdir()
    (tmp_path / "file_month=2026-01" / "broken.parquet").write_text("no parquet at all")
    with pytest.raises(Exception, match="broken.parquet"):
        footers.footers(spark, str(tmp_path)).collect()


def test_files_that_differ_are_read_together(spark, mixed):
    rows = readers.read_trips(spark, mixed, DECLARED).collect()
    assert sorted((r.file_month, r.a, r.b, r.c is None) for r in rows if r.a is not None) == [
        ("2026-01", 1, "x", False), ("2026-01", 2, "y", False), ("2026-02", 3, "x", False), ("2026-03", 5, "p", False), ("2026-03", 6, "q", True)]
    assert sorted((r.file_month, r.b) for r in rows if r.a is None) == [("2026-02", "z"), ("2026-03", "r"), ("2026-04", "only")]
    one = readers.read_trips(spark, mixed, DECLARED, ["2026-02"])
    assert len(one.inputFiles()) == 1 and one.count() == 2
    assert [f.dataType.simpleString() for f in one.schema] == ["int", "string", "timestamp_ntz", "string"]


def test_scans_are_pruned_and_pushed_down(spark, mixed, capsys):
    readers.read_trips(spark, mixed, DECLARED, ["2026-01"]).where("a > 1").select("b").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(a,1)" in plan and "ReadSchema: struct<a:int,b:string>" in plan


def test_drift_is_found_in_landed_files(spark, mixed):
    schemas = footers.month_schemas(footers.footers(spark, mixed))
    out = {r.month: (r.status, r.detail) for r in files.schema_drift(schemas, list(DECLARED)).collect()}
    assert out["2026-01"][0] == "pass"
    assert out["2026-02"] == ("fail", "a is double, expected int; the schema changed from the month before.")
    assert "other files: a is bigint, expected int" in out["2026-03"][1] and "extra is not documented" in out["2026-03"][1]
    assert out["2026-04"][1].startswith("a is missing; c is missing")


def test_codes_that_are_null_have_a_name(spark):
    counts = spark.createDataFrame([("m", None, 3), ("m", "", 1), ("m", "X", 2)], "month string, code string, rows bigint")
    out = files.undocumented_codes(counts, "code", spark.createDataFrame([("X",)], "code string"), counts).first()
    assert (out.status, out.value, out.detail) == ("fail", 4.0, "Not documented: (no code).")


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    """Three months of the fixture as files: one retyped with a column more, one without its last column."""
    base = tmp_path_factory.mktemp("landed")
    trips = trip_fixture.trips(spark, FOLDER).where(F.col("file_month").isin(*MONTHS)).checkpoint()
    for month in MONTHS:
        rows = trips.where(F.col("file_month") == month).drop("file_month")
        if month == MONTHS[1]:
            rows = rows.withColumn("trip_time", F.col("trip_time").cast("double")).withColumn("congestion_zone", F.lit(1))
        elif month == MONTHS[2]:
            rows = rows.drop("cbd_congestion_fee")
        rows.repartition(2).write.parquet(f"{base}/trips/file_month={month}")
    trip_fixture.zones(spark, FOLDER).write.csv(f"{base}/zones", header=True)
    for name, raw in trip_fixture.reference_files(month_job.company_trips(trips)).items():
        raw.write.csv(f"{base}/{name}", header=True)
    published = spark.createDataFrame([(m, dt.date(1997, 6, 30)) for m in (*MONTHS, "1997-06")], "month string, published date")
    causes = cross_month.causes_frame(spark, trip_fixture.CAUSES)
    return job.Landing(*[f"{base}/{n}" for n in ("trips", "zones", "aggregate", "indicators")], published, causes, "1990-01")


def _content(store):
    out = {table: sorted(map(repr, store.read(table).drop("last_modified").collect())) for table in TABLES}
    out |= {name: sorted(map(repr, store.published(name).collect())) for name in ("month_results", "volume")}
    return out


def test_a_run_that_is_lost_goes_on(spark, landing, tmp_path, monkeypatch):
    """Killed between two tables of the second month, and started again: the same store as of a run that went through."""
    whole = ResultStore(spark, str(tmp_path / "whole"))
    assert job.run(spark, landing, whole) == list(MONTHS)
    lost, write, calls = ResultStore(spark, str(tmp_path / "lost")), ResultStore.write, []

    def failing(self, *args, **kwargs):
        calls.append(args[0])
        if len(calls) == len(TABLES) + 3:
            raise KeyboardInterrupt
        write(self, *args, **kwargs)

    monkeypatch.setattr(ResultStore, "write", failing)
    with pytest.raises(KeyboardInterrupt):
        job.run(spark, landing, lost)
    monkeypatch.undo()
    again = ResultStore(spark, str(tmp_path / "lost"))
    assert sorted(again.finished()) == list(MONTHS[:1])
    assert job.run(spark, landing, again) == list(MONTHS[1:])
    assert _content(again) == _content(whole)
    assert job.run(spark, landing, again) == []
    _landed_results(spark, whole)
    assert job.run(spark, landing, again, explicit=[MONTHS[2]], keep=1, confirmed=True) == [MONTHS[2]]
    assert sorted(again.finished()) == [MONTHS[2]]


def _landed_results(spark, store):
    drift = {r.month: (r.status, r.detail) for r in store.published("month_results").where("rule = 'VAL-10'").collect()}
    assert drift[MONTHS[0]] == ("pass", "The schema is as documented.")
    assert "trip_time is double, expected bigint" in drift[MONTHS[1]][1] and "cbd_congestion_fee is missing" in drift[MONTHS[2]][1]
    facts = {r.month: r for r in store.read("facts").collect()}
    assert all(r.files == 2 and r.bytes > 0 and r.last_modified for r in facts.values())
    for month in MONTHS:
        lines = [line for f in Path(f"{store.base}/documents/month={month}").glob("part-*") for line in f.read_text().splitlines()]
        document = json.loads(lines[0])
        examples = store.read("examples", [month]).orderBy("rule", "rank").collect()
        assert len(lines) == 1 and document["rows"] == facts[month].rows and document["bytes"] == facts[month].bytes
        assert [(e["rule"], e["rank"], e["record"]) for e in document["examples"]] == [(e.rule, e.rank, e.record) for e in examples]


def test_of_two_runs_on_a_month_one_is_refused(spark, tmp_path):
    one, other = ResultStore(spark, str(tmp_path / "s")), ResultStore(spark, str(tmp_path / "s"))
    first, second = one.new_run(), other.new_run()
    _write(spark, one, first, TABLES, ("2026-01", 1))
    _write(spark, other, second, TABLES, ("2026-01", 2), ("2026-02", 2))
    one.finish(first)
    with pytest.raises(Conflict, match="2026-01"):
        other.finish(second)
    # The month of the other run alone is its own; the first run's month stays.
    seen = ResultStore(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, seen.read("daily").select("month", "n").collect())) == [("2026-01", 1), ("2026-02", 2)]
    # What no run finished is read where asked for, what is finished stays.
    third = seen.new_run()
    _write(spark, seen, third, ("daily",), ("2026-01", 9), ("2026-03", 9))
    assert sorted(map(tuple, seen.read_written("daily").select("month", "n").collect())) == [("2026-01", 1), ("2026-02", 2), ("2026-03", 9)]
    # A marker that was created and never written does not hide the version before, and the next run passes it.
    (tmp_path / "s" / "finished" / "month=2026-01" / "v00000002").write_text("")
    late = ResultStore(spark, str(tmp_path / "s"))
    assert late.finished()["2026-01"] == first
    fourth = late.new_run()
    _write(spark, late, fourth, TABLES, ("2026-01", 4))
    late.finish(fourth)
    assert ResultStore(spark, str(tmp_path / "s")).finished()["2026-01"] == fourth


def _numbers(store, table="daily"):
    return sorted(map(tuple, store.read(table).select("month", "n").collect()))


def test_months_are_packed_into_few_files(spark, tmp_path):
    base = str(tmp_path / "s")
    store = ResultStore(spark, base)
    assert store.compact() == []
    first, months = store.new_run(), [f"{2020 + i // 6}-{i % 6 + 1:02d}" for i in range(8)]
    _write(spark, store, first, [t for t in TABLES if t != "examples"], *[(m, i) for i, m in enumerate(months)])
    store.finish(first)
    before, late = _numbers(store), store.new_run()
    _write(spark, store, late, TABLES, (months[3], 99))
    assert store.compact() == months and store.compact() == []
    seen = ResultStore(spark, base)
    assert _numbers(seen) == before and len(seen.read("daily").inputFiles()) == 1
    one = seen.read("daily", [months[4]])
    assert one.count() == 1 and "PushedFilters: [IsNotNull(month)" in one._jdf.queryExecution().executedPlan().toString()
    # A run that began before the months were packed is refused, and its rows are not seen.
    with pytest.raises(Conflict):
        store.finish(late)
    assert _numbers(ResultStore(spark, base)) == before
    # Nothing young is deleted; then only what no month names.
    assert seen.clean(grace=3600) == []
    assert len(seen.clean(grace=-1)) == 5 * 8 + 6 and _numbers(ResultStore(spark, base)) == before
    assert sorted(map(tuple, seen.read_written("facts").select("month", "n").collect())) == before
    # A month computed again leaves the packed files, and comes back to new ones; the old ones go then.
    again = seen.new_run()
    _write(spark, seen, again, TABLES, (months[0], 7))
    seen.finish(again)
    after = [(months[0], 7), *before[1:]]
    assert _numbers(seen) == after and len(seen.read("daily").inputFiles()) == 2
    assert seen.clean(grace=-1) == [] and seen.compact(target=1) == months
    assert _numbers(seen) == after and len(seen.read("daily").inputFiles()) > 1
    assert _numbers(seen, "examples") == [(months[0], 7)]
    assert seen.retire([months[1]], confirmed=True) == [months[1]] and _numbers(seen) == [after[0], *after[2:]]
    assert any("packed" in path for path in seen.clean(grace=-1)) and _numbers(seen) == [after[0], *after[2:]]


def test_totals_by_base_and_month(spark):
    rows = spark.createDataFrame([("UBER", 2023, 12, 5, 0, 0), ("UBER", 2024, 1, 7, 0, 0), ("VIA", 2024, 2, 9, 0, 0)], readers.AGGREGATE)
    got = readers.aggregate_totals(rows, "2024-01", ["UBER", "LYFT"]).collect()
    assert [tuple(r) for r in got] == [("2024-01", "Uber", 7)]
    assert readers.aggregate_totals(rows).count() == 3
