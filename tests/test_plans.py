import datetime as dt
import shutil

import pytest

from pyspark.sql import functions as F

from catalog import star as catalog_star
from veritally.functions import clock
from veritally.functions.measures import change, tone
from veritally.operators import checks, files, volume
from veritally.operators.duplicates import repeated_records
from veritally.operators.examples import example_records
from veritally.packs import rideshare, star
from veritally.plans import months
from veritally.rules import Rule, RulePack
from veritally.sources import readers, trip_fixture
from veritally.sources.store import TABLES, ResultStore, prefer
from tests.conftest import FOLDER

# Trips of twelve published months, and how far they are off the published totals.
# month, Uber, Lyft, Uber off the aggregate, both off the indicators (None: not published), lag
GOLDEN = [
    ("2025-09", 14047040, 5387601, 0, 71, 23),
    ("2025-10", 15470172, 5838529, 0, 76, 25),
    ("2025-11", 14908456, 5909784, 0, 100, 19),
    ("2025-12", 15973728, 6134710, 0, 44, 55),
    ("2026-01", 15245631, 5694742, 100927, 101739, 24),
    ("2026-02", 14166961, 5708725, 0, 166, 25),
    ("2026-03", 15956175, 6102183, 0, 556, 28),
    ("2026-04", 15378858, 5617095, 0, 63, 21),
    ("2026-05", 15354816, 6770928, 0, 114, 26),
    ("2026-06", 15257740, 5518128, None, -454232, 79),
    ("2026-07", 15215374, 5705875, None, 62, 48),
    ("2026-08", 14800058, 5693422, None, None, 31),
]


def test_golden_months(spark):
    ours = [(m, c, n) for m, u, l, *_ in GOLDEN for c, n in (("Uber", u), ("Lyft", l))]
    aggregate = [(m, c, n - (off if c == "Uber" else 0)) for m, u, l, off, _, _ in GOLDEN if off is not None
                 for c, n in (("Uber", u), ("Lyft", l))]
    overall = [(m, u + l - off) for m, u, l, _, off, _ in GOLDEN if off is not None]
    trips = spark.createDataFrame(ours, "month string, company string, trips bigint")
    by_company = spark.createDataFrame(aggregate, "month string, company string, total bigint")
    total = spark.createDataFrame(overall, "month string, total bigint")
    found = files.reconcile(trips, by_company, total, trips, ["Uber", "Lyft"], 0.005).collect()
    status = {(r.month, r.company): (r.status, r.value) for r in found}
    assert len(found) == 36
    assert status["2026-01", "Uber"][0] == "fail" and round(status["2026-01", "Uber"][1], 6) == 0.006664
    assert status["2026-01", "Both"][0] == "pass" and round(status["2026-01", "Both"][1], 6) == 0.004882
    assert status["2026-06", "Both"][0] == "fail" and round(status["2026-06", "Both"][1], 6) == -0.021396
    assert status["2026-06", "Uber"] == ("pending", None) and status["2026-08", "Both"] == ("pending", None)
    assert sum(s == "fail" for s, _ in status.values()) == 2
    present = {r.month: r.status for r in files.totals_present(by_company, trips, ["Uber", "Lyft"]).collect()}
    assert [m for m, s in sorted(present.items()) if s == "fail"] == ["2026-06", "2026-07", "2026-08"]
    facts = spark.createDataFrame([(g[0], dt.date(2026, 1, 1), g[5]) for g in GOLDEN] + [("2026-09", None, None)],
                                  "month string, published date, lag_days int")
    late = {r.month: r.status for r in files.published_late(facts, rideshare.PUBLICATION_LAG_DAYS).collect()}
    assert late["2026-06"] == "fail" and late["2026-09"] == "pending"
    assert sum(s == "pass" for s in late.values()) == 11


def test_clock_changes(spark):
    rows = [("2025-11-01 23:50:00", "2025-11-02 01:30:00"), ("2026-03-08 01:50:00", "2026-03-08 03:10:00"),
            ("2025-06-01 10:00:00.900", "2025-06-01 10:00:02.100")]
    df = spark.createDataFrame(rows, "a string, b string").select(F.expr("a::timestamp_ntz"), F.expr("b::timestamp_ntz"))
    out = df.toDF("a", "b").select(
        clock.seconds_between(F.col("a"), F.col("b")).alias("plain"),
        clock.local_seconds_between(F.col("a"), F.col("b"), rideshare.ZONE).alias("local"),
    ).collect()
    # The repeated hour is read as its second occurrence; the skipped hour is not lived through.
    assert [tuple(r) for r in out] == [(6000, 9600), (4800, 1200), (2, 2)]


def test_volume_median_of_even_count(spark):
    start = dt.date(2026, 1, 5)
    rows = [(start + dt.timedelta(days=7 * i), "2026-01", "Uber", n) for i, n in enumerate([100, 60, 105, 100])]
    totals = spark.createDataFrame(rows, "day date, month string, company string, trips bigint")
    causes = spark.createDataFrame([("2026-01-12", "storm")], "day string, cause string")
    out = {r.day: r for r in volume.volume_series(totals, causes, 0.25).collect()}
    assert (out["2026-01-12"].expected, out["2026-01-12"].flag, out["2026-01-12"].cause) == (100, "explained", "storm")
    # Two middle values, 100 and 105: 102.5 rounds to the even number.
    assert out["2026-01-05"].expected == 100 and out["2026-01-05"].flag is None


def test_schema_drift(spark):
    want = [("a", "int"), ("b", "string")]
    rows = [("2026-01", want), ("2026-02", want[::-1]), ("2026-03", [("A", "int"), ("b", "int")])]
    df = spark.createDataFrame(rows, "month string, schema array<struct<name:string,type:string>>")
    out = {r.month: (r.status, r.value) for r in files.schema_drift(df, want).collect()}
    assert out == {"2026-01": ("pass", 0.0), "2026-02": ("fail", 2.0), "2026-03": ("fail", 4.0)}


def test_kpi_change(spark):
    df = spark.createDataFrame([(110.0, 100.0), (1.0, 0.0), (1.0, None)], "v double, p double")
    moved = change(F.col("v"), F.col("p"))
    out = df.select(F.round(moved, 3).alias("m"), tone(moved, "down").alias("t")).collect()
    assert [tuple(r) for r in out] == [(0.1, "bad"), (None, None), (None, None)]


def test_examples_do_not_depend_on_partitions(spark):
    view = rideshare.trip_view(trip_fixture.trips(spark, FOLDER))
    pack = rideshare.RIDESHARE.only("VAL-03", "CNS-06", "RSN-03")
    one = example_records(view, pack).collect()
    other = example_records(view.repartition(7), pack).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, other)) and one


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_examples_are_the_first_by_order(spark):
    """All failing records of one hot group, ties and a group with fewer than n; one scan, cut before the shuffle."""
    rules = (rule_of("A", "v < 0"), rule_of("B", "v > 90"))
    pack = RulePack("p", rules, ("g",), {"d": ""}, sample_order="o")
    rows = [("hot", i * 37 % 101, i % 50, -i) for i in range(1, 300)] + [("cold", 5, 1, 95), ("cold", 5, 1, None)]
    df = spark.createDataFrame(rows, "g string, k int, o bigint, v int").repartition(5)
    found = example_records(df, pack, 3, ("g",))
    got = sorted((r.g, r.rule, r.rank, r.v) for r in found.collect())
    hot = sorted((o, v) for g, _, o, v in rows if g == "hot")[:3]
    assert got == [("cold", "B", 1, 95), *[("hot", "A", i + 1, v) for i, (_, v) in enumerate(hot)]]
    trips = spark.read.parquet(f"{FOLDER}/orders.parquet")
    keyed = RulePack("p", (rule_of("A", "o_totalprice > 1000", "o_orderkey"),), ("o_orderstatus",), {"d": ""})
    plan = _plan(example_records(trips, keyed, 3, ("o_orderstatus",)))
    assert plan.count("FileScan parquet") == 1 and plan.count("WindowGroupLimit") == 2


def test_examples_look_at_early_records_first(spark):
    """Rules done in a group are not evaluated there again; rare rules, small groups and null groups still get theirs."""
    rules = (rule_of("A", "v >= 0", "v"), rule_of("B", "v % 1000 = 7", "v"), rule_of("C", "v < 0", "v"))
    pack = RulePack("p", rules, ("g",), {"d": ""}, sample_order="pmod(v * 7919, 10007)", sample_span=(0, 10006))
    df = spark.range(9000).selectExpr("IF(id < 5, NULL, IF(id % 3000 = 11, 'small', IF(id % 2 = 0, 'x', 'y'))) as g", "id as v").repartition(5)
    first = example_records(df, pack, 3, ("g",))
    plain = example_records(df, RulePack("p", rules, ("g",), {"d": ""}, sample_order="pmod(v * 7919, 10007)"), 3, ("g",))
    assert sorted(map(repr, first.collect())) == sorted(map(repr, plain.collect()))
    assert "_done" in _plan(first) and "_done" not in _plan(plain)
    assert first.where("g IS NULL").count() == 3 and first.where("g = 'small' AND rule = 'A'").count() == 3


def rule_of(name, fails, *shows):
    return Rule(name, name, "d", "error", "defect", fails=fails, shows=shows or ("v",))


def test_copies_against_brute_force(spark):
    """Null keys match for the key alone; a hot key with different values; copies of a record on two days."""
    rows = [(i % 3, None if i % 7 == 0 else "hot", i % 5, i % 2) for i in range(120)] + [(0, f"one{i}", 1, 0) for i in range(30)]
    df = spark.createDataFrame(rows, "day int, k string, x int, y int")
    got = {r.day: (r.same_key, r.same_record) for r in repeated_records(df, ("day",), ("k",), ("x", "y")).collect()}
    expected = {}
    for at, columns in ((0, lambda r: r[1]), (1, lambda r: r[1:])):
        seen = set()
        for row in sorted(rows, key=lambda r: r[0]):
            if columns(row) in seen and (at == 0 or row[1] is not None):
                expected.setdefault(row[0], [0, 0])[at] += 1
            seen.add(columns(row))
    assert got == {day: tuple(counts) for day, counts in expected.items()}
    assert repeated_records(df.limit(0), ("day",), ("k",), ("x", "y")).count() == 0


def test_search_for_copies_does_not_shuffle_the_table(spark):
    """Whatever Spark takes the size of the hashes for, only records that occur twice meet."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        rows = spark.range(3000).selectExpr("id % 2990 as k", "id % 7 as day", "concat('text', id) as x").repartition(4)
        found = repeated_records(rows, ("day",), ("k",), ("x",))
        got = {r.day: (r.same_key, r.same_record) for r in found.collect()}
        plan = _plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(same for same, _ in got.values()) == 10 and not any(same for _, same in got.values())
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_rules_on_copied_lines_read_the_lines_alone(spark):
    """One join with the orders, and where an order occurs twice, the counts of the view all the same."""
    lines, orders, part = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("lineitem", "orders", "part"))
    twice = orders.unionByName(orders.where("o_orderkey % 5 = 0"))
    for heads, alone in ((orders, True), (twice, False)):
        records = star.line_records(lines, heads)
        assert (records is not None) == alone
        view = star.line_view(lines, heads, part)
        found = checks.check(view, star.LINES, records)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, checks.check(view, star.LINES).collect()))
    assert _plan(catalog_star.queries()["star_lines"](spark, FOLDER)).count("FileScan parquet [o_orderkey") == 1


def test_indicator_file(spark, tmp_path):
    path = tmp_path / "indicators.csv"
    path.write_text("Month/Year,License Class,Trips Per Day,Unique Drivers,Unique Vehicles,Trips Per Day Shared\n"
                    '2024-02,FHV - High Volume,"1,000","1","1","0"\n2024-02,Yellow,"5","1","1","0"\n'
                    '2023-12,FHV - High Volume,"7","1","1","0"\n')
    assert [tuple(r) for r in readers.read_indicators(spark, str(path)).collect()] == [("2024-02", 29000)]


def _table(spark, *rows):
    return spark.createDataFrame(rows, "month string, n int")


def _write(spark, store, run, tables, *rows):
    for table in tables:
        store.write(table, _table(spark, *rows), run)


def test_store_shows_finished_runs_only(spark, tmp_path):
    """Incremental runs add months; what a run did not write whole stays as it was or out of sight."""
    store = ResultStore(spark, str(tmp_path / "store"))
    first = store.new_run()
    _write(spark, store, first, TABLES, ("2026-01", 1), ("2026-02", 2))
    store.finish(first)
    second = store.new_run()
    _write(spark, store, second, TABLES[:2], ("2026-02", 3))
    assert sorted(map(tuple, store.read("daily").select("month", "n").collect())) == [("2026-01", 1), ("2026-02", 2)]
    _write(spark, store, second, TABLES[2:], ("2026-02", 3))
    assert [r.month for r in store.finish(second).collect()] == ["2026-02"]
    expected = [("2026-01", 1), ("2026-02", 3)]
    assert sorted(map(tuple, store.read("daily").select("month", "n").collect())) == expected
    # A month half written is not finished, also where another month of the run is.
    third = store.new_run()
    _write(spark, store, third, TABLES, ("2026-03", 4))
    _write(spark, store, third, TABLES[:1], ("2026-02", 9))
    assert [r.month for r in store.finish(third).collect()] == ["2026-03"]
    assert sorted(map(tuple, store.read("daily").select("month", "n").collect())) == [*expected, ("2026-03", 4)]
    assert store.retire(["2026-01"], confirmed=False) == []
    assert store.retire(["2026-01"], confirmed=True) == ["2026-01"]
    assert sorted(r.n for r in store.read("daily").collect()) == [3, 4]
    # A retired month can come back.
    again = store.new_run()
    _write(spark, store, again, TABLES, ("2026-01", 5))
    store.finish(again)
    assert sorted(r.n for r in store.read("daily").collect()) == [3, 4, 5]


def test_a_lost_file_is_an_error(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    run = store.new_run()
    _write(spark, store, run, TABLES, ("2026-01", 1), ("2026-02", 2))
    store.finish(run)
    shutil.rmtree(tmp_path / "store" / "daily" / "month=2026-01")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read("daily").collect()


def test_months(spark):
    published = spark.createDataFrame([("2026-02",), ("2025-01",)], "month string")
    window = months.window(published, 3)
    assert sorted(r.month for r in window.collect()) == ["2025-12", "2026-01", "2026-02"]
    done = spark.createDataFrame([("2026-01",), ("2024-01",)], "month string")
    assert sorted(r.month for r in months.choose(window, done).collect()) == ["2025-12", "2026-02"]
    assert [r.month for r in months.choose(window, done, cap=1).collect()] == ["2026-02"]
    assert [r.month for r in months.choose(window, done, explicit=["2020-01"]).collect()] == ["2020-01"]
    assert [r.month for r in months.stale(done, window, True).collect()] == ["2024-01"]
    assert months.stale(done, window, False).count() == 0


def test_primary_results_win(spark):
    out = prefer(_table(spark, ("2026-01", 1)), _table(spark, ("2026-01", 9), ("2026-02", 2)))
    assert sorted(map(tuple, out.collect())) == [("2026-01", 1), ("2026-02", 2)]
