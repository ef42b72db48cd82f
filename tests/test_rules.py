import pytest

from veritally import Rule, RulePack, SameRecord
from veritally.operators import checks
from veritally.operators.duplicates import repeated_records
from veritally.packs.rideshare import RIDESHARE
from veritally.rules import registry_frame


def pack(*rules, keys=("k",)):
    return RulePack("test", rules, keys, {"validity": "?", "uniqueness": "?"})


def rule(id, **kw):
    return Rule(id, id, "validity", "error", "defect", id, **kw)


def test_registry_counts(spark):
    assert len(RIDESHARE.rules) == 45
    assert len(RIDESHARE.record_rules) == 37
    assert len(RIDESHARE.group_rules) == 2
    assert len(RIDESHARE.file_rules) == 6
    assert len(RIDESHARE.rollups) == 16
    verdicts = {v: sum(r.verdict == v for r in RIDESHARE.rules) for v in RIDESHARE.verdicts}
    assert verdicts == {"defect": 28, "business rule": 9, "documentation gap": 8}
    assert registry_frame(spark, RIDESHARE).count() == 45


@pytest.mark.parametrize("bad", [
    (rule("A", fails="x / y > 1"),),
    (rule("A", fails="x"), rule("A", fails="y")),
    (rule("@A", fails="x"),),
    (Rule("A", "A", "nowhere", "error", "defect", "A", fails="x"),),
    (rule("A", applies="x"),),
])
def test_bad_packs_are_refused(bad):
    with pytest.raises(ValueError):
        pack(*bad)


def test_quoted_slash_is_no_division():
    pack(rule("A", fails="x = 'a/b'"))


def test_null_predicate_is_no_failure(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("a", -1)], "k string, x int")
    p = pack(rule("NEG", fails="x < 0", applies="x IS NOT NULL"), rule("NOTPOS", fails="NOT x > 0"))
    rows = {r.rule: (r.failed, r.checked) for r in checks.check(df, p).collect()}
    assert rows == {"NEG": (1, 2), "NOTPOS": (1, 3), "@validity/defect": (1, 3), "@all/defect": (1, 3)}


COPIES = [("a", 1, 1, "x"), ("a", 1, 1, "x"), ("a", 1, 1, "y"), ("a", None, 1, "z"), ("a", None, 1, "z"), ("b", 5, 5, "x")]


def test_duplicates(spark):
    """Nulls match for the key and never for the whole record."""
    df = spark.createDataFrame(COPIES, "k string, p int, q int, r string")
    out = repeated_records(df, ("k",), ("p", "q"), ("r",)).collect()
    assert [(r.k, r.same_key, r.same_record) for r in out] == [("a", 3, 1)]


def test_copies_under_another_report_key_are_found(spark):
    """A copy counts where it is; with a scope, only copies in the same file are copies."""
    rows = [("jan", 1), ("feb", 1), ("feb", 1), ("mar", 2), (None, 2)]
    df = spark.createDataFrame(rows, "month string, id int")
    found = {r.month: r.same_key for r in repeated_records(df, ("month",), ("id",)).collect()}
    assert found == {"feb": 1, "jan": 1, "mar": 1}
    found = {r.month: r.same_key for r in repeated_records(df, ("month",), ("id",), scope=("month",)).collect()}
    assert found == {"feb": 1}


def test_hot_key_against_brute_force(spark):
    """A third of all rows share one key, some of them whole records."""
    rows = [("d", 0 if i % 3 == 0 else i, i % 7) for i in range(3000)]
    out = repeated_records(spark.createDataFrame(rows, "k string, p int, q int"), ("k",), ("p",), ("q",)).first()
    keys, whole = {}, {}
    for _, p, q in rows:
        keys[p] = keys.get(p, 0) + 1
        whole[p, q] = whole.get((p, q), 0) + 1
    assert out.same_key == sum(n - 1 for n in keys.values())
    assert out.same_record == sum(n - 1 for n in whole.values())


def test_group_sql_rule(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, x int")
    p = pack(
        rule("POS", fails="x < 0"), rule("TWICE", same=SameRecord(("x",))),
        rule("SQL", group_sql="SELECT k, count(*) AS failed FROM {records} WHERE x = 1 GROUP BY k"),
    )
    rows = {(r.k, r.rule): r.failed for r in checks.check(df, p).collect()}
    assert rows["a", "TWICE"] == 1 and rows["b", "TWICE"] == 0
    assert rows["a", "SQL"] == 2 and rows["b", "SQL"] == 0
