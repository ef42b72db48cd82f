import itertools
import random

from common import LONG, edge_docs

import compare
from tests.conftest import FOLDER
from veritally.llm import decontam, oracle, queries


def test_any_three_replaced_words_leave_a_seed():
    for gone in itertools.combinations(range(decontam.WINDOW), 3):
        assert any(
            all(start + place not in gone for place, mark in enumerate(mask) if mark == "1")
            for mask in decontam.MASKS
            for start in range(decontam.WINDOW - len(mask) + 1)
        )


def test_replaced_words_are_tolerated_and_clean_texts_left_alone(spark):
    rnd = random.Random(9)
    item = [f"q{i}" for i in range(20)]
    rows = [(k, " ".join(rnd.choices([f"w{i}" for i in range(50)] + item, k=80))) for k in range(30)]
    for k, changed in ((100, ()), (101, (2, 9, 14)), (102, tuple(range(0, 20, 2)))):
        words = [f"other{i}" if i in changed else w.upper() for i, w in enumerate(item)]
        rows.append((k, " ".join(["start"] * k + words + ["end"])))
    rows.append((103, " ".join(item[5:])))
    items = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, ""), (4, None), (None, " ".join(f"z{i}" for i in range(15)))], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = decontam.overlaps(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.n_equal, r.n_item) for r in found) == [(100, 1, 20, 20), (101, 1, 17, 20), (103, 1, 15, 20)]
    assert decontam.clean(docs, items).count() == len(rows) - 3
    assert decontam.clean(docs, items.limit(0)).count() == len(rows)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    items = spark.createDataFrame([(1, " ".join(LONG.split()[500:520]))], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontam.overlaps(docs, items).collect()) == [8, 9]
    assert decontam.clean(docs, items).columns == docs.columns
    assert decontam.overlaps(docs.limit(0), items).count() == 0


def test_query_against_sql(spark):
    con = compare.connect(FOLDER)
    own = queries.decontamination(spark, FOLDER).collect()
    assert sorted(map(tuple, own)) == sorted(con.execute(oracle.DECONTAMINATION).fetchall())


def test_a_fifth_of_a_short_item_may_be_replaced_anywhere(spark):
    """All placements for 9 to 14 words, laid over documents, for items of their own words."""
    rows, items = [], []
    for n in range(9, 15):
        item = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for gone in itertools.combinations(range(n), n - -(-8 * n // 10)):
            rows.append((len(rows), " ".join(["before"] + ["other" if i in gone else w for i, w in enumerate(item)] + ["after"]), n))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    found = decontam.overlaps(docs.drop("n"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, n) for k, _, n in rows]
