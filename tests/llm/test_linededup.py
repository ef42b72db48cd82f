import random
import re

from common import TEXTS, edge_docs

import compare
from tests.conftest import FOLDER
from veritally.llm import linededup, oracle, queries


def brute(rows, least):
    """Text by (id, text): every run of at least so many words that begins earlier loses its later copies."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    lines = {d: [(n, v) for n, v in enumerate(d[1].split("\n")) if re.search(r"[^\x20\x09-\x0D]", v)] for d in docs}
    seen, gone = set(), {d: set() for d in docs}
    for d in docs:
        own = lines[d]
        for a in range(len(own)):
            total = 0
            for b in range(a, len(own)):
                total += len(re.findall(r"[^\x20\x09-\x0D]+", own[b][1]))
                run = tuple(v for _, v in own[a : b + 1])
                if total >= least:
                    if run in seen:
                        gone[d] |= {n for n, _ in own[a : b + 1]}
                    seen.add(run)
    return {d: ("\n".join(v for n, v in enumerate(d[1].split("\n")) if n not in gone[d]), len(gone[d])) for d in docs}


def test_against_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = ["one two", "three", "four five six", "", "  ", "seven eight nine ten", "x"]
    rows = [(k, "\n".join(rnd.choices(vocabulary, k=rnd.randint(0, 9)))) for k in range(40)]
    for least in (1, 4, 7):
        expected = brute(rows, least)
        for row in linededup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=least).collect():
            assert (row.text, row.removed_lines) == expected[row.doc_id, next(t for i, t in rows if i == row.doc_id)]


def test_a_long_run_of_short_lines_is_one_run(spark):
    run = "\n".join(f"line number {i}" for i in range(12))
    rows = [(1, f"first\n{run}"), (2, f"{run}\nlast"), (3, "line number 3\nalone")]
    found = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: rows[0][1], 2: "last", 3: rows[2][1]}


def test_edge_rows(spark):
    docs = edge_docs(spark)
    found = linededup.dedup(docs)
    assert found.columns == [c for c in docs.columns if c != "removed_lines"] + ["removed_lines"]
    rows = found.collect()
    assert len(rows) == len(TEXTS)
    assert {r.doc_id: r.text for r in rows if r.doc_id in (8, 9)} == {8: TEXTS[10][1], 9: ""}
    assert all(r.text is None for r in rows if r.doc_id == 5)
    assert linededup.dedup(docs.limit(0)).count() == 0


def test_query_against_sql(spark):
    con = compare.connect(FOLDER)
    own = queries.line_dedup(spark, FOLDER).select("doc_id", "removed_lines", "text").collect()
    assert sorted(map(tuple, own)) == sorted(con.execute(oracle.LINE_DEDUP).fetchall())
