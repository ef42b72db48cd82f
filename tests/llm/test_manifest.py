"""The manifest against a tree built level by level, at block sizes that make several levels."""

import hashlib
import zlib

import pytest

from tests.conftest import FOLDER
from tests.llm.common import edge_docs
from veritally.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, place):
    for level in levels[:-1]:
        other = place ^ 1
        yield (other < place, level[other]) if other < len(level) else None
        place >>= 1


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        leaf = h(*map(field, row))
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
        changed = h(*map(field, (*row[:3], row[3] + 1, row[4]))) if hit else leaf
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf, changed, row[0]))
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    trees = {name: tree([r[2] for r in sorted(groups[name])]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for number, name in enumerate(names):
        for place, (_, _, leaf, changed, doc_id) in enumerate(sorted(groups[name])):
            path = [*siblings(trees[name], place), *siblings(top, number)]
            now = changed
            for step in path:
                now = h(now) if step is None else h(step[1], now) if step[0] else h(now, step[1])
            root = top[-1][0]
            out.append((doc_id, leaf, trees[name][-1][0], root, h(*[s[1] for s in path if s]), now, now == root))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, manifest.verify(df).collect()), key=repr)


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("bits", [2, 12])
def test_whole_table(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest, "BITS", bits)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = brute(plain(docs))
    assert got(docs) == expected
    assert {row[-1] for row in expected} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 15, 16, 17, 33])
def test_sizes(spark, monkeypatch, n):
    """One tree of each size, blocks of four."""
    monkeypatch.setattr(manifest, "BITS", 2)
    docs = spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "repeat('é', int(id)) AS text")
    assert got(docs) == brute(plain(docs))


def test_edge_rows(spark):
    docs = edge_docs(spark)
    assert got(docs) == brute(plain(docs))
    clashing = docs.selectExpr("*", "'x' AS tree", "1 AS place", "2 AS total", "'y' AS node", "'z' AS path", "3 AS block", "'r' AS whole")
    assert got(clashing) == got(docs)


def test_starts_are_joined_where_they_are_many(spark, monkeypatch):
    from veritally.llm import ranked

    monkeypatch.setattr(ranked, "MOST_STARTS", 0)
    docs = edge_docs(spark)
    assert got(docs) == brute(plain(docs))
    most = spark.sql("SELECT 9223372036854775807 AS n_chars, 1L AS doc_id, 'a' AS source, null AS lang, 't' AS text")
    assert got(most.withColumn("doc_id", most.doc_id + 12)) == brute(plain(most.withColumn("doc_id", most.doc_id + 12)))


def test_appends_extend_every_witness():
    """After each append, witnesses closed at any height prove every leaf so far."""
    for n in range(1, 20):
        grown = manifest.OpenTree(n, (n - 1).bit_length())
        leaves = [h(str(i)) for i in range(n)]
        for leaf in leaves:
            grown.append(leaf)
        height = (n - 1).bit_length()
        assert grown.close(height) == tree(leaves)[-1][0]
        assert len(grown.witnesses(height)) == n
