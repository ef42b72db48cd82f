"""Collocations against counting every phrase in plain Python, at settings that use each path."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings as checks, strategies as st

from tests.conftest import FOLDER
from tests.llm.common import edge_docs
from veritally.llm import phrases

SMALL = phrases.Settings(least=3, chunk_words=40, merged=2, told=2, strip_words=1000)


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, most, longest=5):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            sizes[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(a, inside.get(p[i:j], 0))
        found = []
        for p, a in often.items():
            score, _, left, right = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if inside.get(p, 0) < a:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def got(df, most, settings):
    return sorted(tuple(r) for r in phrases.mine(df, most, settings).collect())


def plain(df):
    return [(r.lang, r.text) for r in df.select("lang", "text").collect()]


@pytest.mark.parametrize("settings", [phrases.Settings(least=20), phrases.Settings(least=5, chunk_words=3000, merged=2, told=3, strip_words=2000)])
def test_whole_table(spark, settings):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = brute(plain(docs), settings.least, 2000)
    assert {len(r[2].split(" ")) for r in expected} >= {2, 3}
    assert got(docs, 2000, settings) == expected


def test_edge_rows(spark):
    docs = edge_docs(spark)
    expected = brute(plain(docs), 3, 50)
    assert got(docs, 50, SMALL) == expected
    clashing = docs.selectExpr("*", "1 AS chunk", "2 AS route", "'a' AS keys", "'b' AS phrase", "3 AS m", "4 AS a", "5 AS place", "6 AS n")
    assert got(clashing, 50, SMALL) == expected
    assert got(docs.limit(0), 50, SMALL) == []
    assert got(docs, 50, phrases.Settings(least=10**9)) == []


def test_one_hot_phrase_without_separators(spark):
    """Overlaps count, a piece is longer than a chunk, and one pair holds nearly all rows."""
    docs = spark.createDataFrame([("en", "a b " * 500)] * 3 + [(None, "x\ty\u000bx y, y! X Y é é")] * 4 + [("und", "x y")] * 2, "lang string, text string")
    assert got(docs, 50, SMALL) == brute(plain(docs), 3, 50)


def test_dense_and_sparse_tiles_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    assert got(docs, 100, SMALL) == brute(plain(docs), 3, 100)
    keys = phrases.np.arange(2000, dtype="int64") * 7919 % 1500 << phrases.WORD_BITS | phrases.np.arange(2000) * 613 % 90_000
    route, short = phrases._routes(keys, 5)
    assert (route >= 0).any() and (route < 0).any()
    assert [int(phrases.whole_keys(int(r), k)) for r, k in zip(route, short)] == keys.tolist()


@checks(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é.\t\n,\x0b\x0c\r\x00 ", max_size=12), max_size=6))
def test_split(texts):
    words, first = phrases.split(pa.array(texts, pa.string()))
    expected = [(word, i == 0) for text in texts for piece in pieces(text) for i, word in enumerate(piece)]
    assert [(w.decode(), bool(f)) for w, f in zip(words.to_pylist(), first)] == expected


def test_quotients_are_exact_beyond_64_bits(spark):
    big = 9_999_999_999_989
    rows = [("en", "a b", big - 2, 2), ("en", "a", big - 1, 1), ("en", "b", big, 1)]
    out = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, a bigint, m int"), spark.createDataFrame([("en", 10**13 + 7)], "lang string, n bigint")).first()
    assert out.score == 1000 * (big - 2) * (10**13 + 7) // ((big - 1) * big)
