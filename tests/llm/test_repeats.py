import collections
import random
import re

import pyarrow as pa
from common import TEXTS, edge_docs, words

from veritally.llm import repeats


def brute(text, limits):
    own = words(text, lower=False)
    n = len(own)
    three = collections.Counter(tuple(own[i : i + 3]) for i in range(n - 2))
    again = {i + k for i in range(n - 2) if three[tuple(own[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and own[i + k] == own[j + k]:
                k += 1
            best = max(best, k)
        if best >= limits.shortest:
            longest = max(longest, best)
            covered |= set(range(i, i + best))
    failed = n < 50 or 100 * len(again) > 50 * n
    kept = not failed and len(covered) <= limits.most_covered * n and longest <= limits.longest
    return [n, sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed, kept, len(covered), longest]


def test_measures_against_brute_force():
    rnd, limits = random.Random(2), repeats.Limits(longest=20)
    for _ in range(60):
        texts = []
        for _ in range(rnd.randint(0, 12)):
            vocabulary = rnd.choice([["a"], ["a", "bé"], ["a", "bé", "#x", "d<", "e"], [f"w{i}" for i in range(30)]])
            texts.append(None if rnd.random() < 0.1 else "".join(rnd.choice(vocabulary) + rnd.choice([" ", "\n", "  ", "\x0b"]) for _ in range(rnd.randint(0, 80))))
        columns = [x.to_pylist() for x in repeats.measure(pa.array(texts, pa.string()), limits)]
        for i, text in enumerate(texts):
            assert [column[i] for column in columns] == brute(text, limits), text


def test_edge_rows(spark):
    rows = repeats.judge(edge_docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        if len(row.text or "") < 1000:
            assert [row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")] == brute(row.text, repeats.Limits())
    assert repeats.judge(edge_docs(spark).limit(0)).count() == 0
