from collections import Counter

import pyarrow as pa
from common import TEXTS, edge_docs

from veritally.llm import langid, text


def grams(value):
    chars = "".join(c if c.isalpha() else " " for c in (value or "").lower())
    chars = " " + " ".join(chars.split()) + " " if chars.strip() else " "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            g = chars[i : i + n]
            if g.strip() and " " not in g[1:-1]:
                out[g] += 1
    return out


def ranked(counts, length):
    key = lambda g: [1 if c == " " else ord(c) for c in g]
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), key(x[0])))][:length]


def test_predictions_against_brute_force(spark):
    length = 40
    samples = [("en", "the cat and the dog and the bird"), ("de", "der hund und die katze und der vogel"), ("fr", "le chien et le chat et l'oiseau été")]
    docs = spark.createDataFrame([(lang, t, k) for k, (lang, t) in enumerate(samples * 2)] + [(None, "zzz", 9), ("en", None, 10)], "lang string, text string, doc_id int")
    profiles = langid.Profiles.of(langid.learn(docs, length=length).collect(), length)
    total = {lang: Counter() for lang, _ in samples}
    for lang, t in samples * 2:
        total[lang].update(grams(t))
    own = {lang: ranked(c, length) for lang, c in total.items()}
    texts = [t for _, t in samples] + ["the der", "Été, la nuit", "x", "", None, "123", "中文 the"]
    langs, scores = (x.to_pylist() for x in profiles.predict(pa.array(texts)))
    for value, lang, score in zip(texts, langs, scores):
        mine = ranked(grams(value), length)
        if not mine:
            assert (lang, score) == ("und", 0)
            continue
        far = {name: sum(min(abs(p.index(g) - k), length) if g in p else length for k, g in enumerate(mine)) for name, p in own.items()}
        best = min(sorted(far), key=far.get)
        assert lang == best and abs(score - (1 - far[best] / (len(mine) * length))) < 1e-12


def test_held_out_languages_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = text.held_out("doc_id", 5, 0)
    profiles = langid.Profiles.of(langid.learn(docs.filter(~held)).collect())
    rows = langid.predict(docs.filter(held), profiles).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    profiles = langid.Profiles.of(langid.learn(docs).collect())
    rows = langid.predict(docs, profiles).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    nothing = langid.Profiles.of(langid.learn(docs.limit(0)).collect())
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), profiles).count() == 0
