import functools
import math
import os
import time
import timeit
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest
from common import TEXTS, edge_docs, words

from pyspark.sql import functions as F
from veritally.llm import bpe, lm, queries, text
from veritally.session import shared_dir

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
SMALL = lm.Shape(context=4, stride=6, width=8, hidden=10, own_inputs=50, own_classes=20, shared_classes=6)
QUICK = lm.Training(sample=50, windows=3, steps=10, batch=8)


def network(seed=1, n=200):
    rnd = np.random.default_rng(seed)
    windows = rnd.integers(0, n, (40, SMALL.context + 1 + SMALL.stride))
    windows[0, :5] = -1
    windows[1, :3] = -1
    windows[2, 8:] = -2
    counts = rnd.integers(0, 50, n)
    vocabulary = lm.Vocabulary.of(counts, windows, SMALL)
    made = lm.Attention(SMALL, vocabulary, seed)
    made.weights["far"][:] = rnd.normal(size=made.weights["far"].shape)
    return made, windows, n


def test_gradients_against_differences():
    made, windows, _ = network()
    _, gradients = made.gradients(windows)
    for name, gradient in gradients.items():
        weights = made.weights[name]
        at = np.unravel_index(np.abs(gradient).argmax(), weights.shape)
        old, sides = weights[at], []
        for step in (1e-2, -1e-2):
            weights[at] = old + step
            sides.append(made.gradients(windows)[0])
        weights[at] = old
        assert abs((sides[0] - sides[1]) / 2e-2 - gradient[at]) < 0.05 * abs(gradient[at]) + 1e-4, name


def test_attention_is_a_distribution_and_sees_no_future():
    made, windows, n = network()
    row = np.repeat(windows[5:6], n, axis=0)
    row[:, -1] = np.arange(n)
    scores = made.score(row)
    assert abs(np.exp(scores[:, -1]).sum() - 1) < 1e-4
    assert np.abs(scores[:, :-1] - scores[0, :-1]).max() < 1e-5
    before = windows[5:6].copy()
    before[0, 1] = -1  # a text that starts here does not know what stood before
    other = before.copy()
    before[0, 0] = other[0, 0] = -1
    assert np.allclose(made.score(before), made.score(other))


def test_counts_are_a_distribution():
    spelling = lm.Spelling(RANKS)
    offsets, ids = spelling.spelled(["thanks", "thinking", "a", "unbelievable", "zzzqqq"])
    left, after = lm.contexts(offsets, ids), np.append(ids[1:], lm.NEW)
    after[offsets[1:] - 1] = lm.NEW
    context = np.concatenate([left, left, ids, ids])
    what = np.concatenate([after, np.full(len(ids), lm.ALL)] * 2)
    table = Counter(zip(context.tolist(), what.tolist()))
    begins = np.array([spelling.machine.tokens.get(i, b" ")[:1] == b" " for i in range(spelling.end + 1)])
    counts = np.bincount(ids, minlength=spelling.end + 1)
    made = lm.Following(*(np.array(x) for x in zip(*[(c, w, n) for (c, w), n in table.items()])), counts, begins)
    every = np.arange(spelling.end + 1)
    for k in range(len(ids)):
        seq = np.empty(2 * len(every), np.int64)
        seq[0::2], seq[1::2] = ids[k], every
        behind = np.zeros(len(seq), np.int64)
        behind[0::2] = left[k]
        assert abs(made.score(seq, behind, np.zeros(0, int))[1::2].sum() - 1) < 1e-9


def test_every_id_is_scored_once():
    offsets = np.array([0, 1, 7, 13, 50])
    owner, first, count = lm.cut(offsets, SMALL)
    windows = lm.laid_out(offsets, np.arange(50), owner, first, SMALL)
    target = windows[:, -SMALL.stride :]
    assert target[target >= 0].tolist() == list(range(50)) and count.sum() == 50
    assert windows[-1, : SMALL.context + 1].tolist() == list(range(49 - 0 - SMALL.context - 1, 49)) or (windows[-1] >= -2).all()


@pytest.fixture(scope="module")
def ranks(spark):
    return spark.sparkContext.broadcast(RANKS)


def test_base_against_brute_force_and_edge_rows(spark, ranks, monkeypatch):
    monkeypatch.setattr(lm, "MOST_KNOWN", 3)  # other words are joined
    docs = edge_docs(spark)
    train = docs.filter(F.coalesce(F.col("doc_id") != 8, F.lit(True)))
    model, counted = lm.learn(train, ranks, shape=SMALL, training=QUICK)
    own = Counter(w for i, t in TEXTS if i != 8 for w in [*words(t), None])
    total, distinct = sum(own.values()), len(own)
    rows = lm.score(docs, model, counted, ranks).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        tokens = [*words(row.text), None]
        base = sum(math.log10((own[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(own[w] > 0 for w in tokens), total)
        assert abs(row.base_score - base) < 1e-9 * max(1, abs(base)) and row.score < 0 and math.isfinite(row.score)
    nothing, none = lm.learn(docs.limit(0), ranks, shape=SMALL, training=QUICK)
    assert all(math.isfinite(r.score) and r.base_score == 0 for r in lm.score(docs, nothing, none, ranks).collect())
    assert lm.score(docs.limit(0), model, counted, ranks).count() == 0


def test_text_like_the_training_text_is_likelier(spark, ranks):
    rows = [(k, " ".join(["the quick brown fox jumps over the lazy dog"] * (1 + k % 3))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, counted = lm.learn(docs, ranks, shape=SMALL, training=lm.Training(sample=60, windows=2, steps=150, batch=16))
    ask = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "dog lazy the over jumps fox brown quick the")], "doc_id bigint, text string")
    score = {r.doc_id: (r.score, r.base_score) for r in lm.score(ask, model, counted, ranks).collect()}
    assert score[1][0] > score[2][0] + 2 and score[1][0] > score[1][1]


def test_rare_continuations_count_as_in_memory(spark, ranks, monkeypatch):
    """Scores with most words joined are those of one table in memory that holds every continuation."""
    docs = edge_docs(spark)
    train = docs.filter(F.coalesce(F.col("doc_id") != 8, F.lit(True)))
    spelling = lm.Spelling(RANKS)
    own = Counter(w for i, t in TEXTS if i != 8 for w in words(t))
    table, counts = Counter(), np.zeros(spelling.end + 1, np.int64)
    counts[spelling.end] = sum(i != 8 for i, _ in TEXTS)
    for word, n in own.items():
        offsets, ids = spelling.spelled([word])
        for left, at, after in zip(lm.contexts(offsets, ids), ids, [*ids[1:], lm.NEW]):
            counts[at] += n
            for context in (left, at):
                table[int(context), int(after)] += n
                table[int(context), lm.ALL] += n
    columns = (np.array(x) for x in zip(*[(c, w, n) for (c, w), n in table.items()]))
    begins = np.array([spelling.machine.tokens.get(i, b" ")[:1] == b" " for i in range(spelling.end + 1)])
    whole = lm.Following(*columns, counts, begins)
    monkeypatch.setattr(lm, "MOST_FOLLOWING", 3, raising=False)  # no such bound may count
    for most in (3, lm.MOST_KNOWN):
        monkeypatch.setattr(lm, "MOST_KNOWN", most)
        model, stays = lm.learn(train, ranks, shape=SMALL, training=QUICK)
        for row in lm.score(docs, model, stays, ranks).collect():
            offsets, ids, left, _ = spelling.spell(lm.pa.array([row.text], lm.pa.string()))
            owner, first, _ = lm.cut(offsets, SMALL)
            windows = lm.laid_out(offsets, ids, owner, first, SMALL)
            attention = model.attention.score(windows)[windows[:, -SMALL.stride :] >= 0]
            both = lm.SHARE * np.exp(attention) + (1 - lm.SHARE) * whole.score(ids, left, offsets[:-1])
            assert abs(np.log10(both).sum() - row.score) < 1e-5 * abs(row.score)


def test_every_training_window_is_learned_from(spark, ranks):
    """What the sample lacks is in the classes and the weights: the number of windows is that of all texts."""
    usual = [(k, "the quick brown fox jumps over the lazy dog " * 8) for k in range(40)]
    other = [(k + 40, "seven zebras quietly examined purple umbrellas " * 8) for k in range(40)]
    docs = spark.createDataFrame(usual + other, "doc_id bigint, text string").repartition(3)
    training = lm.Training(sample=1, windows=1, steps=5, batch=8)
    made = lm.learn(docs, ranks, shape=SMALL, training=training)[0].attention
    spelling = lm.Spelling(RANKS)
    offsets, ids, _, _ = spelling.spell(lm.pa.array([t for _, t in usual + other]))
    assert made.trained_on == len(lm.cut(offsets, SMALL)[0])
    seen = np.unique(ids)
    shared = made.vocabulary.classes[seen][made.vocabulary.classes[seen] >= SMALL.own_classes]
    sample = lm._sampled(docs, ranks, "text", SMALL, training)
    start = lm.Attention(SMALL, made.vocabulary, training.seed)
    start.fit(sample, training)
    owner, first, _ = lm.cut(offsets, SMALL)
    every = lm.laid_out(offsets, ids, owner, first, SMALL)
    assert made.gradients(every)[0] < start.gradients(every)[0]
    assert len(shared) == 0 or made.vocabulary.n_classes - 1 not in shared


def test_pairs_that_tasks_do_not_know_are_joined(spark, ranks, monkeypatch):
    docs = edge_docs(spark)
    monkeypatch.setattr(lm, "MOST_KNOWN", 3)
    scores = []
    for most in (lm.MOST_PAIRS, 3):
        monkeypatch.setattr(lm, "MOST_PAIRS", most)
        model, stays = lm.learn(docs.coalesce(1), ranks, shape=SMALL, training=QUICK)
        assert (stays.pairs is None) == (most > 3)
        scores.append(sorted((str(r.doc_id), str(r.text), r.score, r.base_score) for r in lm.score(docs.coalesce(1), model, stays, ranks).collect()))
    for one, other in zip(*scores, strict=True):
        assert one[:2] == other[:2] and np.allclose(one[2:], other[2:], rtol=1e-9)


def test_query_keeps_less_than_the_texts_on_disk(spark, tmp_path, monkeypatch):
    """Neither texts nor a row for each id of a rare word stay in the folder that executors share."""
    rnd = np.random.default_rng(5)
    made = [" ".join("".join(map(chr, rnd.integers(97, 123, 8))) for _ in range(200)) for _ in range(40)]
    spark.createDataFrame([(k, made[k % 40]) for k in range(1200)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(lm, "MOST_KNOWN", 3)
    monkeypatch.setattr(lm, "learn", functools.partial(lm.learn, shape=SMALL, training=QUICK))
    used = lambda: sum((Path(at) / f).stat().st_size for at, _, files in os.walk(urlparse(shared_dir(spark)).path) for f in files)
    before = used()
    rows = queries.attention_lm(spark, str(tmp_path)).collect()
    assert len(rows) == 1200 and "text" not in rows[0] and len({r.doc_id for r in rows}) == 1200
    assert used() - before < sum(len(made[k % 40]) for k in range(1200)) / 2


def test_words_are_listed_without_a_scalar_for_each():
    """Every pass over all windows lists the words of its texts: the same strings, in a fraction of to_pylist's time."""
    made = lm.pa.array([f"w{i}é" for i in range(200_000)] + ["", "a\x00b", "中文 😀"])
    clock = lambda step: min(timeit.repeat(step, number=1, repeat=3, timer=time.process_time))
    assert text.listed(made) == made.to_pylist() and text.listed(made[:0]) == []
    assert text.listed(lm.pa.chunked_array([made[:5], made[5:9]])) == made[:9].to_pylist()
    spelling = lm.Spelling(RANKS)
    texts = lm.pa.array([" ".join(made[:50_000].to_pylist())])
    spelling.spell(texts)
    assert clock(lambda: text.listed(made)) < clock(made.to_pylist) / 2
    assert clock(lambda: spelling.spell(texts)) < clock(made[:50_000].to_pylist)
