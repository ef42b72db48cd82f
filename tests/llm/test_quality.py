import numpy as np
import pyarrow as pa
from common import TEXTS, edge_docs

from veritally.llm import quality, text

SMALL = quality.Shape(chunk=24, overlap=8, filters=6, hidden=4)


def made_up(seed, n):
    rnd = np.random.default_rng(seed)
    good = [" ".join(rnd.choice(["some", "plain", "words", "and", "more"], 30)) + "." for _ in range(n)]
    bad = ["".join(w + rnd.choice(["***", "###"]) + " " for w in rnd.choice(["some", "plain", "words"], 20)) for _ in range(n)]
    return [t.encode() for t in good + bad], [1] * n + [0] * n


def scores(network, texts):
    return network.score(*text.raw(pa.array([t.decode() for t in texts])))


def test_chunks_cover_every_byte_and_overlap():
    data = np.arange(1, 201, dtype=np.uint8)
    offsets = np.array([0, 0, 1, 24, 25, 200])
    owner, chunks = quality.cut(offsets, data, SMALL)
    for i in range(5):
        seen = set(chunks[owner == i].reshape(-1).tolist()) - {0}
        assert seen == {int(b) + 1 for b in data[offsets[i] : offsets[i + 1]]}
    assert (chunks[owner == 4][0][-8:] == chunks[owner == 4][1][:8]).all()


def test_gradients_against_differences():
    network = quality.Network(SMALL, 3)
    offsets, data = text.raw(pa.array(["one text here", "and another *** one that is longer than a chunk"]))
    owner, chunks = quality.cut(offsets, data, SMALL)
    labels = np.array([1.0, 0.0])

    def loss():
        p = network.score(offsets, data)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, gradient in network.gradients(owner, chunks, labels).items():
        weights = network.weights[name]
        at = np.unravel_index(np.abs(gradient).argmax(), weights.shape)
        old = weights[at]
        weights[at] = old + 1e-2
        up = loss()
        weights[at] = old - 1e-2
        down = loss()
        weights[at] = old
        assert abs((up - down) / 2e-2 - gradient[at]) < 2e-2 * max(0.05, abs(gradient[at])), name


def test_learns_what_marks_bad_texts():
    network = quality.fit(*made_up(1, 60), SMALL, quality.Training(steps=200))
    held, labels = made_up(2, 40)
    assert ((scores(network, held) >= quality.THRESHOLD) == np.array(labels)).mean() > 0.95


def test_held_out_labels_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = text.held_out("doc_id", 5, 0)
    network = quality.learn(docs, labels.filter(~held), training=quality.Training(steps=400))
    rows = quality.score(docs.join(labels.filter(held), "doc_id"), network).collect()
    right = [(r.score >= quality.THRESHOLD) == r.quality for r in rows]
    assert sum(right) >= 0.9 * len(right)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    none = quality.learn(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, 1), (None, 1), (3, None), (99, 0)], "doc_id bigint, quality int")
    rows = quality.score(docs, quality.learn(docs, labels, SMALL, quality.Training(steps=5))).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert quality.score(docs.limit(0), none).count() == 0
