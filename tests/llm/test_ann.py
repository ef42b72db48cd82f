"""Nearest neighbours against every product worked out."""

import numpy as np
import pytest

from tests.conftest import FOLDER
from veritally.llm import ann, graph

QUERY = "vec_id % 20 = 0"


def brute(rows, k):
    """rows of (vec_id, vector) that take part: per query row its list."""
    out = []
    for at, (query, vector) in enumerate(rows):
        if query % 20 == 0:
            scores = [(-float(np.dot(np.float64(vector), np.float64(v))), i) for n, (i, v) in enumerate(rows) if n != at and len(v) == len(vector)]
            out += [(query, rank, i, round(-s, 9)) for rank, (s, i) in enumerate(sorted((round(s, 9), i) for s, i in scores)[:k], 1)]
    return sorted(out)


def found(df, k, settings=ann.Settings()):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(df, QUERY, k, settings).collect())


@pytest.mark.parametrize("folder, rows", [(FOLDER, 8192), ("/root/testdata/sf0.1", 1500)])
def test_recall_and_scores(spark, folder, rows):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    given = [(r.vec_id, r.embedding) for r in df.collect()]
    got, expected = found(df, 20, ann.Settings(shard_rows=rows)), brute(given, 20)
    assert len(got) == len(expected)
    assert len({r[::2] for r in got} & {r[::2] for r in expected}) >= 0.95 * len(expected)
    exact = {i: np.float64(v) for i, v in given}
    assert all(abs(exact[q] @ exact[i] - score) < 1e-8 for q, _, i, score in got)
    assert all(a[0] != b[0] or a[3] >= b[3] for a, b in zip(got, got[1:]))


def test_edge_rows(spark):
    """What takes no part, repeated ids and vectors, ties, lengths; few enough for the beam to hold all."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [0.0, 2.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [-0.0, 1.0]), (6, [0.0, 1.0]),
        (40, [1.0, 2.0, 3.0]), (7, [1.0, 0.0, 0.0]), (60, [5.0]), (-20, [100.0, 100.0]), (80, [1e30, 1.0]),
    ]
    none = [(None, [1.0, 1.0]), (100, None), (120, []), (140, [0.0, 0.0]), (160, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0])]
    df = spark.createDataFrame([(i, v, "k", 1, 2) for i, v in rows + none], "vec_id bigint, embedding array<float>, key string, shard int, node int")
    expected = brute([(i, np.float32(v)) for i, v in rows], 4)
    assert found(df, 4) == expected
    assert found(df.limit(0), 4) == []
    assert found(df.filter("vec_id = 60"), 4) == []
    assert found(df, 4, ann.Settings(shard_rows=2, query_rows=2)) == expected


def test_large_group_of_copies(spark):
    """Copies are one node and do not hide others."""
    copies = spark.range(3000).selectExpr("id AS vec_id", "array(1f, 0f, 0f) AS embedding")
    others = spark.range(3000, 3030).selectExpr("id AS vec_id", "array(CAST(1 - id / 10000 AS FLOAT), CAST(id % 7 AS FLOAT), 0f) AS embedding")
    df = copies.unionByName(others)
    given = [(r.vec_id, r.embedding) for r in df.collect()]
    got = found(df.filter("vec_id % 20 <> 0 OR vec_id IN (0, 40, 2000, 3000, 3020)"), 20)
    assert got == brute([r for r in given if r[0] % 20 or r[0] in (0, 40, 2000, 3000, 3020)], 20)


def test_every_node_is_reached():
    rng = np.random.default_rng(1)
    for n, dims in ((1, 3), (2, 3), (50, 2), (700, 1), (900, 8)):
        points = graph.levelled(np.round(rng.normal(size=(n, dims)), 1) + 0.01)
        edges, entry = graph.build(points, 4, 8, 1.0)
        assert sorted(graph.search(points, edges, entry, points[:1], n)[0]) == list(range(n))


def test_pruned_neighbours_lie_in_different_directions():
    """Along a line the nearest on each side is kept and what lies behind it is not."""
    points = graph.levelled(np.array([[0.0, 1.0], [0.1, 1.0], [0.2, 1.0], [0.3, 1.0], [-0.1, 1.0], [-0.2, 1.0]]))
    kept = graph.prune(points, np.array([0]), np.array([[1, 2, 3, 4, 5, -1]], np.int32), 4, 1.0)
    assert sorted(kept[0]) == [-1, -1, 1, 4]
