import subprocess
import sys
from pathlib import Path

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
import tiktoken
from common import LONG, edge_docs

from tests.conftest import FOLDER
from tests.llm import test_jaccard, test_linededup
from veritally.llm import bpe, quality

ROOT = Path(__file__).parents[2]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over the smallest tables."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet").cache(), []
    for name, stage in pipeline.STAGES:
        left = stage(spark, docs, FOLDER).cache()
        out.append((name, docs.collect(), left.collect(), left.columns))
        docs = left
    return out


def test_stages_return_documents(stages):
    assert [name for name, *_ in stages] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    assert all(columns == list(pipeline.DOCUMENT) for *_, columns in stages[:-1])


def test_each_stage_against_brute_force(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    _, before, after, _ = stages[0]
    good = {r.doc_id for r in labels if r.quality == 1}
    kept = {r.doc_id for r in after}
    assert sum(r.doc_id in kept for r in before if r.doc_id in good) >= 0.95 * sum(r.doc_id in good for r in before)

    _, before, after, _ = stages[1]
    expected = test_linededup.brute([(r.doc_id, r.text) for r in before], 25)
    expected = {d[0]: t for d, (t, n) in expected.items() if not n or t.strip(" \t\n\v\f\r")}
    assert {r.doc_id: r.text for r in after} == expected
    assert all(r.n_chars == len(r.text) for r in after)

    _, before, after, _ = stages[2]
    groups = test_jaccard.brute([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {i for i, _, c in groups if i == c}

    _, before, after, _ = stages[3]
    items = [r.text.lower().split() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in before if any(" ".join(i) in " ".join(r.text.lower().split()) for i in items)}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == holds

    _, before, after, _ = stages[4]
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before) and all(r.round_trip and r.ids == library.encode_ordinary(texts[r.doc_id]) for r in after)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(r.doc_id for r in pipeline.run(spark, FOLDER).collect()) == sorted(r.doc_id for r in stages[-1][2])


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(pipeline.quality, "learn", lambda *_: quality.fit([], []))
    docs = edge_docs(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
    rows = {(r.doc_id, r.n_tokens) for r in docs.collect()}
    assert {i for i, _ in rows} == {1, 3, 4, 5, 6, 7, 8, 10, -11, 12, None} - {3}
    assert all(r.round_trip for r in docs.collect()) and LONG


def test_the_rest_works_without_this_part(tmp_path):
    for path in ROOT.iterdir():
        if path.name not in (".git", "corpus_pipeline.py", "veritally", "tests"):
            (tmp_path / path.name).symlink_to(path)
    (tmp_path / "veritally").mkdir()
    for path in (ROOT / "veritally").iterdir():
        if path.name != "llm":
            (tmp_path / "veritally" / path.name).symlink_to(path)
    code = "import __spark_entry__ as e; print(any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()), len(e.queries()) > 50)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert done.stdout.strip() == "False True", done.stderr[-500:]
