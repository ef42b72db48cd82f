"""What the entry file registers: the operators' queries and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from veritally.llm import queries as operators


def queries():
    return {**operators.queries(), "pipeline": corpus_pipeline.run}


def oracle() -> dict[str, str]:
    return operators.oracle() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
