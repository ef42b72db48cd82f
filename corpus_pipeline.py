"""From raw documents to training ids in five stages.

Each stage takes (spark, docs, folder of the tables) and returns the documents it keeps, with the
columns of documents; the last one returns their token ids. A stage works on all its
predecessor kept. Between stages documents are written as parquet and read again.

Null and empty texts pass the classifier as it scores them, lose no lines, link with nothing,
hold no benchmark item and get no ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import bpe, decontam, jaccard, linededup, quality, text
from veritally.session import shared_dir

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels whose ids are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~text.held_out("doc_id", 5, 0))
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*DOCUMENT)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines, n_chars anew.

    A document that loses lines and keeps no word was a copy as a whole, and goes.
    """
    left = linededup.dedup(docs.select(*DOCUMENT))
    emptied = (F.col("removed_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return left.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", n_chars.cast("bigint")).select(*DOCUMENT)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id."""
    return jaccard.survivors(docs.select(*DOCUMENT))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs.select(*DOCUMENT), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives its text again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.round_trip(docs.select(*DOCUMENT), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", ids_stage),
]
#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what lies between them is written to the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
