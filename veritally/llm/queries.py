"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import ann, bpe, decontam, jaccard, langid, linededup, lm, manifest, phrases, quality, repeats, sharding, text, urlrules
from veritally.llm import oracle as sql

SHARDS = 16
NEIGHBOURS = 20
PHRASES = 2000


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", text.held_out("doc_id", 5, 0).alias("held_out"))
    labels = _table(spark, folder, "labels").filter(~text.held_out("doc_id", 5, 0))
    scored = quality.score(docs, quality.learn(docs.filter(~F.col("held_out")), labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN).drop("text")


def attention_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", text.held_out("doc_id", 7, 2).alias("held_out"), "text")
    ranks = spark.sparkContext.broadcast(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    model, words = lm.learn(docs.filter(~F.col("held_out")), ranks)
    return lm.score(docs, model, words, ranks, keeps_text=False)


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").withColumn("held_out", text.held_out("doc_id", 5, 0))
    profiles = langid.Profiles.of(langid.learn(docs.filter(~F.col("held_out"))).collect())
    return langid.predict(docs.select("doc_id", "held_out", "text"), profiles).drop("text")


def feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.numbered(spark, f"{folder}/documents.parquet")
    return sharding.described(sharding.assign(rows, sharding.total(rows), SHARDS))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return decontam.overlaps(docs, _table(spark, folder, "benchmark")).drop("d1", "d2")


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.dedup(_table(spark, folder, "documents").select("doc_id", "text"))


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(_table(spark, folder, "documents").select("doc_id", "text"))


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.judge(_table(spark, folder, "pages").select("page_id", "url")).drop("url")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.judge(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(_table(spark, folder, "documents").select("lang", "text"), PHRASES)


def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, NEIGHBOURS)


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify(_table(spark, folder, "documents"))


def queries():
    return {
        "op1_quality_classifier": quality_classifier,
        "op2_bpe_codec": bpe_codec,
        "op3_attention_lm": attention_lm,
        "op4_language_id": language_id,
        "op5_decontamination": decontamination,
        "op6_feistel_shards": feistel_shards,
        "op7_line_dedup": line_dedup,
        "op8_url_filter": url_filter,
        "op9_ngram_jaccard": jaccard_join,
        "op10_quality_rules": quality_rules,
        "op11_phrase_mining": phrase_mining,
        "op12_nearest_neighbours": nearest_neighbours,
        "op13_merkle_manifest": merkle_manifest,
    }


def oracle() -> dict[str, str]:
    return {
        "op5_decontamination": sql.DECONTAMINATION,
        "op7_line_dedup": sql.LINE_DEDUP,
        "op8_url_filter": sql.URL_FILTER,
        "op9_ngram_jaccard": sql.NGRAM_JACCARD,
        "op11_phrase_mining": phrase_mining,
        "op12_nearest_neighbours": nearest_neighbours,
        "op11_phrase_mining": sql.PHRASE_MINING,
        "op13_merkle_manifest": sql.MERKLE_MANIFEST,
    }
