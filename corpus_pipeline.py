"""The corpus pipeline: each stage's rows are stored and read again as the next one's documents.

Language ID drops documents without a recognised language, toxicity those more likely toxic than not,
exact dedup all but one of equal texts, the n-gram join all but one of each group of near copies;
packing gives the pieces of what is left. The packing stage returns its own columns, all others those
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import digest, langid, ngramjoin, packing, toxicity
from tidemark.llm.common import Stored, filtered

# SQL cannot express the models and the packing: tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.withColumn("held_out", langid.held_out()).where("not held_out"))
    return filtered(docs, lambda d: langid.accepted(langid.score(d, model)), ("lang_pred", "score"))


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filtered(docs, lambda d: toxicity.score(d, model).where("not toxic"), ("severity", "grade", "toxic"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest.drop_copies(docs, digest.fresh_index(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_filter),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stored(spark), []
    for name, stage in STAGES[:-1]:
        docs = stored.put(stage(spark, docs, sf_dir), name)
        stored.drop(*before)  # the last stage's documents stay for the reader of the result
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
