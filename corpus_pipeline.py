"""A training corpus from raw documents: five operators, each over all that the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratework.llm.common import table
from cratework.llm.decontamination import contamination
from cratework.llm.line_dedup import drop_repeated_lines
from cratework.llm.order_minhash import drop_near_duplicates
from cratework.llm.queries import MODEL
from cratework.llm.sentencepiece_fst import round_trip
from cratework.llm.toxicity import fit, score_toxicity
from cratework.session import deleted, shared_folder, temporary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those given, doesn't reject."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.where("predicted = 0").select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines found in ten of them; n_chars is that of the new text."""
    kept = drop_repeated_lines(docs)
    chars = F.char_length("text").cast("bigint")
    return kept.withColumn("n_chars", chars).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark's items."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their pieces, and whether these give the text back."""
    return round_trip(docs, MODEL)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", tokenised),
]

#: SQL can't express the classifier, the sketches and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read by the next.

    What a stage read, and what it wrote for itself, is deleted when its result is stored, so the
    last stage's result is all that is left.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            deleted(spark, f"{folder}/{before}")
        before = name
    return docs
