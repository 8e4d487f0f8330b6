"""Exact dedup: local combining, salted digest groups, then the salts' winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratework.llm.common import folded, text_or_empty

SALTS = 32


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    salts: int = SALTS,
    digest=text_digest,
) -> DataFrame:
    """The group of equal texts that each document is in, and the document that stays.

    Texts are equal when identical after lower-casing A to Z; NULL is the empty text. One row
    per input row: ``doc_id``, ``keep_id`` (largest id of the group), ``group_size`` (rows of
    the group), ``kept``, ``text_sha256`` of the normalised text.

    * Map tasks combine equal texts before any shuffle, so a group of any size sends one row per
      task. Salted groups are merged first, then the salts' winners. Each of these stages groups
      by digest *and* whole text, so texts that share a digest are never merged.
    * The rows find their group by digest, second digest and length. Should two texts ever agree
      in all of these, the query fails instead of giving a wrong group.
    * The join back has plain exchanges on both sides, so Spark splits a hot digest.

    Rows with an equal id and text are kept or dropped alike. A NULL id is smaller than any
    other; in a group of NULL ids alone ``keep_id`` is NULL and all rows are kept. An empty
    table gives an empty result; other columns are not read.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"), folded(text_or_empty(text_column)).alias("content")
    ).withColumn("digest", digest(F.col("content")))

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "content").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    winners = merged.groupBy("digest", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    marks = (F.xxhash64("content").alias("mark"), F.octet_length("content").alias("octets"))
    groups = (
        winners.select("digest", *marks, "keep_id", "group_size")
        .groupBy("digest", "mark", "octets")
        .agg(
            F.count(F.lit(1)).alias("contents"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        )
        .select(
            _key().alias("key"),
            "keep_id",
            F.when(F.col("contents") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("two texts share all their digests")))
            .alias("group_size"),
        )
    )
    marked = rows.select("doc_id", F.sha2("content", 256).alias("text_sha256"), "digest", *marks)
    return (
        marked.select("doc_id", "text_sha256", _key().alias("key"))
        .join(groups, "key")
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def _key() -> Column:
    return F.concat_ws("-", "digest", "mark", "octets")


def drop_exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS
) -> DataFrame:
    """One document of each group, that with the largest id, with all its columns."""
    groups = exact_duplicates(docs, id_column, text_column, salts).where("kept")
    kept = groups.select(F.col("keep_id").alias("__llm_id"), F.col("text_sha256").alias("__llm_text"))
    marked = docs.withColumn("__llm_sha", F.sha2(folded(text_or_empty(text_column)), 256))
    same = F.col(id_column).eqNullSafe(F.col("__llm_id"))
    same &= F.col("__llm_sha") == F.col("__llm_text")
    stays = marked.join(kept.distinct(), same, "left_semi")
    return stays.dropDuplicates([id_column, "__llm_sha"]).drop("__llm_sha")
