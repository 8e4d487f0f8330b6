"""Load quality: row checks, counters, the error-rate gate and provenance."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LoadRejected(RuntimeError):
    """The share of bad records is above the allowed rate, or a dump is cut off."""


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass ``valid`` and the rest; an unknown (NULL) check counts as failed."""
    checked = F.coalesce(valid, F.lit(False))
    return df.where(checked), df.where(~checked)


def rating_in_range(rating: Column | str = "rating") -> Column:
    """0 (unrated) to 5; NULL is allowed."""
    value = F.col(rating) if isinstance(rating, str) else rating
    return value.isNull() | value.between(0, 5)


def load_counters(valid: Column) -> list[Column]:
    """Aggregates ``processed`` and ``rejected``, for ``observe`` or ``agg``."""
    checked = F.coalesce(valid, F.lit(False))
    return [
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~checked).alias("rejected"),
    ]


def created_counters(
    merges: Mapping[str, tuple[DataFrame, DataFrame, list[str]]]
) -> DataFrame:
    """(table_name, created) of insert-ignore merges (stored, incoming, key): true inserts."""
    counted = [
        incoming.select(*key)
        .distinct()
        .join(stored.select(*key), key, "left_anti")
        .agg(F.count(F.lit(1)).alias("created"))
        .select(F.lit(name).alias("table_name"), "created")
        for name, (stored, incoming, key) in merges.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def quality_gate(df: DataFrame, valid: Column, max_error_rate: float = 0.1) -> DataFrame:
    """One row: processed, rejected, error_rate, passed.

    The rate is rejected rows over accepted rows; an empty load passes.
    """
    accepted = F.col("processed") - F.col("rejected")
    rate = F.when(F.col("processed") == 0, F.lit(0.0)).otherwise(
        F.col("rejected") / F.greatest(accepted, F.lit(1))
    )
    return df.agg(*load_counters(valid)).select(
        "processed",
        "rejected",
        rate.alias("error_rate"),
        (rate <= max_error_rate).alias("passed"),
    )


def check_gate(processed: int, rejected: int, max_error_rate: float = 0.1) -> None:
    """The same rule over counters observed while a snapshot was written."""
    if rejected > max_error_rate * max(processed - rejected, 1):
        raise LoadRejected(f"{rejected} of {processed} records rejected")


def latest_loads(data_sources: DataFrame, source_name: str = "xml_dump") -> DataFrame:
    """The newest provenance row per source type."""
    rows = data_sources.where(F.col("source_name") == source_name)
    payload = [c for c in data_sources.columns if c not in ("source_type", "source_name")]
    newest = F.max_by(F.struct(*payload), "last_updated")
    return rows.groupBy("source_type").agg(newest.alias("latest")).select(
        "source_type", *[f"latest.{c}" for c in payload]
    )


def not_yet_loaded(files: DataFrame, data_sources: DataFrame) -> DataFrame:
    """Dump files whose name has no provenance row."""
    loaded = data_sources.select("file_name").distinct()
    return files.join(loaded, "file_name", "left_anti")


def table_status(tables: Mapping[str, DataFrame], data_sources: DataFrame) -> DataFrame:
    """Per table: record_count, last_ingestion and whether it holds any row."""
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count("*").alias("record_count")).withColumn("table_name", F.lit(name))
            for name, df in tables.items()
        ],
    )
    loads = latest_loads(data_sources).select(
        F.col("source_type").alias("table_name"), F.col("last_updated").alias("last_ingestion")
    )
    return counts.join(loads, "table_name", "left").select(
        "table_name", "record_count", "last_ingestion", (F.col("record_count") > 0).alias("ingested")
    )
