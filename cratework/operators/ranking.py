"""Top-k, shares of a total and the most common value per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """Ordered rows; with a limit each task keeps only its own best ``limit`` rows."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def percent_of(part: Column, total: Column) -> Column:
    """Share in percent, rounded to two places as a double."""
    return F.round(F.lit(100.0) * part / total, 2)


def row_total(df: DataFrame) -> Column:
    """Number of rows of ``df`` as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()


def most_common(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent non-NULL ``value`` per ``group``; ties go to the smallest value.

    Counts are combined before each shuffle, so a hot group sends one row per
    task and distinct value, not its rows.
    """
    counts = (
        df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count("*").alias("n"))
    )
    return counts.groupBy(group).agg(
        F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value))).alias(value)
    )


def seeded_sample(df: DataFrame, key: str, size: int, seed: str) -> DataFrame:
    """Repeatable random sample of ``size`` rows, ordered by a hash of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(size)
