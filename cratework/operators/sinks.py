"""Result sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_rows(summary: DataFrame) -> DataFrame:
    """A one-row summary as (metric, value) rows."""
    values = [F.col(c).cast("bigint").alias(c) for c in summary.columns]
    return summary.select(*values).unpivot([], summary.columns, "metric", "value")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; dates and timestamps as ISO text, NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(analyses: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Write each named result to its own folder as ``csv``, ``json`` or ``parquet``."""
    writers = {
        "csv": write_csv,
        "json": write_json,
        "parquet": lambda df, path: df.write.mode("overwrite").parquet(path),
    }
    write = writers[fmt]
    for name, df in analyses.items():
        write(df, f"{folder}/{name}")


def export_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write each table as Parquet under its name."""
    write_report(tables, folder, "parquet")
