"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratework.functions.text import ascii_lower, is_ascii


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def folded(text: Column) -> Column:
    """``text`` with A to Z in lower case and every other letter as it is.

    Text of ASCII alone takes the faster built-in, which does the same there.
    """
    return F.when(is_ascii(text), F.lower(text)).otherwise(ascii_lower(text))
