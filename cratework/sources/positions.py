"""Where a record stands in the files it was read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITION = "position"


def file_position() -> Column:
    """File, first byte of the split and row in it; to be taken right after the read."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )


def position_of(df: DataFrame) -> list[str]:
    """The position column, if ``df`` has one."""
    return [POSITION] if POSITION in df.columns else []
