"""Join shapes shared by the analyses.

No join here carries a broadcast hint: Spark broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold``; above it the
shuffled join is used and AQE splits partitions that a hot key makes too large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_lookup(
    facts: DataFrame, lookup: DataFrame, key: str, lookup_key: str, spread_by: str
) -> DataFrame:
    """Left join of ``facts`` to a unique-keyed ``lookup``; the lookup key is dropped.

    Rows with a NULL key match nothing, yet a plain left join would send them all
    to one partition. They probe with a hash of ``spread_by`` instead, and the
    NULL test in the condition keeps such a hash from ever matching.
    """
    probe = F.coalesce(F.col(f"f.{key}"), F.xxhash64(F.col(f"f.{spread_by}")))
    joined = facts.alias("f").join(
        lookup.alias("l"),
        (probe == F.col(f"l.{lookup_key}")) & F.col(f"f.{key}").isNotNull(),
        "left",
    )
    return joined.drop(F.col(f"l.{lookup_key}"))


def owned_release_ids(user_collection: DataFrame, user_id: int | None = None) -> DataFrame:
    """Distinct release ids of all collections, or of one user's."""
    items = user_collection
    if user_id is not None:
        items = items.where(F.col("user_id") == user_id)
    return items.select("release_id").distinct()


def keep_keys(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` occurs in ``keys.key``."""
    wanted = keys.select(F.col(key).alias("_key"))
    return df.join(wanted, F.col(column) == F.col("_key"), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` does not occur in ``keys.key``; NULLs are kept."""
    unwanted = keys.select(F.col(key).alias("_key"))
    return df.join(unwanted, F.col(column) == F.col("_key"), "left_anti")


def union_ids(*frames: DataFrame) -> DataFrame:
    """Set union of one-column id frames."""
    return reduce(DataFrame.unionByName, frames).distinct()
