"""Removal of releases that no collection holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratework.operators.filters import collection_only
from cratework.operators.joins import keep_keys, owned_release_ids


def prune_releases(
    releases: DataFrame, user_collection: DataFrame, keep_masters: bool = False
) -> DataFrame:
    """Releases in any collection; with ``keep_masters`` also their sister pressings."""
    return collection_only(releases, user_collection, include_master_releases=keep_masters)


def prune_children(children: DataFrame, kept_releases: DataFrame) -> DataFrame:
    """Link or track rows whose release is kept."""
    return keep_keys(children, kept_releases.select("id"), "release_id", "id")


def prune_report(releases: DataFrame, user_collection: DataFrame) -> DataFrame:
    """total_releases, deleted_releases and deleted_percent of a prune, in one pass."""
    owned = owned_release_ids(user_collection)
    flagged = releases.select("id").join(owned, F.col("id") == owned["release_id"], "left")
    unused = F.count_if(F.col("release_id").isNull())
    return flagged.agg(
        F.count("*").alias("total_releases"),
        unused.alias("deleted_releases"),
        F.round(
            F.try_divide(F.lit(100.0) * unused, F.count("*")), 1
        ).alias("deleted_percent"),
    )
