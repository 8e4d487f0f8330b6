"""Collection sync: landed items into the stored collection, and its users."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratework.operators.merge import insert_new, last_per_key, upsert
from cratework.operators.quality import rating_in_range, split_valid
from cratework.sources.json_documents import has_release

KEY = ["user_id", "instance_id"]


class Synced(NamedTuple):
    collection: DataFrame
    new: DataFrame
    rejected: DataFrame
    counters: DataFrame


def is_valid_item() -> Column:
    """An item names a release and its rating is in range."""
    return has_release() & rating_in_range()


def latest_items(items: DataFrame) -> DataFrame:
    """Valid items, one per user and instance: the one added last."""
    valid, _ = split_valid(items, is_valid_item())
    return last_per_key(valid, KEY, F.struct("date_added", "release_id"))


def sync_collection(stored: DataFrame, items: DataFrame, force: bool = False) -> Synced:
    """The next collection, its new rows, the items that are not valid and the counters.

    A known item stays as it is; with ``force`` everything but its release and its
    creation time is taken from the new item.
    """
    _, rejected = split_valid(items, is_valid_item())
    latest = latest_items(items)
    if "created_at" in stored.columns:
        latest = latest.withColumn("created_at", F.current_timestamp())
    new = insert_new(stored, _shaped(latest, stored), KEY, unique=True).select(stored.columns)
    if force:
        collection = upsert(stored, latest, KEY, keep=("release_id", "created_at"))
    else:
        collection = stored.unionByName(new)
    return Synced(collection, new, rejected, sync_counters(stored, items, force))


def _shaped(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items with the columns of the stored table; absent ones are NULL."""
    return items.select(
        *[
            F.col(f.name) if f.name in items.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in stored.schema.fields
        ]
    )


def sync_counters(stored: DataFrame, items: DataFrame, force: bool = False) -> DataFrame:
    """One row: added, updated, unchanged, errors.

    Of several copies of an item one is stored, so one is counted; errors are rows.
    """
    known = stored.select(*KEY, F.lit(True).alias("_known"))
    latest = latest_items(items).select(*KEY, F.lit(True).alias("_valid"))
    _, rejected = split_valid(items, is_valid_item())
    checked = latest.join(known, KEY, "left").unionByName(
        rejected.select(*KEY, F.lit(False).alias("_valid"), F.lit(None).cast("boolean").alias("_known"))
    )
    seen = F.col("_valid") & F.col("_known").isNotNull()
    none = F.lit(0).cast("bigint")
    return checked.agg(
        F.count_if(F.col("_valid") & F.col("_known").isNull()).alias("added"),
        (F.count_if(seen) if force else none).alias("updated"),
        (none if force else F.count_if(seen)).alias("unchanged"),
        F.count_if(~F.col("_valid")).alias("errors"),
    )


def new_users(users: DataFrame, usernames: DataFrame) -> DataFrame:
    """A row with a new id for every name in ``usernames.username`` that is not known.

    New ids are unique and above all old ones, not consecutive.
    """
    new = usernames.select("username").distinct().join(
        users.select("username"), "username", "left_anti"
    )
    last = users.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint")).alias("id")).scalar()
    return new.sortWithinPartitions("username").select(
        (last + 1 + F.monotonically_increasing_id()).alias("id"), "username"
    )


def ensure_users(users: DataFrame, usernames: DataFrame) -> DataFrame:
    """The users, with those of ``usernames`` that were not known."""
    return users.unionByName(new_users(users, usernames), allowMissingColumns=True)
