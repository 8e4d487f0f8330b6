"""Entities that are named somewhere but not stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratework.operators.joins import drop_keys


def _missing(entity: str, named: DataFrame, stored: DataFrame) -> DataFrame:
    ids = named.where(F.col("id") != 0).distinct()
    return drop_keys(ids, stored, "id", "id").select(F.lit(entity).alias("entity"), "id")


def missing_entities(
    user_collection: DataFrame,
    releases: DataFrame,
    artists: DataFrame,
    labels: DataFrame,
    masters: DataFrame,
    force: bool = False,
) -> DataFrame:
    """(entity, id) of releases owned, and artists, labels and masters named, yet not stored.

    With ``force`` every owned release is listed, stored or not, to be fetched again.

    Ids are made distinct before the anti join, so a hot name costs one row per task.
    """
    credited = releases.select(F.explode("artists.id").alias("id"))
    labelled = releases.select(F.explode("labels.id").alias("id"))
    owned = user_collection.select(F.col("release_id").alias("id"))
    return reduce(
        DataFrame.unionByName,
        [
            _missing("release", owned, releases.limit(0) if force else releases),
            _missing("artist", credited, artists),
            _missing("label", labelled, labels),
            _missing("master", releases.select(F.col("master_id").alias("id")), masters),
        ],
    )
