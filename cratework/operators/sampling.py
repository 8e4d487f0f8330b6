"""A closed subset of the catalogue: sampled collection rows and all they refer to."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratework.operators.joins import drop_keys, keep_keys, union_ids
from cratework.operators.ranking import seeded_sample


@dataclass(frozen=True)
class SampleSizes:
    collection: int = 200
    extra_releases: int = 50
    extra_artists: int = 100
    extra_masters: int = 30
    extra_labels: int = 30


def _with_extras(chosen: DataFrame, table: DataFrame, size: int, seed: str) -> DataFrame:
    others = drop_keys(table.select("id"), chosen, "id", "id")
    return union_ids(chosen, seeded_sample(others, "id", size, seed))


def closed_subset(
    tables: Mapping[str, DataFrame], sizes: SampleSizes = SampleSizes(), seed: str = "sample"
) -> dict[str, DataFrame]:
    """The same tables, cut to sampled collection rows and the rows these need.

    Masters, artists and labels are those of the sampled releases, plus extra
    random ones. Link rows stay only if both their ends are in the subset. All
    tables are lazy; a job that writes them all may write the chosen ids first.
    """
    picked = seeded_sample(tables["user_collection"], "instance_id", sizes.collection, seed)
    picked = picked.select("user_id", "release_id")
    release_ids = picked.select(F.col("release_id").alias("id")).distinct()
    user_ids = picked.select(F.col("user_id").alias("id")).distinct()

    def referred(link_table: str, release_key: str, column: str) -> DataFrame:
        rows = tables[link_table].where(F.col(column).isNotNull())
        rows = keep_keys(rows, release_ids, release_key, "id")
        return rows.select(F.col(column).alias("id")).distinct()

    masters = _with_extras(
        referred("releases", "id", "master_id"), tables["masters"], sizes.extra_masters, seed
    )
    artists = _with_extras(
        referred("release_artists", "release_id", "artist_id"),
        tables["artists"], sizes.extra_artists, seed,
    )
    labels = _with_extras(
        referred("release_labels", "release_id", "label_id"),
        tables["labels"], sizes.extra_labels, seed,
    )
    releases = _with_extras(release_ids, tables["releases"], sizes.extra_releases, seed)

    kept = {
        "users": [("id", user_ids)],
        "artists": [("id", artists)],
        "labels": [("id", labels)],
        "masters": [("id", masters)],
        "releases": [("id", releases)],
        "release_artists": [("release_id", releases), ("artist_id", artists)],
        "release_labels": [("release_id", releases), ("label_id", labels)],
        "tracks": [("release_id", releases)],
        "user_collection": [("user_id", user_ids), ("release_id", releases)],
        "collection_folders": [("user_id", user_ids)],
        "sync_status": [("user_id", user_ids)],
        "data_sources": [],
    }
    subset = {}
    for name, conditions in kept.items():
        if name in tables:
            df = tables[name]
            for column, ids in conditions:
                df = keep_keys(df, ids, column, "id")
            subset[name] = df
    return subset
