"""Shredding of nested release documents into link and track tables.

Duplicates only ever occur inside one document, so they are removed inside the
row: no shuffle is needed to shred any number of releases.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratework.functions import duration_seconds
from cratework.operators.joins import keep_keys


class Shredded(NamedTuple):
    release_artists: DataFrame
    release_labels: DataFrame
    tracks: DataFrame


def _without_repeats(items: Column, *key: str) -> Column:
    """Elements of a sorted array that differ from their predecessor in ``key``.

    ``items`` must be a stored column: it is read again for every element.
    """

    def is_first(item: Column, index: Column) -> Column:
        before = F.get(items, index - 1)
        same = [item[name] == before[name] for name in key]
        matched = same[0]
        for condition in same[1:]:
            matched = matched & condition
        return (index == 0) | ~matched

    return F.filter(items, is_first)


def _credits(column: str, section: int, role) -> Column:
    return F.transform(
        F.coalesce(F.col(column), F.array()),
        lambda credit, position: F.struct(
            credit["id"].cast("bigint").alias("artist_id"),
            role(credit).alias("role"),
            F.lit(section).alias("section"),
            position.alias("position"),
            F.coalesce(credit["name"], F.lit("")).alias("name"),
            credit["anv"].alias("anv"),
            credit["join"].alias("join_relation"),
            credit["tracks"].alias("tracks"),
        ),
    )


def shred_artists(releases: DataFrame) -> DataFrame:
    """One row per (release, artist, role); the first credit in list order wins.

    Main artists come before extra artists and carry the empty role. Credits
    without an id are dropped.
    """
    every = F.concat(
        _credits("artists", 0, lambda credit: F.lit("")),
        _credits("extraartists", 1, lambda credit: F.coalesce(credit["role"], F.lit(""))),
    )
    usable = F.filter(every, lambda c: c["artist_id"].isNotNull() & (c["artist_id"] != 0))
    rows = releases.select(F.col("id").alias("release_id"), F.sort_array(usable).alias("credits"))
    first = _without_repeats(F.col("credits"), "artist_id", "role")
    return rows.select("release_id", F.explode(first).alias("c")).select(
        "release_id", "c.artist_id", "c.role", "c.name", "c.anv", "c.join_relation", "c.tracks"
    )


def shred_labels(releases: DataFrame) -> DataFrame:
    """One row per (release, label, catalogue number); references without id are dropped."""
    element = releases.schema["labels"].dataType.elementType
    numbers = [name for name in ("catno", "catalog_number") if name in element.fieldNames()]

    def reference(label: Column) -> Column:
        catalogue = [F.nullif(label[name], F.lit("")) for name in numbers]
        return F.struct(
            label["id"].cast("bigint").alias("label_id"),
            F.coalesce(*catalogue, F.lit("")).alias("catalog_number"),
        )

    usable = F.filter(
        F.transform(F.col("labels"), reference),
        lambda r: r["label_id"].isNotNull() & (r["label_id"] != 0),
    )
    return releases.select(
        F.col("id").alias("release_id"), F.explode(F.array_distinct(usable)).alias("r")
    ).select("release_id", "r.label_id", "r.catalog_number")


def shred_tracks(releases: DataFrame) -> DataFrame:
    """One row per track with a title, its duration also in seconds; repeats are kept."""
    titled = F.filter("tracklist", lambda t: F.nullif(t["title"], F.lit("")).isNotNull())
    return releases.select(F.col("id").alias("release_id"), F.explode(titled).alias("t")).select(
        "release_id",
        F.coalesce("t.position", F.lit("")).alias("position"),
        "t.title",
        "t.duration",
        duration_seconds("t.duration").alias("duration_seconds"),
        F.col("t.type_").alias("type"),
    )


def shred(releases: DataFrame) -> Shredded:
    """Link and track tables of all given releases."""
    return Shredded(shred_artists(releases), shred_labels(releases), shred_tracks(releases))


def shred_only(releases: DataFrame, release_ids: DataFrame) -> Shredded:
    """Link and track tables of the releases named in ``release_ids.release_id``."""
    return shred(keep_keys(releases, release_ids, "id", "release_id"))
