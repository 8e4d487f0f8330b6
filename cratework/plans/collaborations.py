"""Releases that credit two given artists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratework.functions import contains_ci
from cratework.operators.joins import keep_keys


def artist_collaborations(
    artists: DataFrame, release_artists: DataFrame, releases: DataFrame, artist1: str, artist2: str
) -> DataFrame:
    """id, title, released, country of releases crediting two different artists whose
    names contain ``artist1`` and ``artist2`` (ASCII case ignored).

    One grouping per release replaces the self join of its credits: a pair of
    different artists exists exactly if both names are found and the matching
    artists are not all the same one.
    """
    matching = artists.select(
        F.col("id").alias("matched_id"),
        contains_ci("name", artist1).alias("first"),
        contains_ci("name", artist2).alias("second"),
    ).where("first or second")
    credits = release_artists.select("release_id", "artist_id").join(
        matching, F.col("artist_id") == F.col("matched_id")
    )
    shared = (
        credits.groupBy("release_id")
        .agg(
            F.max("first").alias("first"),
            F.max("second").alias("second"),
            F.min("artist_id").alias("lowest"),
            F.max("artist_id").alias("highest"),
        )
        .where("first and second and lowest <> highest")
    )
    return (
        keep_keys(releases.select("id", "title", "released", "country"), shared, "id", "release_id")
        .orderBy(F.desc("released"), "title", "id")
    )


def collaborations_by_id(
    release_artists: DataFrame, releases: DataFrame, artist1: int, artist2: int
) -> DataFrame:
    """Titles of releases crediting both artist ids, once per pair of their credits."""
    credits = release_artists.select("release_id", "artist_id").where(
        F.col("artist_id").isin(artist1, artist2)
    )
    pairs = (
        credits.groupBy("release_id")
        .agg(
            F.count_if(F.col("artist_id") == artist1).alias("first"),
            F.count_if(F.col("artist_id") == artist2).alias("second"),
        )
        .where("first > 0 and second > 0")
    )
    titled = pairs.join(releases.select("id", "title"), F.col("release_id") == F.col("id"))
    repeats = F.sequence(F.lit(1).cast("bigint"), F.col("first") * F.col("second"))
    return titled.select("title", F.explode(repeats).alias("_pair")).select("title")
