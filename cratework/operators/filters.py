"""Which releases a load keeps, driven by what is in the collections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cratework.operators.joins import keep_keys, left_lookup, owned_release_ids


@dataclass(frozen=True)
class ReleaseStrategy:
    """``all``, ``skip``, ``collection_only`` or ``selective``; an unknown name keeps all.

    Without a cap all releases of the followed artists and labels are kept.
    """

    name: str = "all"
    include_master_releases: bool = False
    include_artist_releases: bool = False
    include_label_releases: bool = False
    max_releases_per_artist: int | None = None
    max_releases_per_label: int | None = None


def collection_masters(releases: DataFrame, user_collection: DataFrame) -> DataFrame:
    """Distinct ``master_id`` of owned releases; NULL and 0 are no master."""
    owned = keep_keys(
        releases.select("id", "master_id").where(F.col("master_id") != 0),
        owned_release_ids(user_collection),
        "id",
        "release_id",
    )
    return owned.select("master_id").distinct()


def releases_of_masters(releases: DataFrame, master_ids: DataFrame) -> DataFrame:
    """All pressings of the given masters."""
    return keep_keys(releases, master_ids, "master_id", "master_id")


def collection_only(
    releases: DataFrame,
    user_collection: DataFrame,
    include_master_releases: bool = False,
    stored_releases: DataFrame | None = None,
) -> DataFrame:
    """Owned releases and, if asked, every pressing of a master in a collection.

    Masters are found through the incoming releases and those already stored.
    """
    if not include_master_releases:
        return keep_keys(releases, owned_release_ids(user_collection), "id", "release_id")
    flagged = flag_collection(releases, user_collection, stored_releases)
    return keep_keys(releases, flagged.where("owned or via_master"), "id", "id")


def flag_collection(
    releases: DataFrame, user_collection: DataFrame, stored_releases: DataFrame | None = None
) -> DataFrame:
    """Per release id: is it owned, and does it share a master with an owned release.

    Only ids are shuffled here; the wide release rows follow in one semi join.
    """
    narrow = releases.select("id", "master_id")
    known = narrow
    if stored_releases is not None:
        known = known.unionByName(stored_releases.select("id", "master_id"))
    owned = owned_release_ids(user_collection).withColumn("_owned", F.lit(True))
    masters = collection_masters(known, user_collection).select(
        F.col("master_id").alias("_master"), F.lit(True).alias("_via")
    )
    flagged = narrow.join(owned, F.col("id") == F.col("release_id"), "left").drop("release_id")
    return left_lookup(flagged, masters, "master_id", "_master", "id").select(
        "id",
        F.coalesce("_owned", F.lit(False)).alias("owned"),
        F.coalesce("_via", F.lit(False)).alias("via_master"),
    )


def capped_releases(
    links: DataFrame,
    entity: str,
    owned: DataFrame,
    candidates: DataFrame,
    cap: int | None,
    stored_links: DataFrame | None = None,
) -> DataFrame:
    """Candidate releases of entities found on owned releases, at most ``cap`` per entity.

    Entities are found through incoming and stored links. Links are reduced to these before
    any are ranked. The lowest release ids are taken; Spark applies ``row_number <= cap`` in
    the map tasks too, so a hot entity shuffles at most ``cap`` rows per task.
    """
    pairs = links.select("release_id", entity)
    known = pairs
    if stored_links is not None:
        known = known.unionByName(stored_links.select("release_id", entity))
    entities = keep_keys(known, owned, "release_id", "release_id").select(entity).distinct()
    # Links of candidates first: they come by release, and fewer are then moved to their entity.
    probe = F.bitwise_not(entity).alias("_probe")
    open_links = keep_keys(pairs, candidates, "release_id", "id")
    if cap is not None:
        open_links = open_links.distinct()
    open_links = open_links.select("*", probe)
    # Joined by a key of its own, so that the rank below still cuts in the map tasks, and
    # Spark may split a hot entity of the join.
    pool = keep_keys(open_links, entities.select(probe), "_probe", "_probe").drop("_probe")
    if cap is None:
        return pool.select("release_id")
    rank = F.row_number().over(Window.partitionBy(entity).orderBy("release_id"))
    best = pool.withColumn("_rank", rank).where(F.col("_rank") <= cap)
    return best.select("release_id")


def selective(
    releases: DataFrame,
    user_collection: DataFrame,
    strategy: ReleaseStrategy,
    release_artists: DataFrame,
    release_labels: DataFrame,
    stored_releases: DataFrame | None = None,
    stored_artists: DataFrame | None = None,
    stored_labels: DataFrame | None = None,
) -> DataFrame:
    """Collection, then its masters, then releases of its artists and labels.

    Lazy: the flags are two columns of ids, and their exchanges are shared between branches.
    """
    flagged = flag_collection(releases, user_collection, stored_releases)
    keep = F.col("owned")
    if strategy.include_master_releases:
        keep = keep | F.col("via_master")
    wanted = flagged.where(keep).select(F.col("id").alias("release_id"))
    rest = flagged.where(~keep).select("id")
    owned = owned_release_ids(user_collection)
    for include, links, stored, entity, cap in (
        (strategy.include_artist_releases, release_artists, stored_artists, "artist_id",
         strategy.max_releases_per_artist),
        (strategy.include_label_releases, release_labels, stored_labels, "label_id",
         strategy.max_releases_per_label),
    ):
        if include:
            more = capped_releases(links, entity, owned, rest, cap, stored)
            wanted = wanted.unionByName(more)
    return keep_keys(releases, wanted, "id", "release_id")


def apply_strategy(
    releases: DataFrame,
    strategy: ReleaseStrategy,
    user_collection: DataFrame,
    release_artists: DataFrame | None = None,
    release_labels: DataFrame | None = None,
    stored_releases: DataFrame | None = None,
    stored_artists: DataFrame | None = None,
    stored_labels: DataFrame | None = None,
) -> DataFrame:
    """The releases that ``strategy`` lets into the catalogue."""
    if strategy.name == "skip":
        return releases.where(F.lit(False))
    if strategy.name == "collection_only":
        return collection_only(
            releases, user_collection, strategy.include_master_releases, stored_releases
        )
    if strategy.name == "selective":
        return selective(
            releases, user_collection, strategy, release_artists, release_labels,
            stored_releases, stored_artists, stored_labels,
        )
    return releases
