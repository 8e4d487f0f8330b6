"""What is in the collections: summary, decades, years, genres, formats, top lists.

Every analysis covers all users; ``user_id`` narrows it to one. A release held by
very many users is collapsed to a count before it is joined to anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratework.functions.dates import effective_year
from cratework.functions.documents import list_column, struct_list_column
from cratework.operators.joins import keep_keys, left_lookup, owned_release_ids
from cratework.operators.ranking import percent_of, row_total, top_k


def _items(user_collection: DataFrame, user_id: int | None) -> DataFrame:
    if user_id is None:
        return user_collection
    return user_collection.where(F.col("user_id") == user_id)


def _owned_years(
    releases: DataFrame, user_collection: DataFrame, zero_year_is_null: bool
) -> DataFrame:
    """Owned copies by release: master_id, release_year, cached_year, copies."""
    cached = F.col("basic_information.year")
    released = F.year("released")
    if zero_year_is_null:
        cached, released = F.nullif(cached, F.lit(0)), F.nullif(released, F.lit(0))
    copies = user_collection.groupBy("release_id", cached.alias("cached_year")).agg(
        F.count("*").alias("copies")
    )
    return copies.join(
        releases.select("id", "master_id", released.alias("release_year")),
        F.col("release_id") == F.col("id"),
    ).select("master_id", "release_year", "cached_year", "copies")


def _master_years(masters: DataFrame, zero_year_is_null: bool) -> DataFrame:
    year = F.nullif("year", F.lit(0)) if zero_year_is_null else F.col("year")
    return masters.select(F.col("id").alias("_master"), year.alias("master_year"))


def _copies_by_year(
    releases: DataFrame, masters: DataFrame, user_collection: DataFrame, zero_year_is_null: bool
) -> DataFrame:
    """(year, copies) of all owned copies; the year may be NULL.

    A master is looked up only where the release date is unknown, and only once
    per master and cached year.
    """
    owned = _owned_years(releases, user_collection, zero_year_is_null)
    needed = owned.select(
        F.when(F.col("release_year").isNull(), F.col("master_id")).alias("master_id"),
        "release_year",
        "cached_year",
        "copies",
    )
    grouped = needed.groupBy("master_id", "release_year", "cached_year").agg(
        F.sum("copies").alias("copies")
    )
    years = left_lookup(
        grouped, _master_years(masters, zero_year_is_null), "master_id", "_master", "cached_year"
    )
    return years.select(
        effective_year("release_year", "master_year", "cached_year").alias("year"), "copies"
    )


def favorite_decade(
    releases: DataFrame,
    masters: DataFrame,
    user_collection: DataFrame,
    user_id: int | None = None,
    zero_year_is_null: bool = False,
) -> DataFrame:
    """decade_start, decade, release_count, percentage.

    All pressings of a master count once, at the earliest year; a release without
    a master counts once per collection row. Both kinds go through one grouping:
    mastered rows by master, the others by year.
    """
    owned = _owned_years(releases, _items(user_collection, user_id), zero_year_is_null)
    standalone = F.col("master_id").isNull()
    undated = F.col("release_year").isNull()
    grouped = owned.groupBy(
        "master_id",
        F.when(standalone, F.coalesce("release_year", "cached_year")).alias("own_year"),
    ).agg(
        F.sum("copies").alias("copies"),
        F.min("release_year").alias("release_year"),
        F.max(undated).alias("any_undated"),
        F.min(F.when(undated, F.col("cached_year"))).alias("cached_year"),
    )
    looked_up = left_lookup(
        grouped, _master_years(masters, zero_year_is_null), "master_id", "_master", "own_year"
    )
    # The earliest year of a master is the least over its dated and undated copies.
    undated_year = F.when(F.col("any_undated"), F.coalesce("master_year", "cached_year"))
    votes = looked_up.select(
        F.when(standalone, F.col("own_year"))
        .otherwise(F.least(F.col("release_year"), undated_year))
        .alias("year"),
        F.when(standalone, F.col("copies")).otherwise(F.lit(1)).alias("votes"),
    )
    decades = (
        votes.where(F.col("year").isNotNull())
        .groupBy(F.expr("(year div 10) * 10").alias("decade_start"))
        .agg(F.sum("votes").alias("release_count"))
    )
    # One row per decade is left, so a window over all of them is no bottleneck.
    total = F.sum("release_count").over(Window.partitionBy())
    return decades.select(
        "decade_start",
        F.concat(F.col("decade_start").cast("string"), F.lit("s")).alias("decade"),
        "release_count",
        percent_of(F.col("release_count"), total).alias("percentage"),
    ).orderBy(F.desc("release_count"), "decade_start")


def year_analysis(
    releases: DataFrame,
    masters: DataFrame,
    user_collection: DataFrame,
    limit: int | None = 30,
    user_id: int | None = None,
    zero_year_is_null: bool = False,
) -> DataFrame:
    """year, release_count: collection rows by effective year, most frequent first."""
    years = _copies_by_year(
        releases, masters, _items(user_collection, user_id), zero_year_is_null
    )
    counted = (
        years.where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.sum("copies").alias("release_count"))
    )
    return top_k(counted, limit, F.desc("release_count"), F.asc("year"))


def collection_summary(
    releases: DataFrame,
    masters: DataFrame,
    artists: DataFrame,
    labels: DataFrame,
    release_artists: DataFrame,
    release_labels: DataFrame,
    user_collection: DataFrame,
    user_id: int | None = None,
    approximate: bool = False,
    artist_counts: DataFrame | None = None,
    label_counts: DataFrame | None = None,
) -> DataFrame:
    """One row: total_releases, total_artists, total_labels, earliest_year, latest_year.

    ``total_releases`` counts collection rows. ``approximate`` estimates the two
    distinct counts with a sketch. ``count_artists`` and ``count_labels`` of the same
    collections, where they are there already, stand in for the links.
    """
    items = _items(user_collection, user_id)
    owned = owned_release_ids(items)

    def distinct_entities(
        links: DataFrame, key: str, entities: DataFrame, counts: DataFrame | None
    ) -> Column:
        if counts is not None:
            return row_total(keep_keys(counts.where("owned"), entities, key, "id"))
        linked = keep_keys(links.select("release_id", key), owned, "release_id", "release_id")
        if approximate:
            known = keep_keys(linked, entities, key, "id")
            return known.agg(F.approx_count_distinct(key).alias("n")).scalar()
        known = keep_keys(linked.select(key).distinct(), entities, key, "id")
        return row_total(known)

    # One row per owned release carries all that the years need of its copies.
    cached = F.col("basic_information.year")
    copies = items.groupBy("release_id").agg(
        F.count("*").alias("copies"),
        F.min(cached).alias("first_cached"),
        F.max(cached).alias("last_cached"),
    )
    stored = releases.select("id", "master_id", F.year("released").alias("release_year"))
    found = copies.join(stored, F.col("release_id") == F.col("id"), "left")
    dated = left_lookup(found, _master_years(masters, False), "master_id", "_master", "release_id")
    first = effective_year("release_year", "master_year", "first_cached")
    last = effective_year("release_year", "master_year", "last_cached")
    is_stored = F.col("id").isNotNull()
    return dated.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_releases"),
        F.min(F.when(is_stored, first)).alias("earliest_year"),
        F.max(F.when(is_stored, last)).alias("latest_year"),
    ).select(
        "total_releases",
        distinct_entities(release_artists, "artist_id", artists, artist_counts).alias("total_artists"),
        distinct_entities(release_labels, "label_id", labels, label_counts).alias("total_labels"),
        "earliest_year",
        "latest_year",
    )


def count_artists(
    release_artists: DataFrame, user_collection: DataFrame, user_id: int | None = None
) -> DataFrame:
    """artist_id, release_count, owned: distinct owned releases per artist, always owned."""
    owned = owned_release_ids(user_collection, user_id)
    links = keep_keys(
        release_artists.select("release_id", "artist_id"), owned, "release_id", "release_id"
    )
    counts = links.groupBy("artist_id").agg(F.countDistinct("release_id").alias("release_count"))
    return counts.withColumn("owned", F.lit(True))


def count_labels(
    release_labels: DataFrame, releases: DataFrame, user_collection: DataFrame
) -> DataFrame:
    """label_id, release_count, owned: links to stored releases, and if any release is owned.

    One pass of the links by release, which meet one row per release that tells both.
    """
    stored = releases.select("id", F.lit(True).alias("stored"), F.lit(False).alias("owned"))
    held = user_collection.select("release_id", F.lit(False), F.lit(True))
    flags = stored.union(held).groupBy("id").agg(F.max("stored").alias("stored"), F.max("owned").alias("owned"))
    links = release_labels.select("release_id", "label_id")
    return (
        links.join(flags, F.col("release_id") == F.col("id"))
        .groupBy("label_id")
        .agg(F.count_if("stored").alias("release_count"), F.max("owned").alias("owned"))
    )


def top_artists(
    artists: DataFrame,
    release_artists: DataFrame,
    user_collection: DataFrame,
    limit: int | None = 20,
    user_id: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """artist_name, release_count: distinct owned releases per credited artist, any role.

    Counting by id comes first, so the artist table meets one row per artist and
    no hot artist reaches a join. ``counts`` are those of ``count_artists``, if there already.
    """
    if counts is None:
        counts = count_artists(release_artists, user_collection, user_id)
    named = counts.join(
        artists.select("id", F.col("name").alias("artist_name")), F.col("artist_id") == F.col("id")
    )
    best = top_k(named, limit, F.desc("release_count"), F.asc("artist_name"), F.asc("artist_id"))
    return best.select("artist_name", "release_count")


def releases_by_label(
    labels: DataFrame,
    release_labels: DataFrame,
    releases: DataFrame,
    limit: int | None = 20,
    counts: DataFrame | None = None,
) -> DataFrame:
    """label_name, release_count: label links to stored releases, collection or not.

    ``counts`` are those of ``count_labels``, if there already.
    """
    if counts is None:
        links = keep_keys(
            release_labels.select("release_id", "label_id"), releases, "release_id", "id"
        )
        counts = links.groupBy("label_id").agg(F.count("*").alias("release_count"))
    else:
        counts = counts.where("release_count > 0")
    named = counts.join(
        labels.select("id", F.col("name").alias("label_name")), F.col("label_id") == F.col("id")
    )
    best = top_k(named, limit, F.desc("release_count"), F.asc("label_name"), F.asc("label_id"))
    return best.select("label_name", "release_count")


def longest_tracks(tracks: DataFrame, releases: DataFrame, limit: int | None = 10) -> DataFrame:
    """release_title, track_title, duration, duration_seconds of the longest tracks."""
    timed = tracks.where(F.col("duration_seconds").isNotNull()).select(
        "release_id", "position", F.col("title").alias("track_title"), "duration",
        "duration_seconds",
    )
    order = [
        F.desc("duration_seconds"), F.asc("release_id"), F.asc("position"), F.asc("track_title"),
    ]
    if limit is not None:
        # So many stored releases have a track of that length or more: shorter ones needn't move.
        longest = timed.groupBy("release_id").agg(F.max("duration_seconds").alias("longest"))
        longest = keep_keys(longest, releases, "release_id", "id")
        first = longest.orderBy(F.desc("longest")).limit(limit)
        cut = first.agg(F.when(F.count("*") >= limit, F.min("longest"))).scalar()
        timed = timed.where(cut.isNull() | (F.col("duration_seconds") >= cut))
    # The texts of releases are fetched for the winners alone.
    best = top_k(keep_keys(timed, releases, "release_id", "id"), limit, *order)
    titled = best.join(
        releases.select("id", F.col("title").alias("release_title")),
        F.col("release_id") == F.col("id"),
    )
    return titled.orderBy(*order).select(
        "release_title", "track_title", "duration", "duration_seconds"
    )


def multiple_copies(
    releases: DataFrame,
    masters: DataFrame,
    user_collection: DataFrame,
    limit: int | None = 10,
    user_id: int | None = None,
) -> DataFrame:
    """release_name, copy_count of masters with more than one distinct owned release."""
    owned = owned_release_ids(user_collection, user_id)
    pressings = keep_keys(
        releases.select("id", "master_id").where(F.col("master_id") > 0), owned, "id", "release_id"
    )
    counts = (
        pressings.groupBy("master_id")
        .agg(F.count("*").alias("copy_count"))
        .where(F.col("copy_count") > 1)
    )
    named = counts.join(
        masters.select("id", F.col("title").alias("release_name")),
        F.col("master_id") == F.col("id"),
    )
    best = top_k(named, limit, F.desc("copy_count"), F.asc("release_name"), F.asc("master_id"))
    return best.select("release_name", "copy_count")


def _shares(
    releases: DataFrame, values: Column, name: str, user_collection: DataFrame, limit: int | None
) -> DataFrame:
    """Owned releases per list element and their share of all collection rows.

    Repeats are dropped inside the list, so counting rows counts releases and the
    only wide shuffle is on release ids.
    """
    owned = keep_keys(releases, owned_release_ids(user_collection), "id", "release_id")
    counts = (
        owned.select(F.explode(F.array_distinct(values)).alias(name))
        .groupBy(name)
        .agg(F.count("*").alias("release_count"))
    )
    best = top_k(counts, limit, F.desc("release_count"), F.asc(name))
    share = percent_of(F.col("release_count"), row_total(user_collection))
    return best.select(name, "release_count", share.alias("percentage"))


def genre_analysis(
    releases: DataFrame,
    user_collection: DataFrame,
    limit: int | None = 20,
    user_id: int | None = None,
) -> DataFrame:
    """genre, release_count, percentage. The genre list may be typed or JSON text."""
    narrow = releases.select("id", "genres")
    values = list_column(narrow, "genres")
    return _shares(narrow, values, "genre", _items(user_collection, user_id), limit)


def format_analysis(
    releases: DataFrame,
    user_collection: DataFrame,
    limit: int | None = 20,
    user_id: int | None = None,
) -> DataFrame:
    """format, release_count, percentage; a format without a name forms its own group."""
    narrow = releases.select("id", "formats")
    names = F.transform(
        struct_list_column(narrow, "formats", "struct<name:string>"), lambda f: f["name"]
    )
    return _shares(narrow, names, "format", _items(user_collection, user_id), limit)
