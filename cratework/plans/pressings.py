"""Original pressings: country, first press, originality score, collection audit."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratework.functions import contains_ci
from cratework.functions.documents import struct_list_column
from cratework.operators.joins import keep_keys, left_lookup, owned_release_ids
from cratework.operators.ranking import most_common

# Words that mark a later pressing.
NOTES_KEYWORDS = ("reissue", "repress", "re-issue", "re-press", "remaster", "anniversary")
FORMAT_KEYWORDS = ("Reissue", "Repress")

# Score weights.
SAME_YEAR = 1
MAIN_RELEASE = 2
NOTES_PENALTY = -1
FORMAT_PENALTY = -1

# Texts of the verdicts.
COUNTRY_UNKNOWN = "Unknown"
COUNTRY_MATCH = "Match"
COUNTRY_DIFFERENT = "Different"
IS_MAIN_RELEASE = "Main Release (Likely Original)"
LIKELY_ORIGINAL = "Likely Original Press"
LATER_PRESS = "Later Press/Reissue"
UNCERTAIN = "Uncertain"
NO_MASTER = "No Master Data"
NO_YEARS = "Missing Year Data"
SAME_YEAR_STATUS = "Same Year (Possible Original)"
BEFORE_MASTER = "Pre-Master (Check Data Quality)"
REASON_NO_MASTER = "No master relationship"
REASON_NO_YEAR = "Missing release year"
REASON_NO_MASTER_YEAR = "Missing master year"
REASON_OTHER_YEAR = "Different years"
REASON_NONE = "Included in strict query"


def verdict(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The text of the first rule that holds; a rule that is NULL doesn't."""
    text = F.lit(otherwise)
    for holds, found in reversed(rules):
        text = F.when(holds, found).otherwise(text)
    return text


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    """One scan for any of the words, ASCII case ignored."""
    return text.rlike("(?i)" + "|".join(words))


def master_countries(
    masters: DataFrame, releases: DataFrame, wanted: DataFrame | None = None
) -> DataFrame:
    """_master, master_title, master_year, main_release_id, master_country per master.

    The country is that of the main release; a master without one takes the most
    common country of its releases. ``wanted.master_id`` says which masters are asked
    for; countries are counted only over the releases of those without a main release.
    """
    head = masters.select(
        F.col("id").alias("_master"),
        F.col("title").alias("master_title"),
        F.col("year").alias("master_year"),
        "main_release_id",
    )
    if wanted is not None:
        head = keep_keys(head, wanted, "_master", "master_id")
    main = releases.select(F.col("id").alias("_main"), F.col("country").alias("main_country"))
    without = head.where(F.col("main_release_id").isNull())
    pressings = keep_keys(
        releases.select("master_id", "country").where(F.col("country").isNotNull()),
        without, "master_id", "_master",
    )
    common = most_common(pressings, "master_id", "country").select(
        F.col("master_id").alias("_of"), F.col("country").alias("common_country")
    )
    found = left_lookup(head, main, "main_release_id", "_main", "_master")
    found = found.join(common, F.col("_master") == F.col("_of"), "left")
    country = F.when(F.col("main_release_id").isNotNull(), F.col("main_country")).otherwise(
        F.col("common_country")
    )
    return found.select(
        "_master", "master_title", "master_year", "main_release_id",
        country.alias("master_country"),
    )


def release_country(releases: DataFrame, masters: DataFrame) -> DataFrame:
    """Country of each release that has one, beside the country of its master."""
    placed = releases.where(F.col("country").isNotNull()).select(
        F.col("id").alias("release_id"),
        F.col("title").alias("release_title"),
        F.col("country").alias("release_country"),
        "master_id",
    )
    lookup = master_countries(masters, releases).select(
        "_master", F.col("_master").alias("known_master"), "master_title", "master_country"
    )
    return (
        left_lookup(placed, lookup, "master_id", "_master", "release_id")
        .select(
            "release_id", "release_title", "release_country",
            F.col("known_master").alias("master_id"), "master_title", "master_country",
        )
        .orderBy("release_title", "release_id")
    )


def _known_users(user_collection: DataFrame, users: DataFrame) -> DataFrame:
    return keep_keys(
        user_collection.select("user_id", "instance_id", "release_id", "rating", "date_added"),
        users, "user_id", "id",
    )


# Last sort keys of listings with a row per copy. Without them all copies of one
# release, or all copies of unknown releases, would sort into one partition.
COPY_KEYS = ("user_id", "instance_id")


def _per_copy(found: DataFrame, user_collection: DataFrame) -> DataFrame:
    """One row per collection row of the found releases, with rating and date."""
    copies = user_collection.select(
        *COPY_KEYS,
        F.col("release_id").alias("_owned"),
        "rating",
        F.col("date_added").alias("added_to_collection"),
    )
    return found.join(copies, F.col("release_id") == F.col("_owned")).drop("_owned")


def _names_text(column: Column, text: str) -> Column:
    """Does any text field of any credit contain ``text``."""
    fields = ("name", "anv", "join", "role", "tracks")
    return F.exists(
        column,
        lambda c: F.coalesce(
            reduce(or_, [F.coalesce(contains_ci(c[f], text), F.lit(False)) for f in fields]),
            F.lit(False),
        ),
    )


def artist_holdings(
    releases: DataFrame,
    masters: DataFrame,
    user_collection: DataFrame,
    users: DataFrame,
    text: str,
) -> DataFrame:
    """Owned copies whose release or master names ``text`` in its title or credits."""
    items = _known_users(user_collection, users)
    owned = keep_keys(
        releases.select(
            F.col("id").alias("release_id"),
            F.col("title").alias("release_title"),
            F.col("country").alias("release_country"),
            F.col("year").alias("release_year"),
            F.col("released").alias("release_date"),
            "master_id",
            F.coalesce(
                contains_ci("title", text) | _names_text(F.col("artists"), text), F.lit(False)
            ).alias("by_release"),
        ),
        owned_release_ids(items), "release_id", "release_id",
    )
    by_master = contains_ci("title", text)
    if "artists" in masters.columns:
        by_master = by_master | F.coalesce(_names_text(F.col("artists"), text), F.lit(False))
    named = masters.select(
        F.col("id").alias("_named"), F.coalesce(by_master, F.lit(False)).alias("by_master")
    )
    found = left_lookup(owned, named, "master_id", "_named", "release_id").where(
        F.col("by_release") | F.coalesce("by_master", F.lit(False))
    )
    lookup = master_countries(masters, releases, found.select("master_id")).withColumn(
        "known_master", F.col("_master")
    )
    found = left_lookup(found, lookup, "master_id", "_master", "release_id")
    return (
        _per_copy(found, items)
        .orderBy("release_year", "release_date", "release_title", "release_id", *COPY_KEYS)
        .select(
            "release_id", "release_title", "release_country", "release_year", "release_date",
            F.col("known_master").alias("master_id"), "master_title", "master_year",
            "master_country", "rating", "added_to_collection",
        )
    )


def _year(releases: DataFrame, year_from_released: bool) -> Column:
    return F.coalesce("year", F.year("released")) if year_from_released else F.col("year")


def first_press(
    releases: DataFrame,
    masters: DataFrame,
    user_collection: DataFrame,
    users: DataFrame,
    year_from_released: bool = False,
) -> DataFrame:
    """Owned copies whose release year is the master's, with a country comparison.

    The year test runs on releases alone, before copies multiply the rows.
    """
    items = _known_users(user_collection, users)
    dated = releases.select(
        F.col("id").alias("release_id"),
        F.col("title").alias("release_title"),
        F.col("country").alias("release_country"),
        _year(releases, year_from_released).alias("release_year"),
        F.col("released").alias("release_date"),
        "master_id",
    ).where(F.col("master_id").isNotNull() & F.col("release_year").isNotNull())
    # Countries are counted for masters of owned releases only.
    dated = keep_keys(dated, items, "release_id", "release_id")
    first = dated.join(
        master_countries(masters, releases, dated),
        (F.col("master_id") == F.col("_master")) & (F.col("release_year") == F.col("master_year")),
    )
    unknown = F.col("release_country").isNull() | F.col("master_country").isNull()
    status = verdict(
        [
            (unknown, COUNTRY_UNKNOWN),
            (F.col("release_country") == F.col("master_country"), COUNTRY_MATCH),
        ],
        COUNTRY_DIFFERENT,
    )
    return (
        _per_copy(first, items)
        .orderBy("master_year", "release_title", "release_id", *COPY_KEYS)
        .select(
            "release_id", "release_title", "release_country", "release_year", "release_date",
            "master_id", "master_title", "master_year", "master_country",
            status.alias("country_match_status"), "rating", "added_to_collection",
        )
    )


def originality(
    releases: DataFrame,
    masters: DataFrame,
    user_collection: DataFrame,
    year_from_released: bool = False,
) -> DataFrame:
    """Score and assessment per owned copy of a release with a known year and master year."""
    formats = struct_list_column(releases, "formats", "struct<descriptions:array<string>>")
    scored = releases.select(
        "id",
        "title",
        _year(releases, year_from_released).alias("release_year"),
        "country",
        "master_id",
        F.coalesce(_any_word(F.col("notes"), NOTES_KEYWORDS), F.lit(False)).alias("reworked"),
        F.coalesce(
            F.exists(
                F.get(formats, F.lit(0))["descriptions"], lambda d: _any_word(d, FORMAT_KEYWORDS)
            ),
            F.lit(False),
        ).alias("repressed"),
    ).where(F.col("master_id").isNotNull() & F.col("release_year").isNotNull())
    with_master = scored.join(
        masters.where(F.col("year").isNotNull()).select(
            F.col("id").alias("_master"), F.col("year").alias("master_year"), "main_release_id"
        ),
        F.col("master_id") == F.col("_master"),
    )
    is_main = F.coalesce(F.col("id") == F.col("main_release_id"), F.lit(False))
    same_year = F.col("release_year") == F.col("master_year")
    later = F.col("release_year") > F.col("master_year")
    assessment = verdict(
        [
            (is_main, IS_MAIN_RELEASE),
            (same_year & ~F.col("reworked"), LIKELY_ORIGINAL),
            (later, LATER_PRESS),
        ],
        UNCERTAIN,
    )
    parts = with_master.select(
        F.col("id").alias("release_id"),
        "title",
        "release_year",
        "master_year",
        "country",
        F.when(same_year, SAME_YEAR).otherwise(0).alias("same_year_score"),
        F.when(F.col("reworked"), NOTES_PENALTY).otherwise(0).alias("notes_score"),
        F.when(F.col("repressed"), FORMAT_PENALTY).otherwise(0).alias("format_score"),
        F.when(is_main, MAIN_RELEASE).otherwise(0).alias("main_release_score"),
        assessment.alias("assessment"),
    )
    copies = user_collection.select(F.col("release_id").alias("_owned"), *COPY_KEYS)
    score = (
        F.col("same_year_score")
        + F.col("main_release_score")
        + F.col("notes_score")
        + F.col("format_score")
    )
    return (
        parts.withColumn("originality_score", score)
        .join(copies, F.col("release_id") == F.col("_owned"))
        .orderBy(F.desc("originality_score"), "release_year", "release_id", *COPY_KEYS)
        .select(
            "release_id", "title", "release_year", "master_year", "country", "same_year_score",
            "notes_score", "format_score", "main_release_score", "originality_score", "assessment",
        )
    )


def collection_audit(
    releases: DataFrame,
    masters: DataFrame,
    user_collection: DataFrame,
    year_from_released: bool = False,
) -> DataFrame:
    """Status and exclusion reason of every collection row, stored release or not.

    The verdict is reached once per release and then joined to its copies.
    """
    owned = keep_keys(
        releases.select(
            "id", "title", _year(releases, year_from_released).alias("release_year"), "country",
            "master_id",
        ),
        owned_release_ids(user_collection), "id", "release_id",
    )
    lookup = masters.select(
        F.col("id").alias("_master"),
        F.col("id").alias("known_master"),
        F.col("year").alias("master_year"),
        "main_release_id",
    )
    known = left_lookup(owned, lookup, "master_id", "_master", "id")
    copies = user_collection.select("release_id", *COPY_KEYS)
    rows = copies.join(known, F.col("release_id") == F.col("id"), "left")
    release_year, master_year = F.col("release_year"), F.col("master_year")
    no_master = F.col("known_master").isNull()
    status = verdict(
        [
            (no_master, NO_MASTER),
            (release_year.isNull() | master_year.isNull(), NO_YEARS),
            (F.col("id") == F.col("main_release_id"), IS_MAIN_RELEASE),
            (release_year == master_year, SAME_YEAR_STATUS),
            (release_year < master_year, BEFORE_MASTER),
        ],
        LATER_PRESS,
    )
    reason = verdict(
        [
            (no_master, REASON_NO_MASTER),
            (release_year.isNull(), REASON_NO_YEAR),
            (master_year.isNull(), REASON_NO_MASTER_YEAR),
            (release_year != master_year, REASON_OTHER_YEAR),
        ],
        REASON_NONE,
    )
    return (
        rows.withColumn("status", status)
        .withColumn("exclusion_reason", reason)
        .orderBy("status", "release_year", "id", *COPY_KEYS)
        .select(
            "id", "title", "release_year", "master_year", "country", "status", "exclusion_reason"
        )
    )


def label_parents(labels: DataFrame) -> DataFrame:
    """Each label beside its direct parent; the parent name is NULL when not stored."""
    parents = labels.select(F.col("id").alias("_parent"), F.col("name").alias("parent_name"))
    return left_lookup(
        labels.select("id", "name", "parent_label_id"), parents, "parent_label_id", "_parent", "id"
    ).select("id", "name", "parent_label_id", "parent_name")
