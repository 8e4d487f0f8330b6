"""The named analyses over one set of catalogue tables, and the all-analyses report."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from cratework.operators.sinks import metric_rows, write_report
from cratework.plans import collaborations, collection, pressings
from cratework.session import dropped, written

Tables = Mapping[str, DataFrame]


def summary(t: Tables, user_id: int | None = None) -> DataFrame:
    return collection.collection_summary(
        t["releases"], t["masters"], t["artists"], t["labels"], t["release_artists"],
        t["release_labels"], t["user_collection"], user_id=user_id,
        artist_counts=t.get("artist_counts") if user_id is None else None,
        label_counts=t.get("label_counts") if user_id is None else None,
    )


# Analyses that need nothing but the tables and a row limit.
ANALYSES: dict[str, Callable[[Tables, int | None], DataFrame]] = {
    "summary": lambda t, limit: summary(t),
    "decades": lambda t, limit: collection.favorite_decade(
        t["releases"], t["masters"], t["user_collection"]
    ),
    "top_artists": lambda t, limit: collection.top_artists(
        t["artists"], t["release_artists"], t["user_collection"], limit,
        counts=t.get("artist_counts"),
    ),
    "top_labels": lambda t, limit: collection.releases_by_label(
        t["labels"], t["release_labels"], t["releases"], limit, counts=t.get("label_counts")
    ),
    "longest_tracks": lambda t, limit: collection.longest_tracks(t["tracks"], t["releases"], limit),
    "multiple_copies": lambda t, limit: collection.multiple_copies(
        t["releases"], t["masters"], t["user_collection"], limit
    ),
    "genres": lambda t, limit: collection.genre_analysis(
        t["releases"], t["user_collection"], limit
    ),
    "formats": lambda t, limit: collection.format_analysis(
        t["releases"], t["user_collection"], limit
    ),
    "years": lambda t, limit: collection.year_analysis(
        t["releases"], t["masters"], t["user_collection"], limit
    ),
}

# Analyses of pressings; they list rows and take no limit.
PRESSINGS: dict[str, Callable[[Tables], DataFrame]] = {
    "release_country": lambda t: pressings.release_country(t["releases"], t["masters"]),
    "first_press": lambda t: pressings.first_press(
        t["releases"], t["masters"], t["user_collection"], t["users"]
    ),
    "originality": lambda t: pressings.originality(
        t["releases"], t["masters"], t["user_collection"]
    ),
    "collection_audit": lambda t: pressings.collection_audit(
        t["releases"], t["masters"], t["user_collection"]
    ),
}


def analyse(tables: Tables, name: str, limit: int | None = 20) -> DataFrame:
    """One analysis by name."""
    if name in PRESSINGS:
        return PRESSINGS[name](tables)
    return ANALYSES[name](tables, limit)


def collaborations_of(tables: Tables, artist1: str, artist2: str) -> DataFrame:
    return collaborations.artist_collaborations(
        tables["artists"], tables["release_artists"], tables["releases"], artist1, artist2
    )


def report(
    tables: Tables,
    folder: str,
    fmt: str = "csv",
    limit: int | None = 20,
    with_pressings: bool = False,
) -> None:
    """Run every analysis that needs no names and write each to its own folder.

    Those of pressings list rows, as many as there are; they are written if asked for. Links
    are moved once for all that count them: a row per artist and one per label are kept meanwhile.
    """
    items = tables["user_collection"]
    artist_counts = written(collection.count_artists(tables["release_artists"], items))
    label_counts = written(
        collection.count_labels(tables["release_labels"], tables["releases"], items)
    )
    tables = {**tables, "artist_counts": artist_counts, "label_counts": label_counts}
    results = {name: make(tables, limit) for name, make in ANALYSES.items()}
    if fmt == "csv":
        results["summary"] = metric_rows(results["summary"])
    if with_pressings:
        results |= {name: make(tables) for name, make in PRESSINGS.items()}
    write_report(results, folder, fmt)
    dropped(artist_counts, label_counts)
