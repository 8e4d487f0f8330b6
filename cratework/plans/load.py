"""Jobs over the stored tables.

Dump loads (land, check, filter, merge, shred, publish), merges of landed entity
documents, and the collection sync.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cratework.functions import dump_date
from cratework.operators import quality
from cratework.operators.filters import ReleaseStrategy, apply_strategy
from cratework.operators.merge import (
    emptied,
    insert_new,
    last_per_key,
    refresh,
    replace_children,
)
from cratework.operators.missing import missing_entities
from cratework.operators.prune import prune_releases
from cratework.operators.search import grams_of, postings, with_text
from cratework.operators.shred import Shredded, shred
from cratework.plans.collaborations import artist_collaborations
from cratework.plans.sync import new_users, sync_collection
from cratework.sources import json_documents, xml_dumps
from cratework.sources.positions import POSITION
from cratework.session import dropped, written
from cratework.sources.snapshots import KEYS, STATUS, Change, SnapshotStore

ARTIST_LINK = ["release_id", "artist_id", "role"]
LABEL_LINK = ["release_id", "label_id", "catalog_number"]


def land_dump(
    store: SnapshotStore, path: str, kind: str, snapshot: str, max_error_rate: float = 0.1
) -> DataFrame:
    """Parse a dump once into Parquet; raises if it is cut off or has too many bad records.

    One pass writes the accepted rows, and in a partition of their own the rejected records with
    their text, place and reason. A record that a broken one hides is a bad one too: records
    whose tag was opened are compared with those that were parsed.
    """
    spark = store.spark
    counters, tags = Observation("counters"), Observation("tags")
    records = xml_dumps.read_records(spark, path, kind, tags, keep_fragments=True)
    observed = records.observe(counters, *quality.load_counters(F.col("valid")))
    landing = store.landing(kind, snapshot)
    observed.write.mode("overwrite").partitionBy("valid").parquet(landing)
    found, seen = tags.get, counters.get
    xml_dumps.check_roots(found["opened"], found["closed"])
    if seen["processed"] == 0:
        raise quality.LoadRejected(f"no {kind} records in {path}")
    hidden = max(0, found["records"] - seen["processed"])
    quality.check_gate(seen["processed"] + hidden, seen["rejected"] + hidden, max_error_rate)
    return landed_rows(store, kind, snapshot)


def _landed(store: SnapshotStore, kind: str, snapshot: str) -> DataFrame:
    # Both partitions are named, as either may be empty.
    columns = xml_dumps.landed_schema(kind)
    return store.spark.read.schema(f"{columns}, valid boolean").parquet(store.landing(kind, snapshot))


def landed_rows(store: SnapshotStore, kind: str, snapshot: str) -> DataFrame:
    """The accepted rows of a landed dump."""
    return _landed(store, kind, snapshot).where("valid").drop("valid", "reason", "fragment")


def rejected_rows(store: SnapshotStore, snapshot: str, source_type: str, file_name: str) -> DataFrame:
    """The records of a landed dump that were rejected, with their text, place and reason."""
    return _landed(store, source_type, snapshot).where("NOT valid").select(
        F.lit(snapshot).alias("snapshot"),
        F.lit(source_type).alias("source_type"),
        F.lit(file_name).alias("file_name"),
        POSITION,
        "reason",
        "fragment",
    )


def replay_rejects(store: SnapshotStore, kind: str, mend: Column | str = "fragment") -> int:
    """Parse the stored rejects of a kind again, their text changed by ``mend``; how many passed.

    Rows that pass now are merged like a load's, unless their record is stored already: the table
    may have a newer state of it. They leave the rejects; the others stay, as they were.
    """
    stored = store.read("rejects").where(F.col("source_type") == kind)
    text = F.expr(mend) if isinstance(mend, str) else mend
    again = stored.withColumn("text", text)
    records = xml_dumps.checked(
        xml_dumps.parse_fragments(again, kind, "text", keep=("snapshot",)), kind, keep=("snapshot",)
    )
    passed = written(records.where("valid").drop("valid"))
    n = passed.count()
    if n:
        rows = last_per_key(passed.drop("snapshot"), ["id"], F.col(POSITION)).drop(POSITION)
        known = store.read(kind, store.buckets_of(kind, rows)).select("id")
        incoming = written(rows.join(known, "id", "left_anti"))
        changes = link_changes(store, shred(incoming), incoming) if kind == "releases" else {}
        changes[kind] = refreshed(store, kind, incoming)
        changes |= name_changes(store, kind, incoming)
        mended = passed.select("snapshot", POSITION)
        left = store.read("rejects").join(mended, ["snapshot", POSITION], "left_anti")
        changes["rejects"] = Change(left)
        job = {"snapshot": uuid.uuid4().hex, "source_type": kind, "file_name": "rejects"}
        store.publish(changes, job)
        dropped(incoming)
    dropped(passed)
    return n


def provenance_row(
    kind: str, file_name: str, loaded: DataFrame, snapshot: str, source_name: str = "xml_dump"
) -> DataFrame:
    """One row that tells of a load."""
    return loaded.agg(F.count("*").alias("record_count")).select(
        F.lit(kind).alias("source_type"),
        F.lit(source_name).alias("source_name"),
        F.current_timestamp().alias("last_updated"),
        F.lit(file_name).alias("file_name"),
        "record_count",
        dump_date(F.lit(file_name)).alias("source_date"),
        F.lit(snapshot).alias("snapshot"),
    )


def provenance(
    data_sources: DataFrame,
    kind: str,
    file_name: str,
    loaded: DataFrame,
    snapshot: str,
    source_name: str = "xml_dump",
) -> DataFrame:
    """The provenance table with a row for this load."""
    row = provenance_row(kind, file_name, loaded, snapshot, source_name)
    return data_sources.unionByName(row, allowMissingColumns=True)


def link_changes(store: SnapshotStore, parts: Shredded, releases: DataFrame) -> dict[str, Change]:
    """New links, and the tracks of the buckets that the releases are in.

    Shredded links are unique already; only new ones are written.
    """
    ids = releases.select(F.col("id").alias("release_id"))
    buckets = store.buckets_of("tracks", ids)

    def new(table: str, rows: DataFrame, key: list[str]) -> Change:
        near = store.read(table, store.buckets_of(table, ids))
        return Change(created(insert_new(near, rows, key, unique=True)), [])

    stored = store.read("tracks", buckets)
    return {
        "release_artists": new("release_artists", parts.release_artists, ARTIST_LINK),
        "release_labels": new("release_labels", parts.release_labels, LABEL_LINK),
        "tracks": Change(replace_children(stored, created(parts.tracks), "release_id"), buckets),
    }


def created(rows: DataFrame) -> DataFrame:
    """Rows that count as created where they are published."""
    return rows.withColumn(STATUS, F.lit("created"))


def name_changes(store: SnapshotStore, kind: str, incoming: DataFrame) -> dict[str, Change]:
    """Trigrams of incoming names that are not stored, for ``artists_named``.

    Those of a name that an artist no longer has stay, as a search tests what it finds.
    """
    if kind != "artists":
        return {}
    new = postings(incoming, kind)
    near = store.read("name_grams", store.buckets_of("name_grams", new))
    return {"name_grams": Change(insert_new(near, new, ["gram", "kind", "id"], unique=True), [])}


def artists_named(store: SnapshotStore, text: str) -> DataFrame:
    """Stored artists whose name contains ``text``, found by trigrams: other names aren't read."""
    grams = store.spark.createDataFrame([(g,) for g in grams_of(text)], "gram string")
    near = store.read("name_grams", store.buckets_of("name_grams", grams))
    if not grams_of(text):
        return with_text(store.read("artists"), near, "artists", text)
    wanted = near.where(F.col("gram").isin(grams_of(text))).select("id")
    artists = store.read("artists", store.buckets_of("artists", wanted))
    return with_text(artists, near, "artists", text)


def collaborations_named(store: SnapshotStore, first: str, second: str) -> DataFrame:
    """Releases that credit two different artists with these texts in their names."""
    artists = artists_named(store, first).unionByName(artists_named(store, second))
    return artist_collaborations(
        artists.dropDuplicates(["id"]),
        store.read("release_artists"),
        store.read("releases"),
        first,
        second,
    )


def refreshed(store: SnapshotStore, kind: str, incoming: DataFrame) -> Change:
    """The buckets of an entity table that some rows are in, with these merged."""
    buckets = store.buckets_of(kind, incoming)
    merged = refresh(store.read(kind, buckets), incoming, ["id"], status=STATUS)
    return Change(merged, buckets)


def load_dump(
    store: SnapshotStore,
    path: str,
    kind: str,
    strategy: ReleaseStrategy = ReleaseStrategy(),
    max_error_rate: float = 0.1,
    force: bool = False,
) -> bool:
    """Load one dump file; False when there was nothing to do.

    A file is loaded once unless ``force`` is set. Releases pass the strategy;
    with ``skip``, or ``collection_only`` before any collection, none are loaded.
    """
    file_name = path.rstrip("/").rsplit("/", 1)[-1]
    sources = store.read("data_sources")
    if not force and not sources.where(F.col("file_name") == file_name).isEmpty():
        return False
    if kind == "releases":
        if strategy.name == "skip":
            return False
        if strategy.name == "collection_only" and store.read("user_collection").isEmpty():
            return False
    snapshot = uuid.uuid4().hex
    landed = land_dump(store, path, kind, snapshot, max_error_rate)
    stored = store.read(kind)
    changes: dict[str, Change] = {}
    if kind == "releases":
        links = shred(landed) if strategy.name == "selective" else None
        landed = apply_strategy(
            landed,
            strategy,
            store.read("user_collection"),
            links and links.release_artists,
            links and links.release_labels,
            stored,
            store.read("release_artists"),
            store.read("release_labels"),
        )
    # As in the order of the file, the last record of an id stays.
    position = F.col(POSITION)
    incoming = last_per_key(landed, ["id"], position).drop(POSITION)
    # Filtered and made unique once, then read by the merge, the shredding and the count.
    kept = f"{store.landing(kind, snapshot)}_kept"
    incoming.write.mode("overwrite").parquet(kept)
    incoming = store.spark.read.parquet(kept)
    if kind == "releases":
        changes.update(link_changes(store, shred(incoming), incoming))
    changes[kind] = refreshed(store, kind, incoming)
    changes |= name_changes(store, kind, incoming)
    changes["data_sources"] = Change(provenance_row(kind, file_name, incoming, snapshot), [])
    job = {"snapshot": snapshot, "source_type": kind, "file_name": file_name}
    changes["rejects"] = Change(rejected_rows(store, **job), [])
    store.publish(changes, job)
    return True


def load_all(
    store: SnapshotStore,
    folder: str,
    strategy: ReleaseStrategy = ReleaseStrategy(),
    max_error_rate: float = 0.1,
    force: bool = False,
) -> dict[str, bool]:
    """Load the newest dump of each kind: artists, labels, masters, then releases."""
    done = {}
    for kind in xml_dumps.KINDS:
        files = xml_dumps.newest_dump(xml_dumps.dump_files(store.spark, folder, kind))
        newest = files.select("path").first()
        if newest is not None:
            done[kind] = load_dump(
                store, newest["path"], kind, strategy, max_error_rate, force
            )
    return done


def merge_documents(
    store: SnapshotStore, path: str, kind: str, json_lines: bool = False
) -> None:
    """Merge landed entity documents into their table; releases are shredded as well."""
    snapshot = uuid.uuid4().hex
    landing = store.landing(kind, snapshot)
    rows = json_documents.read_documents(store.spark, path, kind, json_lines)
    last_per_key(rows, ["id"], F.col(POSITION)).drop(POSITION).write.mode("overwrite").parquet(landing)
    incoming = store.spark.read.parquet(landing)
    changes = link_changes(store, shred(incoming), incoming) if kind == "releases" else {}
    changes[kind] = refreshed(store, kind, incoming)
    changes |= name_changes(store, kind, incoming)
    changes["data_sources"] = Change(provenance_row(kind, path, incoming, snapshot, "api"), [])
    store.publish(changes, {"snapshot": snapshot, "source_type": kind, "file_name": path})


def publish_items(
    store: SnapshotStore,
    items: DataFrame,
    user_id: int,
    snapshot: str,
    path: str,
    force: bool = False,
) -> None:
    """Landed items of a user into the stored collection, with status and provenance."""
    # Only the bucket of this user is read, and with ``force`` written.
    buckets = store.buckets_of("user_collection", items)
    stored = store.read("user_collection", buckets)
    synced = sync_collection(stored, items, force)
    status = synced.counters.select(
        F.lit(user_id).alias("user_id"),
        F.lit("collection").alias("sync_type"),
        F.current_timestamp().alias("last_sync"),
        F.expr("added + updated + unchanged + errors").alias("records_processed"),
        F.when(F.col("errors") > 0, "partial").otherwise("success").alias("status"),
        F.when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" items rejected")))
        .alias("error_message"),
    )
    collection = Change(synced.collection, buckets) if force else Change(synced.new, [])
    provenance = provenance_row("collection", path, items, snapshot, "api")
    store.publish(
        {
            "user_collection": collection,
            "sync_status": Change(status, []),
            "data_sources": Change(provenance, []),
        }
    )


def sync_pages(
    store: SnapshotStore, path: str, username: str, force: bool = False, json_lines: bool = False
) -> DataFrame:
    """Sync a user's landed collection pages; returns the entities named but not stored."""
    spark = store.spark
    names = spark.createDataFrame([(username,)], "username string")
    users = store.read("users")
    if users.where(F.col("username") == username).isEmpty():
        added = new_users(users, names).withColumn("created_at", F.current_timestamp())
        store.append({"users": added})
    user_id = store.read("users").where(F.col("username") == username).first()["id"]
    snapshot = uuid.uuid4().hex
    landing = store.landing("collection", snapshot)
    pages = json_documents.read_pages(spark, path, json_lines)
    json_documents.collection_items(pages, user_id).write.mode("overwrite").parquet(landing)
    items = spark.read.parquet(landing)
    publish_items(store, items, user_id, snapshot, path, force)
    # Forced, every release that the pages name is listed, to be fetched again.
    named = items if force else store.read("user_collection")
    stored = [store.read(t) for t in ("releases", "artists", "labels", "masters")]
    return missing_entities(named, *stored, force=force)


def reprocess_links(store: SnapshotStore) -> None:
    """Shred every stored release again."""
    releases = store.read("releases")
    store.publish(link_changes(store, shred(releases), releases))


def prune_store(store: SnapshotStore, keep_masters: bool = False) -> None:
    """Remove releases that no collection holds, with their links and tracks, all at once.

    Only buckets that lose rows are read in full and written again.
    """
    releases = store.read("releases")
    kept = prune_releases(releases.select("id", "master_id"), store.read("user_collection"), keep_masters)
    lost = written(releases.select("id").join(kept.select("id"), "id", "left_anti"))

    def without_lost(table: str) -> Change:
        key = KEYS[table]
        gone = lost.select(F.col("id").alias(key))
        buckets = store.buckets_of(table, gone)
        return Change(store.read(table, buckets).join(gone, key, "left_anti"), buckets)

    if not lost.isEmpty():
        tables = ("releases", "release_artists", "release_labels", "tracks")
        store.publish({table: without_lost(table) for table in tables})
    dropped(lost)


def owned_tables(store: SnapshotStore) -> dict[str, DataFrame]:
    """Releases in some collection, their links and tracks, of which no other bucket is opened."""
    owned = store.read("user_collection").select("release_id")
    return store.holding_each(("releases", "release_artists", "release_labels", "tracks"), owned)


def clear(store: SnapshotStore, kind: str) -> None:
    """Empty one table and forget its loads, so that its dumps can be loaded again."""
    store.replace(
        {
            kind: emptied(store.read(kind)),
            "data_sources": store.read("data_sources").where(F.col("source_type") != kind),
        }
    )
