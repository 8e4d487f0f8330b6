import json

import pytest
from pyspark.sql import functions as F

from cratework import schemas
from cratework.operators.missing import missing_entities
from cratework.plans import load, sync
from cratework.sources import json_documents
from cratework.sources.snapshots import SnapshotStore
from cratework.streaming import collection_stream

pytestmark = pytest.mark.usefixtures("small_jobs")

USER = 1


def item(instance, release, rating=5, notes=None, added="2019-11-05T21:08:30-07:00"):
    basic = {"title": "T", "year": 2013, "master_id": 9, "genres": ["Rock"],
             "formats": [{"name": "Vinyl", "qty": "1", "descriptions": ["LP"]}],
             "labels": [{"name": "L", "catno": "C", "id": 3, "resource_url": "u"}],
             "artists": [{"name": "A", "anv": "", "join": "", "role": "", "tracks": "", "id": 4}]}
    if release is not None:
        basic["id"] = release
    return {"id": 1, "instance_id": instance, "date_added": added, "rating": rating,
            "folder_id": 1, "notes": notes, "basic_information": basic}


def write_page(folder, name, items):
    folder.mkdir(exist_ok=True)
    page = {"pagination": {"page": 1, "pages": 1, "per_page": 100, "items": len(items), "urls": {}},
            "releases": items}
    (folder / f"{name}.json").write_text(json.dumps(page, indent=2), encoding="utf-8")


FIRST = [item(1, 100, notes=[{"field_id": 3, "value": "sleeve worn"}]), item(2, 200, 0, notes=[]),
         item(3, None), item(4, 0), item(5, 300, rating=9), item(6, 100, notes="plain")]


def read_items(spark, folder):
    return json_documents.collection_items(
        json_documents.read_pages(spark, str(folder)), USER
    )


def stored(spark):
    return spark.createDataFrame([], schemas.TABLES["user_collection"])


def test_items(spark, tmp_path):
    write_page(tmp_path / "p", "a", FIRST)
    rows = {r["instance_id"]: r for r in read_items(spark, tmp_path / "p").collect()}
    assert len(rows) == 6
    assert rows[1]["notes"] == '[{"field_id":3,"value":"sleeve worn"}]'
    assert rows[2]["notes"] is None and rows[2]["rating"] == 0 and rows[6]["notes"] == "plain"
    assert rows[3]["release_id"] is None and rows[4]["release_id"] is None
    assert rows[1]["basic_information"]["artists"][0]["id"] == 4
    assert rows[1]["basic_information"]["formats"][0]["descriptions"] == ["LP"]


def test_sync_skips_known_items_unless_forced(spark, tmp_path):
    write_page(tmp_path / "p", "a", FIRST)
    items = read_items(spark, tmp_path / "p")
    first = sync.sync_collection(stored(spark), items)
    assert first.counters.first().asDict() == {
        "added": 3, "updated": 0, "unchanged": 0, "errors": 3
    }
    assert sorted(r["instance_id"] for r in first.collection.collect()) == [1, 2, 6]
    assert sorted(r["instance_id"] for r in first.rejected.collect()) == [3, 4, 5]

    write_page(tmp_path / "q", "a", [item(1, 111, rating=2), item(7, 700)])
    again = read_items(spark, tmp_path / "q")
    second = sync.sync_collection(first.collection, again)
    rows = {r["instance_id"]: r for r in second.collection.collect()}
    assert sorted(rows) == [1, 2, 6, 7] and rows[1]["rating"] == 5
    assert second.counters.first()["unchanged"] == 1

    forced = sync.sync_collection(first.collection, again, force=True)
    rows = {r["instance_id"]: r for r in forced.collection.collect()}
    assert sorted(rows) == [1, 2, 6, 7]
    assert rows[1]["rating"] == 2 and rows[1]["release_id"] == 100 and rows[1]["notes"] is None
    assert forced.counters.first()["updated"] == 1


def test_sync_is_idempotent(spark, tmp_path):
    write_page(tmp_path / "p", "a", FIRST + [item(1, 100, rating=1, added="2022-01-01T00:00:00Z")])
    items = read_items(spark, tmp_path / "p")
    once = sync.sync_collection(stored(spark), items).collection
    twice = sync.sync_collection(once, items).collection
    assert content(once) == content(twice)
    assert once.where("instance_id = 1").first()["rating"] == 1


def test_missing_entities(spark, tmp_path):
    write_page(tmp_path / "p", "a", FIRST)
    collection = sync.sync_collection(stored(spark), read_items(spark, tmp_path / "p")).collection
    releases = spark.createDataFrame(
        [(100, 9, [(4, "A"), (5, "B"), (None, "C")], [(3, "L")]), (101, 0, None, None)],
        "id bigint, master_id bigint, artists array<struct<id:bigint,name:string>>, "
        "labels array<struct<id:bigint,name:string>>",
    )
    ids = spark.createDataFrame([(4,)], "id bigint")
    none = ids.where("false")
    rows = missing_entities(collection, releases, ids, none, none).collect()
    assert sorted(map(tuple, rows)) == [
        ("artist", 5), ("label", 3), ("master", 9), ("release", 200)
    ]


def run_stream(spark, landing, root, seed=None, **options):
    store = SnapshotStore(spark, str(root))
    if seed is not None:
        store.replace({"user_collection": seed})
    items = collection_stream.stream_items(spark, str(landing), USER, **options)
    collection_stream.start_sync(items, store, USER).awaitTermination()
    return store.refreshed().read("user_collection")


def test_sync_job_and_documents_into_the_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    write_page(tmp_path / "p", "a", FIRST)
    missing = load.sync_pages(store, str(tmp_path / "p"), "ann")
    assert sorted(map(tuple, missing.collect())) == [("release", 100), ("release", 200)]
    documents = tmp_path / "documents.json"
    documents.write_text(
        "\n".join(
            json.dumps(
                {"id": i, "title": f"T{i}", "released": "1985-05", "master_id": 9,
                 "artists": [{"id": 4, "name": "A"}, {"id": 4, "name": "Again"}],
                 "labels": [{"id": 3, "name": "L", "catno": "C"}],
                 "tracklist": [{"position": "1", "title": "S", "duration": "2:00"}]}
            )
            for i in (100, 200)
        )
    )
    load.merge_documents(store, str(documents), "releases", json_lines=True)
    first = store.read("releases").where("id = 100").first()
    load.merge_documents(store, str(documents), "releases", json_lines=True)
    second = store.read("releases").where("id = 100").first()
    assert second["created_at"] == first["created_at"] < second["updated_at"]
    assert store.read("release_artists").count() == 2 and store.read("tracks").count() == 2
    assert sorted(r["duration_seconds"] for r in store.read("tracks").collect()) == [120, 120]
    missing = load.sync_pages(store, str(tmp_path / "p"), "ann")
    assert sorted(map(tuple, missing.collect())) == [("artist", 4), ("label", 3), ("master", 9)]
    assert store.read("user_collection").count() == 3 and store.read("users").count() == 1
    statuses = [(r["records_processed"], r["status"]) for r in store.read("sync_status").collect()]
    assert statuses == [(6, "partial")] * 2
    assert store.read("data_sources").where("source_type = 'collection'").count() == 2


def content(df):
    return sorted(map(repr, df.drop("created_at").collect()))


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    landing, root = tmp_path / "p", tmp_path / "root"
    write_page(landing, "a", FIRST)
    run_stream(spark, landing, root)
    write_page(landing, "b", [item(1, 111, rating=2), item(7, 700)])
    write_page(landing, "c", [item(7, 700), item(8, 800)])
    run_stream(spark, landing, root, files_per_batch=1)
    again = run_stream(spark, landing, root)
    assert again.count() == 5
    batch = sync.sync_collection(stored(spark), read_items(spark, landing)).collection
    rows = {r["instance_id"]: r["rating"] for r in again.collect()}
    assert sorted(rows) == sorted(r["instance_id"] for r in batch.collect())
    assert rows[1] == 5  # the stored item wins over the one sent again
    store = SnapshotStore(spark, str(root))
    rejected = collection_stream.rejected_items(store, USER)
    assert sorted(r["instance_id"] for r in rejected.collect()) == [3, 4, 5]
    # Three batches were published, each with its status and provenance.
    status = store.read("sync_status").groupBy().sum("records_processed").first()[0]
    assert store.read("data_sources").count() == 3 and status == len(FIRST) + 4


def test_stream_batch_replay_gives_the_same_rows(spark, tmp_path):
    landing, root = tmp_path / "p", tmp_path / "root"
    write_page(landing, "a", FIRST)
    before = content(run_stream(spark, landing, root))
    # A batch whose commit was lost runs again, and finds that it was published.
    for name in ("0", ".0.crc"):
        (root / "_stream" / f"user={USER}" / "commits" / name).unlink()
    assert content(run_stream(spark, landing, root)) == before


def test_stream_is_seeded_with_the_stored_collection(spark, tmp_path):
    write_page(tmp_path / "p", "a", FIRST)
    write_page(tmp_path / "s", "a", [item(1, 999, rating=1)])
    seed = sync.sync_collection(stored(spark), read_items(spark, tmp_path / "s")).collection
    rows = run_stream(spark, tmp_path / "p", tmp_path / "root", seed)
    assert {r["instance_id"]: r["release_id"] for r in rows.collect()} == {1: 999, 2: 200, 6: 100}


def test_users_are_created_once(spark):
    users = spark.createDataFrame([(7, "ann")], "id bigint, username string")
    names = spark.createDataFrame([("ann",), ("bob",), ("bob",), ("cy",)], "username string")
    rows = {r["username"]: r["id"] for r in sync.ensure_users(users, names).collect()}
    assert set(rows) == {"ann", "bob", "cy"} and rows["ann"] == 7
    assert len(set(rows.values())) == 3 and min(rows["bob"], rows["cy"]) > 7


def test_documents_from_files(spark, tmp_path):
    document = {"id": 1, "title": "T", "released": "1999-03", "artists": [{"id": 5, "name": "A"}],
                "labels": [{"id": 6, "name": "L", "catno": "C"}], "estimated_weight": 230,
                "identifiers": [{"type": "Barcode", "value": "1"}], "unknown": {"x": 1}}
    path = tmp_path / "release.json"
    path.write_text(json.dumps(document, indent=1))
    row = json_documents.read_documents(spark, str(path), "releases").first()
    assert str(row["released"]) == "1999-03-01" and row["artists"][0]["id"] == 5
    assert row["genres"] == [] and row["videos"] == [] and row["estimated_weight"] == 230
    assert row["identifiers"][0]["value"] == "1" and row["labels"][0]["catno"] == "C"
