import gzip

import pytest
from pyspark.sql import functions as F

from cratework import schemas
from cratework.operators.filters import ReleaseStrategy
from cratework.operators.quality import LoadRejected
from cratework.plans import load
from cratework.sources.snapshots import Change, SnapshotStore, StalePublish

pytestmark = pytest.mark.usefixtures("small_jobs")


def dump(folder, kind, body, day="20250601"):
    path = folder / f"x_{day}_{kind}.xml.gz"
    path.write_bytes(gzip.compress(f"<{kind}>{body}</{kind}>".encode()))
    return str(path)


def release(i, master, title="R", artist=1, label=1, tracks=1):
    credit = f"<artists><artist><id>{artist}</id><name>A</name></artist></artists>"
    listed = "".join(
        f"<track><position>{n}</position><title>{title} {n}</title><duration>1:0{n}</duration></track>"
        for n in range(tracks)
    )
    return (
        f'<release id="{i}"><title>{title}</title><master_id>{master}</master_id>{credit}'
        f'<labels><label name="L" catno="c" id="{label}"/></labels>'
        f"<tracklist>{listed}</tracklist></release>"
    )


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


@pytest.fixture
def dumps(tmp_path):
    folder = tmp_path / "dumps"
    folder.mkdir()
    dump(folder, "artists", "<artist><id>1</id><name>A</name></artist>"
         "<artist><id>2</id><name>B</name></artist>")
    dump(folder, "labels", '<label><id>1</id><name>L</name><sublabels><label id="2">M</label>'
         "</sublabels></label>")
    dump(folder, "masters", '<master id="456"><title>M</title></master>')
    dump(folder, "releases", release(123, 456) + release(999, 456) + release(888, 777, artist=2)
         + release(5, 0, artist=1))
    return folder


def collect_ids(store, table="releases", column="id"):
    return sorted(r[0] for r in store.read(table).select(column).collect())


def own(store, *release_ids):
    items = store.spark.createDataFrame(
        [(1, r, r) for r in release_ids], "user_id bigint, release_id bigint, instance_id bigint"
    )
    store.replace({"user_collection": items})


def test_full_load(store, dumps):
    assert load.load_all(store, str(dumps)) == dict.fromkeys(
        ("artists", "labels", "masters", "releases"), True
    )
    assert collect_ids(store) == [5, 123, 888, 999]
    assert collect_ids(store, "labels") == [1]
    assert store.read("release_artists").count() == 4
    assert store.read("release_labels").count() == 4
    tracks = store.read("tracks")
    assert tracks.count() == 4 and tracks.where("duration_seconds = 60").count() == 4
    sources = {r["source_type"]: r for r in store.read("data_sources").collect()}
    assert sources["releases"]["record_count"] == 4
    assert str(sources["releases"]["source_date"]) == "2025-06-01"
    assert store.read("releases").where("created_at is null").count() == 0
    for table in ("artists", "labels", "masters", "releases", "tracks"):
        declared = store.spark.createDataFrame([], schemas.TABLES[table]).schema
        written = store.spark.read.parquet(store.read(table).inputFiles()[0]).schema
        assert [(f.name, f.dataType.simpleString()) for f in written] == [
            (f.name, f.dataType.simpleString()) for f in declared
        ]
    # Every file is loaded once; a later file of the same kind is not blocked.
    assert not any(load.load_all(store, str(dumps)).values())
    dump(dumps, "artists", "<artist><id>1</id><name>A2</name></artist>", day="20250701")
    assert load.load_all(store, str(dumps))["artists"]
    names = {r["id"]: r["name"] for r in store.read("artists").collect()}
    assert names == {1: "A2", 2: "B"}


def test_reload_keeps_created_at_and_replaces_tracks(store, dumps):
    load.load_all(store, str(dumps))
    before = store.read("releases").where("id = 123").first()
    dump(dumps, "releases", release(123, 456, "New", tracks=2) + release(7, 0), day="20250701")
    load.load_all(store, str(dumps))
    after = store.read("releases").where("id = 123").first()
    assert after["title"] == "New" and after["created_at"] == before["created_at"]
    assert after["updated_at"] > before["updated_at"]
    assert store.read("tracks").where("release_id = 123").count() == 2
    assert store.read("tracks").count() == 6
    assert store.read("release_artists").count() == 5


@pytest.mark.parametrize(
    "strategy, expected",
    [
        (ReleaseStrategy("all"), [5, 123, 888, 999]),
        (ReleaseStrategy("no such strategy"), [5, 123, 888, 999]),
        (ReleaseStrategy("skip"), []),
        (ReleaseStrategy("collection_only"), [123]),
        (ReleaseStrategy("collection_only", include_master_releases=True), [123, 999]),
        (ReleaseStrategy("selective", include_master_releases=True), [123, 999]),
        (ReleaseStrategy("selective", include_artist_releases=True, max_releases_per_artist=1),
         [5, 123]),
        (ReleaseStrategy("selective", include_label_releases=True), [5, 123, 888, 999]),
    ],
)
def test_strategies(store, dumps, strategy, expected):
    own(store, 123)
    path = str(dumps / "x_20250601_releases.xml.gz")
    assert load.load_dump(store, path, "releases", strategy) == bool(expected)
    assert collect_ids(store) == expected
    assert set(collect_ids(store, "release_artists", "release_id")) == set(expected)


def test_collection_only_needs_a_collection(store, dumps):
    path = str(dumps / "x_20250601_releases.xml.gz")
    assert not load.load_dump(store, path, "releases", ReleaseStrategy("collection_only"))
    assert collect_ids(store) == []


def test_master_seeds_include_stored_releases(store, dumps):
    load.load_dump(store, dump(dumps, "releases", release(123, 456), day="20250501"), "releases")
    own(store, 123)
    later = dump(dumps, "releases", release(999, 456) + release(888, 777), day="20250701")
    load.load_dump(
        store, later, "releases", ReleaseStrategy("collection_only", include_master_releases=True)
    )
    assert collect_ids(store) == [123, 999]


def test_too_many_bad_records_publish_nothing(store, dumps):
    path = dump(dumps, "masters", '<master id="1"><title>A</title></master><master/>' * 3)
    with pytest.raises(LoadRejected):
        load.load_dump(store, path, "masters")
    assert collect_ids(store, "masters") == [] and store.read("data_sources").isEmpty()
    assert load.load_dump(store, path, "masters", max_error_rate=1.0)


@pytest.mark.parametrize("kind", ["releases", "labels"])
def test_truncated_dump_publishes_nothing(store, tmp_path, kind):
    path = tmp_path / f"x_20250601_{kind}.xml"
    record = release(1, 0) if kind == "releases" else "<label><id>1</id><name>L</name></label>"
    path.write_text(f"<{kind}>{record}" + record[:20])
    with pytest.raises(LoadRejected):
        load.load_dump(store, str(path), kind)
    assert store.read(kind).isEmpty()


def test_repeated_ids_in_a_dump_give_one_row(store, dumps):
    path = dump(dumps, "artists", "<artist><id>1</id><name>A</name></artist>" * 3, day="20250801")
    load.load_dump(store, path, "artists")
    assert collect_ids(store, "artists") == [1]


def test_clear_and_reprocess(store, dumps):
    load.load_all(store, str(dumps))
    load.reprocess_links(store)
    assert store.read("release_artists").count() == 4 and store.read("tracks").count() == 4
    load.clear(store, "artists")
    assert collect_ids(store, "artists") == []
    assert load.load_all(store, str(dumps)) == {
        "artists": True, "labels": False, "masters": False, "releases": False
    }
    assert collect_ids(store, "artists") == [1, 2]


def test_the_last_record_of_an_id_stays(store, dumps):
    def artist(name):
        return f"<artist><id>1</id><name>{name}</name></artist>"

    path = dump(dumps, "artists", artist("old") + artist("older") + artist("new"), day="20250801")
    load.load_dump(store, path, "artists")
    assert [r["name"] for r in store.read("artists").collect()] == ["new"]


def test_hidden_records_count_as_bad(store, dumps):
    broken = '<master id="1"><title>A</title>'
    path = dump(dumps, "masters", broken + '<master id="2"><title>B</title></master>')
    with pytest.raises(LoadRejected):
        load.load_dump(store, path, "masters")


def test_prune_store(store, dumps):
    load.load_all(store, str(dumps))
    own(store, 123)
    load.prune_store(store)
    assert collect_ids(store) == [123]
    for table in ("release_artists", "release_labels", "tracks"):
        assert set(collect_ids(store, table, "release_id")) == {123}


def test_a_change_leaves_other_buckets_alone(store):
    users = store.spark.range(40).selectExpr("id AS user_id", "id AS instance_id", "id AS release_id")
    store.replace({"user_collection": users})

    def files():
        rows = store.read("user_collection").select(F.input_file_name().alias("file"))
        return {r["file"] for r in rows.distinct().collect()}

    before = files()
    change = users.where("user_id = 7").selectExpr("user_id", "instance_id", "99L AS release_id")
    buckets = store.buckets_of("user_collection", change)
    assert len(buckets) == 1
    rest = store.read("user_collection", buckets).where("user_id <> 7")
    store.publish({"user_collection": Change(rest.unionByName(change, True), buckets)})
    after = store.read("user_collection")
    assert before - files() == {f for f in before if f"/bucket={buckets[0]}/" in f}
    got = {r["user_id"]: r["release_id"] for r in after.collect()}
    assert got == {i: 99 if i == 7 else i for i in range(40)}
    store.append({"user_collection": change.selectExpr("user_id", "5L AS instance_id")})
    assert store.read("user_collection").count() == 41
    store.compact("user_collection")
    assert store.read("user_collection").count() == 41


def test_a_stale_publish_is_refused(store):
    other = SnapshotStore(store.spark, store.root)
    row = store.spark.createDataFrame([(1, "one")], "id long, username string")
    assert other.version() == store.version()
    store.append({"users": row})
    with pytest.raises(StalePublish):
        other.append({"users": row})
    assert store.read("users").count() == 1
    other.refreshed().append({"users": row})
    assert other.read("users").count() == 2
