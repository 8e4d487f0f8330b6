"""The store: exclusive commits, tidying, buckets, counters and rejects."""

import itertools
import os
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cratework.functions import contains_ci
from cratework.operators import search
from cratework.operators.merge import replace_children
from cratework.plans import load
from cratework.sources.snapshots import Change, SnapshotStore, buckets_for
from tests.test_load import collect_ids, own, store  # noqa: F401

pytestmark = pytest.mark.usefixtures("small_jobs")


def rows_by_id(store, rows, table="masters"):
    return store.spark.createDataFrame([(i, t) for i, t in rows], "id long, title string")


def titles(store, table="masters"):
    return {r["id"]: r["title"] for r in store.read(table).collect()}


def upsert_masters(store, rows):
    incoming = rows_by_id(store, rows)
    store.publish({"masters": load.refreshed(store, "masters", incoming)})


def test_of_two_publishers_one_wins(store):
    """Both see the same version, and commit at once: one commit is made."""
    log = store._log
    entry = {"changes": []}
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda _: log.folder.put_new("00000000000000000001.json", "{}"), range(8)))
    assert sum(done) == 1
    assert not log.commit(1, entry) and log.commit(2, entry) and not log.commit(2, entry)
    assert not [n for n in log.folder.entries() if n.startswith(".")]


def test_a_lost_publish_stops_nobody(store):
    store.append({"users": store.spark.createDataFrame([(1, "one")], "id long, username string")})
    # What a lost job may leave: staged rows without a commit, and a commit's draft.
    left = Path(store.root) / "users" / "load=lost"
    store.spark.range(5).selectExpr("id").write.parquet(str(left))
    (Path(store.root) / "_log" / ".00000000000000000002.json.x").write_text('{"chan')
    other = SnapshotStore(store.spark, store.root)
    assert collect_ids(other, "users") == [1]
    other.append({"users": store.spark.createDataFrame([(2, "two")], "id long, username string")})
    assert collect_ids(store.refreshed(), "users") == [1, 2]
    assert store.vacuum() == [] and left.exists()
    assert store.vacuum(hours=-1) == ["users/load=lost"] and not left.exists()
    assert [n for n in os.listdir(Path(store.root) / "_log") if n.startswith(".")] == []
    assert collect_ids(store.refreshed(), "users") == [1, 2]


def test_reads_list_few_files_however_many_publishes(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=2, most_folders=4, state_every=5)
    want = {}
    for i in range(14):
        store.append({"masters": rows_by_id(store, [(i, f"t{i}")])})
        want[i] = f"t{i}"
    upsert_masters(store, [(3, "new"), (99, "more")])
    want |= {3: "new", 99: "more"}
    assert titles(store) == want and titles(SnapshotStore(spark, store.root)) == want
    assert len(store._table("masters")["folders"]) <= 5
    opened = []
    read = store._log.folder.read
    store._log.folder.read = lambda name: opened.append(name) or read(name)
    assert titles(store.refreshed()) == want and len(opened) <= 5
    # Older versions can be read until they are forgotten.
    version = store.version()
    before = titles(store.at(version - 1))
    assert before != want and len(before) == 14
    gone = store.vacuum(keep=2, hours=-1)
    assert len(gone) > 10 and titles(store.refreshed()) == want
    assert titles(store.at(version - 1)) == before
    assert len(list((Path(store.root) / "masters").iterdir())) < 9
    assert len(list((Path(store.root) / "_log").glob("*.json"))) <= 6
    store.vacuum(keep=1, hours=-1)
    assert store.vacuum(keep=50, hours=-1) == []  # as far back as the log goes
    upsert_masters(store, [(4, "newer")])
    assert titles(store) == want | {4: "newer"}


def test_buckets_grow_with_a_table(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=2, grain=1)
    few = spark.range(20).selectExpr("id", "'old' AS title")
    store.append({"masters": few})
    assert store.n_buckets("masters") == 4
    store.append({"masters": spark.range(20, 400).selectExpr("id", "'old' AS title")})
    n = store.n_buckets("masters")
    assert n == 16 and {f["buckets"] for f in store._table("masters")["folders"].values()} == {2, 4}
    upsert_masters(store, [(7, "new"), (150, "new")])
    want = {i: "new" if i in (7, 150) else "old" for i in range(400)}
    assert titles(store) == want and titles(store.refreshed()) == want
    # Only buckets of the changed keys were written, in their number of now.
    newest = max(store._table("masters")["folders"].values(), key=lambda f: f["buckets"])
    assert newest["buckets"] == n and newest["rows"] < 0.4 * 400
    for i in range(7, 9):
        upsert_masters(store, [(i, "newer")])
        want[i] = "newer"
    buckets = store.buckets_of("masters", spark.range(9, 10))
    some = {r["id"] for r in store.read("masters", buckets).collect()}
    assert 9 in some and len(some) < 100
    assert titles(store) == want
    store.compact("masters")
    assert titles(store) == want and len(store._table("masters")["folders"]) == 1
    assert buckets_for(10**6, 16) == 512 and buckets_for(0, 16) == 16
    assert buckets_for(40_000, 16) == 32 and buckets_for(10**10, 16) == 65_536


def test_a_small_load_rewrites_little(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), grain=100)
    store.replace({"masters": spark.range(20_000).selectExpr("id", "'old' AS title")})
    store.compact("masters")
    upsert_masters(store, [(i * 997, "new") for i in range(5)])
    newest = min(store._table("masters")["folders"].values(), key=lambda f: f["rows"])
    assert newest["rows"] < 0.1 * 20_000
    assert Counter(titles(store).values()) == {"old": 19_995, "new": 5}


def exchanges_over_scans(df):
    """Exchanges that have a scan of a stored table below them, but no other exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    found = []
    for i, line in enumerate(plan):
        if re.search(r"\bExchange (hash|range|Round)", line):
            depth = re.search(r"[A-Za-z*(]", line).start()
            below = itertools.takewhile(lambda x: re.search(r"[A-Za-z*(]", x).start() > depth, plan[i + 1 : -1])
            below = list(below)
            if any("Scan" in x for x in below) and not any("Exchange" in x for x in below):
                found.append(line)
    return found


def test_stored_tables_join_where_they_lie(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.replace(
        {
            "releases": spark.range(900).selectExpr("id", "'t' AS title"),
            "release_labels": spark.range(900).selectExpr("id AS release_id", "id % 7 AS label_id", "'' AS catalog_number"),
            "tracks": spark.range(900).selectExpr("id AS release_id", "'1' AS position"),
        }
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        labels, releases = store.read("release_labels"), store.read("releases")
        joined = labels.join(releases, F.col("release_id") == F.col("id"))
        counted = joined.groupBy("label_id").count()
        assert len(exchanges_over_scans(joined)) == 0
        assert counted.count() == 7 and sum(r["count"] for r in counted.collect()) == 900
        new = spark.range(5).selectExpr("id AS release_id", "'9' AS position")
        stored = store.read("tracks", store.buckets_of("tracks", new))
        merged = replace_children(stored, new.withColumns({c: F.lit(None) for c in ("title", "duration", "duration_seconds", "type")}), "release_id")
        over = exchanges_over_scans(merged)
        assert not [x for x in over if "Scan parquet" in x] and merged.where("position = '9'").count() == 5
        plan = merged._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
        assert scans and all("SelectedBucketsCount" in s for s in scans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_only_buckets_of_the_owned_are_opened(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    rows = spark.range(500)
    store.replace(
        {
            "releases": rows.selectExpr("id", "'t' AS title"),
            "release_artists": rows.selectExpr("id AS release_id", "id AS artist_id", "'' AS role"),
            "release_labels": rows.selectExpr("id AS release_id", "id AS label_id", "'' AS catalog_number"),
            "tracks": rows.selectExpr("id AS release_id", "'1' AS position"),
        }
    )
    own(store, 7)
    for table, found in load.owned_tables(store).items():
        key = "id" if table == "releases" else "release_id"
        assert [r[key] for r in found.collect()] == [7]
        files = {f for f in found.inputFiles() if f"/{table}/" in f}
        assert len(files) < len(store.read(table).inputFiles()) / 8
    # A prune writes only buckets that lose rows again.
    own(store, *range(499))
    before = set(store.read("tracks").inputFiles())
    load.prune_store(store)
    after = set(store.read("tracks").inputFiles())
    assert collect_ids(store) == list(range(499)) and len(before - after) == 1
    before = store.version()
    load.prune_store(store)
    assert store.version() == before


def test_a_load_leaves_its_counters_and_rejects(store, tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    records = "".join(f"<artist><id>{i}</id><name>n{i}</name></artist>" for i in range(1, 30))
    bad = "<artist><id>x5</id><name>five</name></artist><artist><id>77</id></artist><artist><id>78</id><name>a</b></artist>"
    (folder / "x_20240101_artists.xml").write_text(f"<artists>{records}{bad}</artists>")
    load.load_all(store, str(folder), max_error_rate=0.5)
    counted = {r["table_name"]: r for r in store.read("load_counters").collect()}
    assert (counted["artists"]["created"], counted["artists"]["updated"], counted["artists"]["written"]) == (29, 0, 29)
    rejects = {r["reason"]: r for r in store.read("rejects").collect()}
    assert sorted(rejects) == ["no name", "no numeric id", "not readable"]
    assert rejects["no numeric id"]["fragment"] == "<artist><id>x5</id><name>five</name></artist>"
    assert rejects["no name"]["position"]["file"].endswith("artists.xml")
    # What can be mended is loaded, and is no reject any more; what is stored is left as it is.
    assert load.replay_rejects(store, "artists") == 0
    mended = F.regexp_replace(F.regexp_replace("fragment", "x5", "55"), "</b>", "</name>")
    assert load.replay_rejects(store, "artists", mended) == 2
    assert {55, 78} <= set(collect_ids(store, "artists"))
    assert [r["reason"] for r in store.read("rejects").collect()] == ["no name"]
    taken = F.regexp_replace("fragment", "<id>77</id>", "<id>3</id><name>other</name>")
    assert load.replay_rejects(store, "artists", taken) == 1
    assert store.read("artists").where("id = 3").first()["name"] == "n3"
    assert store.read("rejects").isEmpty()


NAMES = ["Red Plate", "red", "Bored", "plAte", "ÉRed", "re", "", None, "a%b_c", "redredred", "Plates of Red"]


@pytest.mark.parametrize("text", ["RED", "plate", "re", "", "r%d", "red%plate", "_ed p", "é", "xyz", "redr"])
def test_names_found_by_trigrams_are_those_of_a_scan(spark, text):
    names = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")
    found = search.with_text(names, search.postings(names, "artists"), "artists", text)
    scanned = names.where(contains_ci("name", text))
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in scanned.collect())


def test_a_search_reads_few_names_and_knows_new_ones(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    names = spark.range(600).selectExpr("id", "concat('name ', char(97 + id % 26), char(97 + id % 25), 'q', id) AS name")
    store.publish({"artists": Change(names), **load.name_changes(store, "artists", names)})
    found = load.artists_named(store, "ABQ")
    assert {r["id"] for r in found.collect()} == {r["id"] for r in names.where("name LIKE '%abq%'").collect()}
    everything = len(store.read("artists").inputFiles())
    assert len([f for f in found.inputFiles() if "/artists/" in f]) < everything
    # A renamed artist is found by the new name, and no more by the old one.
    renamed = spark.createDataFrame([(0, "Other")], "id long, name string")
    changes = {"artists": load.refreshed(store, "artists", renamed)}
    store.publish({**changes, **load.name_changes(store, "artists", renamed)})
    assert [r["id"] for r in load.artists_named(store, "other").collect()] == [0]
    assert 0 not in {r["id"] for r in load.artists_named(store, "aaq").collect()}
    short = names.where("name LIKE '%th%' AND id <> 0")
    assert {r["id"] for r in load.artists_named(store, "th").collect()} == {0} | {r["id"] for r in short.collect()}


def test_a_read_of_all_buckets_names_none(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=2, grain=1)
    store.append({"masters": spark.range(400).selectExpr("id", "'t' AS title")})
    n = store.n_buckets("masters")
    whole = store.read("masters", list(range(n)))
    assert n > 2 and " IN " not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert collect_ids(store, "masters") == sorted(r["id"] for r in whole.collect()) == list(range(400))
    some = store.read("masters", [0, 3])
    places = {r["b"] for r in some.selectExpr(f"pmod(hash(id), {n}) AS b").collect()}
    assert places == {0, 3}


def test_owned_tables_pass_over_the_collection_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    rows = spark.range(50)
    store.replace({
        "releases": rows.selectExpr("id", "'t' AS title"),
        "tracks": rows.selectExpr("id AS release_id", "'1' AS position"),
    })
    own(store, 7, 7, 9)
    spark.sparkContext.setJobGroup("owned", "")
    found = load.owned_tables(store)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("owned"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 4
    assert sorted(r["id"] for r in found["releases"].collect()) == [7, 9]
    assert sorted(r["release_id"] for r in found["tracks"].collect()) == [7, 9]
