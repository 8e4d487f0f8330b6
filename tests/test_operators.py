"""Small fixtures against brute force, properties, skewed inputs and plan shapes."""

import itertools
import random

from pyspark.sql import functions as F

from cratework.operators import filters, joins, merge, prune, ranking, sampling, sinks
from cratework.operators.quality import check_gate, quality_gate, split_valid, rating_in_range
from cratework.operators.shred import shred_artists, shred_labels, shred_tracks
from cratework.plans import collaborations, collection, pressings, registry

CREDIT = "struct<id:bigint,name:string,anv:string,join:string,role:string,tracks:string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -------------------------------------------------------------- hot and NULL keys
def skewed(spark, rows=3000):
    """A third of the facts have a NULL key and a third share one key."""
    data = [(i, None if i % 3 == 0 else 7 if i % 3 == 1 else i) for i in range(rows)]
    return spark.createDataFrame(data, "id bigint, key bigint")


def test_left_lookup_keeps_every_row_and_spreads_nulls(spark):
    facts = skewed(spark)
    lookup = spark.createDataFrame([(i, f"n{i}") for i in range(0, 3000, 2)], "k bigint, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = joins.left_lookup(facts, lookup, "key", "k", "id")
        got = {r["id"]: r["name"] for r in joined.collect()}
        sizes = (
            joined.where("key is null").groupBy(F.spark_partition_id().alias("p")).count().collect()
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    names = {i: f"n{i}" for i in range(0, 3000, 2)}
    assert got == {r["id"]: names.get(r["key"]) for r in facts.collect()}
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 300


def test_left_lookup_ignores_keys_equal_to_the_hash(spark):
    facts = spark.createDataFrame([(1, None)], "id bigint, key bigint")
    stray = facts.select(F.xxhash64("id").alias("k"), F.lit("wrong").alias("name"))
    assert joins.left_lookup(facts, stray, "key", "k", "id").first()["name"] is None


def test_hot_release_is_counted_in_full(spark):
    items = [(u, 1 if u % 3 else u, u, (1990,)) for u in range(900)]
    owned = spark.createDataFrame(
        items, "user_id bigint, release_id bigint, instance_id bigint, "
        "basic_information struct<year:int>"
    )
    releases = spark.createDataFrame(
        [(i, 5 if i == 1 else None) for i in range(900)], "id bigint, master_id bigint"
    ).withColumn("released", F.lit(None).cast("date"))
    masters = spark.createDataFrame([(5, 1971)], "id bigint, year int")
    years = {r["year"]: r["release_count"]
             for r in collection.year_analysis(releases, masters, owned).collect()}
    assert years == {1971: 600, 1990: 300}
    decades = {r["decade"]: r["release_count"]
               for r in collection.favorite_decade(releases, masters, owned).collect()}
    assert decades == {"1970s": 1, "1990s": 300}


def test_copies_of_a_hot_release_are_split_over_tasks(spark, tmp_path):
    """A third of all copies is one release; the join splits them, and keeps every row."""
    spark.range(60000).selectExpr(
        "id AS user_id", "id AS instance_id", "IF(id % 3 = 0, 5, id) AS release_id"
    ).repartition(8).write.parquet(str(tmp_path / "items"))
    owned = spark.read.parquet(str(tmp_path / "items"))
    releases = spark.range(50000).selectExpr(
        "id", "concat('title of ', id) AS title", "2000 AS year", "'UK' AS country",
        "id % 100 AS master_id", "CAST(NULL AS DATE) AS released"
    )
    masters = spark.range(100).selectExpr("id", "2000 AS year", "id AS main_release_id")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        audit = pressings.collection_audit(releases, masters, owned)
        sizes = audit.groupBy(F.spark_partition_id().alias("p")).count().collect()
        rows = audit.collect()
        final = plan(audit).split("== Initial Plan ==")[0]
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "skew=true" in final
    assert len(rows) == 60000 and sum(r["id"] == 5 for r in rows) == 20001
    # The sorted listing is spread too, although a third of it is one release.
    assert max(r["count"] for r in sizes) < 20000


# ---------------------------------------------------------------------- analyses
def test_collaborations_equal_the_pairwise_definition(spark):
    rng = random.Random(1)
    names = {1: "Ann Lee", 2: "ann", 3: "Lee", 4: "Bob", 5: "ANN BOB"}
    links = {(r, rng.randint(1, 5), rng.choice(["", "x"])) for r in range(60) for _ in range(3)}
    artists = spark.createDataFrame(list(names.items()), "id bigint, name string")
    release_artists = spark.createDataFrame(
        list(links), "release_id bigint, artist_id bigint, role string"
    )
    releases = spark.createDataFrame([(r, f"t{r}") for r in range(60)], "id bigint, title string")
    releases = releases.selectExpr("*", "CAST(NULL AS DATE) released", "'UK' country")
    for first, second in itertools.product(("ann", "lee", "bob", "zed"), repeat=2):
        want = {
            r1 for (r1, a1, _), (r2, a2, _) in itertools.product(links, links)
            if r1 == r2 and a1 != a2 and first in names[a1].lower() and second in names[a2].lower()
        }
        found = collaborations.artist_collaborations(
            artists, release_artists, releases, first, second
        )
        assert {r["id"] for r in found.collect()} == want
        assert found.count() == len(want)
    for a, b in ((1, 2), (3, 3)):
        want = sorted(
            f"t{r1}" for (r1, a1, _), (r2, a2, _) in itertools.product(links, links)
            if r1 == r2 and a1 == a and a2 == b
        )
        got = collaborations.collaborations_by_id(release_artists, releases, a, b)
        assert sorted(r["title"] for r in got.collect()) == want


def test_zero_year_counts_unless_excluded(spark):
    owned = spark.createDataFrame(
        [(1, 1, 1, (0,)), (1, 2, 2, (1984,))],
        "user_id bigint, release_id bigint, instance_id bigint, basic_information struct<year:int>",
    )
    releases = spark.createDataFrame([(1, None), (2, None)], "id bigint, master_id bigint")
    releases = releases.selectExpr("*", "CAST(NULL AS DATE) released")
    masters = spark.createDataFrame([], "id bigint, year int")
    decades = collection.favorite_decade(releases, masters, owned)
    assert {r["decade"] for r in decades.collect()} == {"0s", "1980s"}
    assert sum(r["percentage"] for r in decades.collect()) == 100.0
    strict = collection.favorite_decade(releases, masters, owned, zero_year_is_null=True)
    assert {r["decade"] for r in strict.collect()} == {"1980s"}


def test_master_country_of_a_main_release_without_country_is_null(spark):
    releases = spark.createDataFrame(
        [(1, 10, None), (2, 10, "UK"), (3, 20, "US"), (4, 20, "US"), (5, 20, "DE"), (6, 30, "FR"),
         (7, 30, "BE")],
        "id bigint, master_id bigint, country string",
    )
    masters = spark.createDataFrame(
        [(10, "A", 1, 1990), (20, "B", None, 1990), (30, "C", None, None), (40, "D", 99, None)],
        "id bigint, title string, main_release_id bigint, year int",
    )
    rows = pressings.master_countries(masters, releases).collect()
    assert {r["_master"]: r["master_country"] for r in rows} == {
        10: None, 20: "US", 30: "BE", 40: None
    }


def test_most_common_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "x")], "g bigint, v string")
    assert [tuple(r) for r in ranking.most_common(df, "g", "v").collect()] == [(1, "a")]


# --------------------------------------------------------------------- shredding
def test_shredding_matches_a_row_by_row_reading(spark):
    rng = random.Random(2)

    def credit():
        return (rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "N"]), str(rng.random()), None,
                rng.choice([None, "", "Producer"]), None)

    docs = [
        (i, [credit() for _ in range(rng.randint(0, 6))] or None,
         [credit() for _ in range(rng.randint(0, 6))])
        for i in range(200)
    ]
    releases = spark.createDataFrame(
        docs, f"id bigint, artists array<{CREDIT}>, extraartists array<{CREDIT}>"
    )
    want = {}
    for i, main, extra in docs:
        for c, role in [(c, "") for c in main or []] + [(c, c[4] or "") for c in extra]:
            if c[0]:
                want.setdefault((i, c[0], role), (c[1] or "", c[2]))
    rows = shred_artists(releases).collect()
    assert {(r["release_id"], r["artist_id"], r["role"]): (r["name"], r["anv"]) for r in rows} == want
    assert len(rows) == len(want)
    assert "Exchange" not in plan(shred_artists(releases))


def test_shred_labels_and_tracks(spark):
    releases = spark.createDataFrame(
        [(1, [(5, "", "X"), (5, "C", "X"), (5, "C", None), (None, "C", None), (0, "C", None),
              (6, None, None)], [("1", "T", "3:45", "track"), (None, "T", None, None),
                                 ("3", "", "1:00", None), (None, "T", None, None)]),
         (2, None, None)],
        "id bigint, labels array<struct<id:bigint,catno:string,catalog_number:string>>, "
        "tracklist array<struct<position:string,title:string,duration:string,type_:string>>",
    )
    assert sorted(map(tuple, shred_labels(releases).collect())) == [
        (1, 5, "C"), (1, 5, "X"), (1, 6, "")
    ]
    tracks = sorted(map(tuple, shred_tracks(releases).collect()), key=repr)
    assert tracks == [(1, "", "T", None, None, None)] * 2 + [(1, "1", "T", "3:45", 225, "track")]


# -------------------------------------------------------------- strategies, merges
def catalogue(spark, seed=3):
    rng = random.Random(seed)
    releases = spark.createDataFrame(
        [(i, rng.choice([None, 0, 1, 2, 3, 4])) for i in range(200)], "id bigint, master_id bigint"
    )
    owned = spark.createDataFrame(
        [(1, rng.randint(0, 260)) for _ in range(8)], "user_id bigint, release_id bigint"
    )
    return releases, owned


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def test_strategies_nest(spark):
    releases, owned = catalogue(spark)
    only = ids(filters.collection_only(releases, owned))
    expanded = ids(filters.collection_only(releases, owned, include_master_releases=True))
    assert only < expanded < ids(releases)
    # NULL and 0 are no master: none of their other releases comes along.
    unmastered = ids(releases.where("coalesce(master_id, 0) = 0"))
    assert expanded & unmastered == only & unmastered
    assert ids(prune.prune_releases(releases, owned)) == only
    assert ids(prune.prune_releases(releases, owned, keep_masters=True)) == expanded
    report = prune.prune_report(releases, owned).first()
    assert report["deleted_releases"] == 200 - len(only)


def test_caps_take_the_lowest_ids_before_the_shuffle(spark):
    links = spark.createDataFrame([(r, 1) for r in range(500)] + [(9, 2), (600, 2)],
                                  "release_id bigint, artist_id bigint")
    owned = spark.createDataFrame([(9,)], "release_id bigint")
    candidates = spark.range(1000).where("id <> 9")
    capped = filters.capped_releases(links, "artist_id", owned, candidates, 3)
    assert plan(capped).count("WindowGroupLimit") == 2
    assert sorted(r[0] for r in capped.collect()) == [0, 1, 2, 600]


def test_upsert_overwrites_with_null_and_keeps_the_rest(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id bigint, n string, keep string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id bigint, n string")
    rows = sorted(map(tuple, merge.upsert(stored, new, ["id"]).collect()))
    assert rows == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]


def test_insert_ignore_is_idempotent_and_unique(spark):
    stored = spark.createDataFrame([(1, "old")], "k bigint, v string")
    new = spark.createDataFrame([(1, "new"), (2, "new"), (2, "new")], "k bigint, v string")
    once = merge.insert_ignore(stored, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "old"), (2, "new")]
    assert merge.insert_ignore(once, new, ["k"]).count() == 2


def test_replace_children_leaves_parents_without_new_rows(spark):
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p bigint, t string")
    new = spark.createDataFrame([(1, "z"), (1, "z")], "p bigint, t string")
    rows = sorted(map(tuple, merge.replace_children(stored, new, "p").collect()))
    assert rows == [(1, "z"), (1, "z"), (2, "c")]
    assert merge.replace_children(stored, new.where("false"), "p").count() == 3
    assert merge.emptied(stored).count() == 0


# ------------------------------------------------------------ quality, sinks, sample
def test_quality(spark):
    df = spark.createDataFrame([(r,) for r in (None, 0, 5, 6, -1)], "rating int")
    good, bad = split_valid(df, rating_in_range())
    assert good.count() == 3 and sorted(r[0] for r in bad.collect()) == [-1, 6]
    row = quality_gate(df, rating_in_range()).first()
    assert (row["processed"], row["rejected"], row["passed"]) == (5, 2, False)
    assert quality_gate(df.where("false"), rating_in_range()).first()["passed"]
    check_gate(11, 1)
    check_gate(0, 0)


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT 'a,b' AS name, DATE'2020-01-02' AS day, CAST(NULL AS INT) AS n")
    sinks.write_csv(df, str(tmp_path / "csv"))
    read = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert (read["name"], read["day"], read["n"]) == ("a,b", "2020-01-02", None)
    sinks.write_json(df, str(tmp_path / "json"))
    line = spark.read.text(str(tmp_path / "json")).first()[0]
    assert line == '{"name":"a,b","day":"2020-01-02","n":null}'


def test_report_writes_every_analysis(spark, tmp_path):
    from cratework.sources.star_schema import StarSchemaCatalogue

    tables = StarSchemaCatalogue(spark, "/root/testdata/sf0.001").tables()
    registry.report(tables, str(tmp_path / "r"), "csv", limit=3)
    assert {p.name for p in (tmp_path / "r").iterdir()} == set(registry.ANALYSES)
    summary = spark.read.option("header", True).csv(str(tmp_path / "r/summary"))
    assert summary.columns == ["metric", "value"] and summary.count() == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "r/years")).count() == 3
    exact = registry.summary(tables).first()
    rough = collection.collection_summary(
        tables["releases"], tables["masters"], tables["artists"], tables["labels"],
        tables["release_artists"], tables["release_labels"], tables["user_collection"],
        approximate=True,
    ).first()
    assert abs(rough["total_artists"] - exact["total_artists"]) <= 0.2 * exact["total_artists"]
    one_user = registry.summary(tables, user_id=3).first()
    assert 0 < one_user["total_releases"] < exact["total_releases"]


def test_sample_is_closed_and_repeatable(spark, tmp_path):
    from cratework.sources.star_schema import StarSchemaCatalogue

    tables = StarSchemaCatalogue(spark, "/root/testdata/sf0.001").tables()
    sizes = sampling.SampleSizes(20, 5, 5, 5, 2)
    subset = sampling.closed_subset(tables, sizes)
    sinks.export_tables(subset, str(tmp_path / "s"))
    read = {name: spark.read.parquet(str(tmp_path / "s" / name)) for name in subset}
    for name, (table, column) in {
        "release_artists": ("artists", "artist_id"), "release_labels": ("labels", "label_id"),
        "tracks": ("releases", "release_id"),
    }.items():
        assert read[name].count() > 0
        assert read[name].join(read[table], F.col(column) == F.col("id"), "left_anti").isEmpty()
    masters = read["releases"].where("master_id is not null")
    known = masters.join(read["masters"], masters["master_id"] == read["masters"]["id"], "left_semi")
    assert known.count() >= masters.count() - sizes.extra_releases
    again = sampling.closed_subset(tables, sizes)
    assert ids(again["artists"]) == ids(read["artists"])


# ------------------------------------------------------------------- plan shapes
def test_no_query_crosses_or_broadcasts_unchecked(spark):
    from queries import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in QUERIES.items():
            if name == "sync_stream":
                continue
            text = plan(query(spark, "/root/testdata/sf0.001"))
            for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastExchange"):
                assert bad not in text, (name, bad)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_are_pruned_and_filters_pushed(spark, tmp_path):
    df = spark.range(100).selectExpr(
        "id", "id AS release_id", "'t' AS title", "'p' AS position", "'1:00' AS duration",
        "CAST(id AS INT) AS duration_seconds", "'x' AS unused",
    )
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    text = plan(collection.longest_tracks(stored, stored, 5))
    assert "unused" not in text and "TakeOrderedAndProject" in text
    assert "IsNotNull(duration_seconds)" in text


def test_counts_of_links_serve_the_summary_and_the_top_lists(spark):
    """Of stored, owned, unstored and missing releases, with repeats."""
    releases = spark.sql("SELECT id, NULL AS master_id, CAST(NULL AS DATE) AS released FROM VALUES (1L), (2L), (3L) AS t(id)")
    masters = spark.sql("SELECT 1L AS id, 1990 AS year")
    items = spark.sql(
        "SELECT r AS release_id, named_struct('year', 1990) AS basic_information FROM VALUES (1L), (1L), (9L), (NULL) AS t(r)"
    )
    links = spark.sql(
        """SELECT * FROM VALUES (1L, 10L, 'a'), (1L, 10L, 'b'), (2L, 10L, 'a'), (2L, 20L, 'a'), (9L, 30L, 'a'),
             (8L, 40L, 'a'), (NULL, 10L, 'a'), (1L, NULL, 'a') AS t(release_id, entity, note)"""
    )
    artists = links.withColumnRenamed("entity", "artist_id")
    labels = links.withColumnRenamed("entity", "label_id")
    names = spark.range(10, 50, 10).selectExpr("id", "concat('n', id) AS name")
    tables = {
        "releases": releases, "masters": masters, "artists": names, "labels": names,
        "release_artists": artists, "release_labels": labels, "user_collection": items,
    }
    counted = {
        **tables,
        "artist_counts": collection.count_artists(artists, items),
        "label_counts": collection.count_labels(labels, releases, items),
    }
    assert registry.summary(counted).collect() == registry.summary(tables).collect()
    for name, want in (("top_artists", {("n10", 1), ("n30", 1)}), ("top_labels", {("n10", 3), ("n20", 1)})):
        for given in (tables, counted):
            assert {tuple(r) for r in registry.analyse(given, name).collect()} == want
    nothing = {**counted, "release_artists": artists.limit(0), "release_labels": labels.limit(0)}
    assert registry.summary(nothing).first()["total_artists"] == 2  # n10, n30: no link is read again


def test_only_tracks_that_may_win_are_looked_up(spark):
    """The longest of enough stored releases says which; longer tracks of others don't count."""
    tracks = spark.range(300).selectExpr(
        "id % 30 AS release_id", "CAST(id AS STRING) AS position", "'t' AS title", "'x' AS duration",
        "CAST(CASE WHEN id % 30 > 20 THEN 9999 WHEN id % 7 > 0 THEN id DIV 30 END AS INT) AS duration_seconds",
    )
    releases = spark.range(20).selectExpr("id", "concat('r', id) AS title")
    every = collection.longest_tracks(tracks, releases, None).collect()
    assert len(every) > 100
    for limit in (0, 1, 5, 40):
        best = collection.longest_tracks(tracks, releases, limit)
        assert best.collect() == every[:limit]
        assert limit == 0 or "longest" in best._jdf.queryExecution().optimizedPlan().toString()
