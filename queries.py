"""Registered queries: every operator of the engine over the given star-schema tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cratework.functions import dump_date, duration_text, leading_int, partial_date
from cratework.operators import filters, merge, missing, prune, quality, sampling
from cratework.operators import shred as shredding
from cratework.operators.joins import owned_release_ids
from cratework.operators.sinks import metric_rows
from cratework.plans import collaborations, collection, load, pressings, registry, sync
from cratework.session import shared_folder
from cratework.sources import json_documents, xml_dumps
from cratework.sources.commit_log import Folder
from cratework.sources.snapshots import Change, SnapshotStore
from cratework.sources.star_schema import StarSchemaCatalogue
from cratework.streaming import collection_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Callable[[StarSchemaCatalogue], DataFrame]):
    """Register a query under its function name."""
    QUERIES[query.__name__] = lambda spark, folder: query(StarSchemaCatalogue(spark, folder))
    return query


# ------------------------------------------------------------------ the analyses
@register
def summary(c):
    return registry.summary(c.tables())


@register
def decades(c):
    return collection.favorite_decade(c.releases, c.masters, c.user_collection)


@register
def top_artists(c):
    return collection.top_artists(c.artists, c.release_artists, c.user_collection)


@register
def top_labels(c):
    return collection.releases_by_label(c.labels, c.release_labels, c.releases)


@register
def longest_tracks(c):
    return collection.longest_tracks(c.tracks, c.releases)


@register
def multiple_copies(c):
    return collection.multiple_copies(c.releases, c.masters, c.user_collection)


@register
def genres(c):
    return collection.genre_analysis(c.releases, c.user_collection)


@register
def formats(c):
    return collection.format_analysis(c.releases, c.user_collection)


@register
def years(c):
    return collection.year_analysis(c.releases, c.masters, c.user_collection)


@register
def collaborations_by_name(c):
    return collaborations.artist_collaborations(
        c.artists, c.release_artists, c.releases, "RED", "plate"
    )


@register
def collaborations_by_id(c):
    return collaborations.collaborations_by_id(c.release_artists, c.releases, 86, 113)


@register
def release_country(c):
    return pressings.release_country(c.releases, c.masters)


@register
def artist_holdings(c):
    return pressings.artist_holdings(
        c.releases, c.masters, c.user_collection, c.users, "Artist 42"
    )


@register
def first_press(c):
    return pressings.first_press(c.releases, c.masters, c.user_collection, c.users)


@register
def originality(c):
    return pressings.originality(c.releases, c.masters, c.user_collection)


@register
def collection_audit(c):
    return pressings.collection_audit(c.releases, c.masters, c.user_collection)


@register
def label_parents(c):
    return pressings.label_parents(c.labels)


@register
def summary_unpivot(c):
    return metric_rows(registry.summary(c.tables()))


@register
def genres_typed(c):
    typed = c.releases.withColumn("genres", F.from_json("genres", "array<string>"))
    return collection.genre_analysis(typed, c.user_collection)


# -------------------------------------------------------------------- shredding
@register
def shred_artists(c):
    return shredding.shred_artists(c.releases)


@register
def shred_labels(c):
    return shredding.shred_labels(c.releases)


@register
def shred_tracks(c):
    return shredding.shred_tracks(c.releases)


@register
def shred_owned_artists(c):
    return shredding.shred_only(c.releases, owned_release_ids(c.user_collection)).release_artists


# ----------------------------------------------------------- filters by strategy
def _strategy(c, **settings):
    return filters.apply_strategy(
        c.releases.select("id", "master_id", "title"),
        filters.ReleaseStrategy(**settings),
        c.user_collection,
        c.release_artists,
        c.release_labels,
    )


@register
def filter_all(c):
    return _strategy(c, name="all")


@register
def filter_collection_only(c):
    return _strategy(c, name="collection_only")


@register
def filter_expanded(c):
    return _strategy(c, name="collection_only", include_master_releases=True)


@register
def filter_selective_capped(c):
    return _strategy(
        c,
        name="selective",
        include_master_releases=True,
        include_artist_releases=True,
        include_label_releases=True,
        max_releases_per_artist=2,
        max_releases_per_label=5,
    )


@register
def filter_selective(c):
    """Without caps: all releases of the artists and labels that are owned."""
    strategy = filters.ReleaseStrategy(
        "selective",
        include_master_releases=True,
        include_artist_releases=True,
        include_label_releases=True,
    )
    narrow = c.releases.select("id", "master_id", "title")
    return filters.apply_strategy(
        narrow, strategy, c.user_collection, c.release_artists, c.release_labels
    )


@register
def filter_skip(c):
    """The number of releases that ``skip`` lets through."""
    kept = filters.apply_strategy(
        c.releases, filters.ReleaseStrategy("skip"), c.user_collection
    )
    return kept.agg(F.count(F.lit(1)).alias("kept"))


@register
def collection_masters(c):
    return filters.collection_masters(c.releases, c.user_collection)


@register
def releases_of_masters(c):
    owned = filters.collection_masters(c.releases, c.user_collection)
    return filters.releases_of_masters(c.releases.select("id", "master_id", "title"), owned)


@register
def missing_entities_forced(c):
    """Every owned release is named again when a sync is forced."""
    return missing.missing_entities(
        c.user_collection, c.releases, c.artists, c.labels, c.masters, force=True
    )


@register
def missing_entities(c):
    return missing.missing_entities(c.user_collection, c.releases, c.artists, c.labels, c.masters)


# ----------------------------------------------------------------------- merges
def _owned_titles(c):
    """What the collection knows of its releases: id, title and cached year."""
    known = c.user_collection.groupBy("release_id").agg(
        F.max("basic_information.year").alias("year")
    )
    return known.selectExpr(
        "release_id AS id", "'Owned ' || CAST(release_id AS STRING) AS title", "year"
    )


@register
def upsert_releases(c):
    stored = c.releases.select("id", "master_id", "title", "year", "country")
    return merge.upsert(stored, _owned_titles(c), ["id"])


@register
def upsert_last_wins(c):
    """Every event is a record of its release; the last one in order of event id stays."""
    stored = c.releases.select("id", "master_id", "title", "year", "country")
    incoming = c.table("events").selectExpr(
        "2 * (event_id - event_id % 8) AS id",
        "'Event ' || CAST(event_id AS STRING) AS title",
        "event_id",
    )
    last = merge.last_per_key(incoming, ["id"], F.col("event_id")).drop("event_id")
    return merge.upsert(stored, last, ["id"])


@register
def created_counters(c):
    """Rows that a load of the release documents adds to the link and track tables."""
    parts = shredding.shred(c.releases)
    return quality.created_counters(
        {
            "release_artists": (c.release_artists, parts.release_artists,
                                ["release_id", "artist_id", "role"]),
            "release_labels": (c.release_labels, parts.release_labels,
                               ["release_id", "label_id", "catalog_number"]),
            "tracks": (c.tracks, parts.tracks, ["release_id", "position", "title"]),
        }
    )


@register
def refresh_releases(c):
    stored = c.table("orders").selectExpr(
        "o_orderkey AS id",
        "'Release ' || CAST(o_orderkey AS STRING) AS title",
        "year(o_orderdate) AS year",
        "o_orderdate AS created_at",
        "o_orderdate AS updated_at",
    )
    now = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    return merge.refresh(stored, _owned_titles(c), ["id"], now)


@register
def insert_ignore_artist_links(c):
    stored = c.release_artists.withColumn("name", F.lit("stored"))
    new = c.table("lineitem").selectExpr(
        "l_orderkey AS release_id",
        "l_partkey AS artist_id",
        "CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE 'Remix' END AS role",
        "'new ' || CAST(l_linenumber AS STRING) AS name",
        "l_linenumber",
    )
    key = ["release_id", "artist_id", "role"]
    return merge.insert_ignore(stored, new, key, order=F.col("l_linenumber"))


@register
def insert_ignore_label_links(c):
    key = ["release_id", "label_id", "catalog_number"]
    return merge.insert_ignore(
        c.release_labels, shredding.shred_labels(c.releases), key, unique=True
    )


@register
def replace_tracks(c):
    return merge.replace_children(c.tracks, shredding.shred_tracks(c.releases), "release_id")


@register
def emptied_labels(c):
    """Status of all tables after the labels were cleared: they count 0 rows."""
    return quality.table_status(
        {"labels": merge.emptied(c.labels), "artists": c.artists},
        c.data_sources.where("source_type <> 'labels'"),
    )


@register
def prune_unused(c):
    return prune.prune_releases(c.releases.select("id", "master_id", "title"), c.user_collection)


@register
def prune_links(c):
    kept = prune.prune_releases(c.releases.select("id", "master_id"), c.user_collection)
    return prune.prune_children(c.release_labels, kept)


@register
def prune_report(c):
    return prune.prune_report(c.releases, c.user_collection)


# ------------------------------------------------------------------ landed JSON
def _dealt(c, table, key):
    """The rows of a table over the cluster, ahead of costly parsing."""
    return c.table(table).repartition(
        int(c.spark.conf.get("spark.sql.shuffle.partitions")), key
    )


def _pages(c):
    """One collection page per order: a single item, its notes a list, text or absent."""
    return _dealt(c, "orders", "o_orderkey").selectExpr(
        """concat('{"pagination":{"page":1,"pages":1,"per_page":1,"items":1},"releases":[{"id":',
             CAST(o_orderkey AS STRING), ',"instance_id":', CAST(o_orderkey AS STRING),
             ',"date_added":"', date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:00:00-07:00"',
             ',"rating":', CAST(o_orderkey % 7 AS STRING), ',"folder_id":1,"notes":',
             CASE o_orderkey % 4 WHEN 0 THEN '[{"field_id":3,"value":"mint"}]'
               WHEN 1 THEN '[]' WHEN 2 THEN '"plain"' ELSE 'null' END,
             ',"basic_information":{',
             CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE
               concat('"id":', CAST(o_custkey AS STRING), ',') END,
             '"title":"Item ', CAST(o_orderkey AS STRING), '","year":',
             CAST(year(o_orderdate) AS STRING), ',"genres":["Rock"]}}]}') AS value"""
    )


def _items(c):
    return json_documents.collection_items(json_documents.parse_pages(_pages(c)), 1)


def _epoch(df):
    return df.withColumn("date_added", F.unix_seconds("date_added"))


@register
def json_pages(c):
    items = _items(c).withColumn("year", F.col("basic_information.year"))
    return _epoch(items).drop("basic_information")


def _stored_items(c):
    return c.user_collection.selectExpr(
        "1L AS user_id", "instance_id", "release_id", "folder_id", "rating", "notes",
        "CAST(convert_timezone('UTC', current_timezone(), date_added) AS TIMESTAMP) AS date_added",
    )


@register
def sync_collection(c):
    return _epoch(sync.sync_collection(_stored_items(c), _items(c)).collection)


@register
def sync_forced(c):
    return _epoch(sync.sync_collection(_stored_items(c), _items(c), force=True).collection)


@register
def sync_counters(c):
    return sync.sync_collection(_stored_items(c), _items(c)).counters


@register
def sync_rejected(c):
    rejected = sync.sync_collection(_stored_items(c), _items(c)).rejected
    return _epoch(rejected).drop("basic_information")


def _repeated_items(c):
    """Pages of three items: one twice, the second time later and rated, and one without release."""
    pages = _dealt(c, "orders", "o_orderkey").selectExpr(
        """concat('{"releases":[{"id":1,"instance_id":', CAST(o_orderkey AS STRING),
             ',"date_added":"2020-01-01T00:00:00Z","rating":1,"folder_id":1,',
             '"basic_information":{"id":', CAST(o_custkey + 1 AS STRING), '}},',
             '{"id":1,"instance_id":', CAST(o_orderkey AS STRING),
             ',"date_added":"2021-01-01T00:00:00Z","rating":', CAST(o_orderkey % 6 AS STRING),
             ',"folder_id":2,"basic_information":{"id":', CAST(o_custkey + 1 AS STRING), '}},',
             '{"id":1,"instance_id":', CAST(-o_orderkey AS STRING), ',"rating":0}]}') AS value"""
    )
    return json_documents.collection_items(json_documents.parse_pages(pages), 1)


@register
def sync_repeated(c):
    return _epoch(sync.sync_collection(_stored_items(c), _repeated_items(c)).collection)


@register
def sync_repeated_counters(c):
    return sync.sync_collection(_stored_items(c), _repeated_items(c)).counters


@register
def sync_stream(c):
    """The pages as landed files, taken in by the streaming sync into the stored items."""
    root = f"{shared_folder(c.spark)}/sync-{uuid.uuid4().hex}"
    _pages(c).write.text(f"{root}/landing")
    store = SnapshotStore(c.spark, f"{root}/store")
    store.replace({"user_collection": _stored_items(c)})
    items = collection_stream.stream_items(c.spark, f"{root}/landing", 1, json_lines=True)
    collection_stream.start_sync(items, store, 1).awaitTermination()
    collected = store.refreshed().read("user_collection")
    return _epoch(collected.select(_stored_items(c).columns))


@register
def ensure_users(c):
    """Old ids stay; new ones are above all of them and unique."""
    names = c.table("customer").selectExpr("'user' || CAST(c_custkey AS STRING) AS username")
    known = c.users.select("username", F.col("id").alias("known_id"))
    last = c.users.agg(F.max("id")).scalar()
    given = sync.ensure_users(c.users, names)
    repeated = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    return given.join(known, "username", "left").select(
        "username",
        F.when(F.col("known_id").isNotNull(), F.col("id")).alias("known_id"),
        (F.col("id") > last).alias("is_above"),
        repeated.alias("is_repeated"),
    )


@register
def json_artists(c):
    text = _dealt(c, "part", "p_partkey").selectExpr(
        """concat('{"id":', CAST(p_partkey AS STRING), ',"name":"', p_name, '","realname":"',
             p_brand, '","namevariations":["', p_type, '"],"members":[{"id":7,"name":"M"}]}')
           AS value"""
    )
    rows = json_documents.parse_documents(text, "artists")
    return rows.select(
        "id", "name", "real_name", F.array_join("name_variations", "|").alias("variations"),
        F.size("urls").alias("url_count"), F.get("members", F.lit(0))["name"].alias("member"),
    )


@register
def json_labels(c):
    text = _dealt(c, "supplier", "s_suppkey").selectExpr(
        """concat('{"id":', CAST(s_suppkey AS STRING), ',"name":"', s_name,
             '","sublabels":[{"id":', CAST(s_suppkey + 1 AS STRING),
             ',"name":"a"},{"id":', CAST(s_suppkey + 2 AS STRING), '}]}') AS value"""
    )
    rows = json_documents.parse_documents(text, "labels")
    return rows.select(
        "id", "name", "parent_label_id",
        F.array_join(F.col("subsidiaries").cast("array<string>"), "|").alias("subsidiaries"),
        F.size("urls").alias("url_count"),
    )


@register
def json_masters(c):
    text = _dealt(c, "customer", "c_custkey").selectExpr(
        """concat('{"id":', CAST(c_custkey AS STRING), ',"title":"', c_name, '","year":',
             CAST(1990 + c_nationkey AS STRING), ',"main_release":', CAST(c_custkey * 2 AS STRING),
             ',"genres":["', c_mktsegment, '","Pop"]}') AS value"""
    )
    rows = json_documents.parse_documents(text, "masters")
    return rows.select(
        "id", "title", "year", "main_release_id", F.array_join("genres", "|").alias("genres"),
        F.size("videos").alias("video_count"),
    )


@register
def json_releases(c):
    """Release documents whose credit ids are numbers, objects, or no numbers at all."""
    text = _dealt(c, "orders", "o_orderkey").selectExpr(
        """concat('{"id":', CAST(o_orderkey AS STRING), ',"title":"Doc ',
             CAST(o_orderkey AS STRING), '","released":"', date_format(o_orderdate, 'yyyy-MM'),
             '","master_id":', CAST(o_custkey AS STRING), ',"artists":[{"id":',
             CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey + 1 AS STRING)
               WHEN 1 THEN concat('{"text":"', CAST(o_custkey + 1 AS STRING), '"}')
               WHEN 2 THEN concat('{"value":', CAST(o_custkey + 1 AS STRING), '}')
               ELSE '"none"' END,
             ',"name":"A"}],"labels":[{"id":5,"name":"L","catalog_number":"X1"}]}') AS value"""
    )
    rows = json_documents.parse_documents(text, "releases")
    return rows.select(
        "id", "title", "released", "master_id",
        F.get("artists", F.lit(0))["id"].alias("artist_id"),
        F.get("labels", F.lit(0))["catno"].alias("catalog_number"),
        F.size("tracklist").alias("track_count"),
        "year", "country", "status", "data_quality", "notes", "estimated_weight",
        F.size("extraartists").alias("extra_count"), F.size("companies").alias("company_count"),
        F.size("formats").alias("format_count"), F.size("genres").alias("genre_count"),
        F.size("styles").alias("style_count"), F.size("identifiers").alias("identifier_count"),
        F.size("images").alias("image_count"), F.size("videos").alias("video_count"),
    )


# ------------------------------------------------------------------- landed XML
def _release_records(c):
    """Release elements: some lack a title or a usable id, some are not well formed."""
    fragments = _dealt(c, "orders", "o_orderkey").selectExpr(
        """concat('<release id="', CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE '' END,
             CAST(o_orderkey AS STRING), '" status="Accepted"><title>',
             CASE WHEN o_orderkey % 37 = 0 THEN ' ' ELSE concat(' Café &amp; ',
               CAST(o_orderkey AS STRING)) END, '</title>',
             CASE WHEN o_orderkey % 31 = 0 THEN '<notes>' ELSE '' END,
             '<master_id is_main_release="true">', CAST(o_custkey AS STRING),
             '</master_id><year>', date_format(o_orderdate, 'yyyy'), '</year><released>',
             date_format(o_orderdate, 'yyyy-MM'), '</released><genres><genre>', o_orderpriority,
             '</genre><genre> </genre></genres><formats><format name="Vinyl" qty="1" text="">',
             '<descriptions><description>LP</description></descriptions></format></formats>',
             '<artists><artist><id>', CAST(o_custkey AS STRING), '</id><name>One</name></artist>',
             '<artist><id>bad</id><name>Two</name></artist></artists>',
             '<labels><label name="L" catno="C1" id="bad"/></labels>',
             '<tracklist><track type="track"><position>A1</position><title>T</title>',
             '<duration>3:05</duration></track><track></track></tracklist></release>')
           AS fragment"""
    )
    return xml_dumps.checked(xml_dumps.parse_fragments(fragments, "releases"), "releases")


@register
def xml_releases(c):
    first = F.lit(0)
    return xml_dumps.accepted(_release_records(c)).select(
        "id", "master_id", "title", "year", "released", "status",
        F.array_join("genres", "|").alias("genres"),
        F.size("artists").alias("artist_count"),
        F.get("artists", first)["id"].alias("artist_id"),
        F.get("labels", first)["id"].alias("label_id"),
        F.get("labels", first)["catno"].alias("catno"),
        F.array_join(F.get("formats", first)["descriptions"], "|").alias("descriptions"),
        F.size("tracklist").alias("track_count"),
        F.get("tracklist", first)["duration"].alias("duration"),
        "country", "notes", F.size("styles").alias("style_count"),
        F.size("extraartists").alias("extra_count"),
    )


@register
def xml_quality_gate(c):
    return quality.quality_gate(_release_records(c), F.col("valid"))


@register
def xml_artists(c):
    """Artist elements; a named alias with a bad id rejects its artist."""
    fragments = _dealt(c, "part", "p_partkey").selectExpr(
        """concat('<artist><id>', CAST(p_partkey AS STRING), '</id><name>\n ', p_name,
             ' </name><realname></realname><urls><url>u1</url><url/></urls><aliases><name id="',
             CASE WHEN p_partkey % 17 = 0 THEN 'bad' ELSE CAST(p_partkey AS STRING) END, '">',
             p_brand, '</name><name>', p_type, '</name></aliases></artist>') AS fragment"""
    )
    records = xml_dumps.checked(xml_dumps.parse_fragments(fragments, "artists"), "artists")
    return xml_dumps.accepted(records).select(
        "id", "name", "real_name", F.array_join("urls", "|").alias("urls"),
        F.array_join(F.col("aliases.name"), "|").alias("aliases"),
        F.get("aliases", F.lit(0))["id"].alias("alias_id"),
    )


@register
def xml_labels(c):
    fragments = _dealt(c, "supplier", "s_suppkey").selectExpr(
        """concat('<label><id>', CAST(s_suppkey AS STRING), '</id><name>', s_name,
             '</name><parentLabel id="', CASE WHEN s_suppkey % 3 = 0 THEN 'bad' ELSE
               CAST(s_nationkey AS STRING) END, '">P</parentLabel><sublabels><label id="',
             CAST(s_suppkey + 1 AS STRING), '">a</label><label id="bad">b</label>',
             '<label>c</label></sublabels></label>') AS fragment"""
    )
    records = xml_dumps.checked(xml_dumps.parse_fragments(fragments, "labels"), "labels")
    return xml_dumps.accepted(records).select(
        "id", "name", "parent_label_id",
        F.array_join(F.col("subsidiaries").cast("array<string>"), "|").alias("subsidiaries"),
    )


@register
def xml_masters(c):
    fragments = _dealt(c, "customer", "c_custkey").selectExpr(
        """concat('<master id="', CAST(c_custkey AS STRING), '"><main_release>',
             CASE WHEN c_custkey % 5 = 0 THEN 'bad' ELSE CAST(c_custkey * 2 AS STRING) END,
             '</main_release><title>', c_name, '</title><year>',
             CASE WHEN c_custkey % 6 = 0 THEN '' ELSE CAST(1990 + c_nationkey AS STRING) END,
             '</year><styles><style>', c_mktsegment, '</style></styles></master>') AS fragment"""
    )
    records = xml_dumps.checked(xml_dumps.parse_fragments(fragments, "masters"), "masters")
    return xml_dumps.accepted(records).select(
        "id", "title", "main_release_id", "year", F.array_join("styles", "|").alias("styles")
    )


DUMP_FILE = 100_000


def _dump(c, kind, records, key, folder=None):
    """A dump of the records in the shared folder: a line each, between lines with root tags.

    About ``DUMP_FILE`` records are between two root tags, in files whose number grows with them.
    """
    folder = folder or f"{shared_folder(c.spark)}/dump-{uuid.uuid4().hex}"
    files = max(1, math.ceil(records.count() / DUMP_FILE))
    part = F.pmod(F.xxhash64(key), F.lit(files))
    lines = records.select(part.alias("part"), F.lit(1).alias("at"), "value")
    for at, tag in ((0, f"<{kind}>"), (2, f"</{kind}>")):
        tags = c.spark.range(files).select(F.col("id").alias("part"), F.lit(at), F.lit(tag))
        lines = lines.union(tags)
    ordered = lines.repartition(files, "part").sortWithinPartitions("part", "at")
    ordered.select("value").write.text(folder)
    return folder


@register
def xml_label_file(c):
    """A label dump read from files; a seventh of the records is broken."""
    records = c.table("supplier").selectExpr(
        "s_suppkey",
        """concat('<label><id>', CAST(s_suppkey AS STRING), '</id><name>', s_name,
             CASE WHEN s_suppkey % 7 = 3 THEN '' ELSE '</name>' END,
             '<sublabels><label id="', CAST(s_suppkey + 1 AS STRING), '">a</label></sublabels>',
             CASE WHEN s_suppkey % 7 = 3 THEN '' ELSE '</label>' END) AS value""",
    )
    read = xml_dumps.read_dump(c.spark, _dump(c, "labels", records, "s_suppkey"), "labels")
    return read.select(
        "id", "name", F.array_join(F.col("subsidiaries").cast("array<string>"), "|").alias("subsidiaries")
    )


@register
def xml_release_file(c):
    """A release dump read from files, name variations and dates included."""
    records = c.table("orders").selectExpr(
        "o_orderkey",
        """concat('<release id="', CAST(o_orderkey AS STRING), '" status="Accepted"><title>T ',
             CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE '</title>' END,
             '<country>', o_orderpriority, '</country></release>') AS value""",
    )
    read = xml_dumps.read_dump(c.spark, _dump(c, "releases", records, "o_orderkey"), "releases")
    return read.select("id", "title", "country", "status")


@register
def xml_name_variations(c):
    fragments = c.table("part").selectExpr(
        """concat('<artist><id>', CAST(p_partkey AS STRING), '</id><name>N</name><namevariations>',
             '<name>', p_brand, '</name><name> </name><name>', p_type, '</name></namevariations>',
             '</artist>') AS fragment"""
    )
    records = xml_dumps.checked(xml_dumps.parse_fragments(fragments, "artists"), "artists")
    return xml_dumps.accepted(records).select(
        "id", F.array_join("name_variations", "|").alias("name_variations")
    )


# --------------------------------------------------------------------- the store
#: Records of each kind of dump; every seventh part has no numeric id, every 31st order no title.
DUMPS = {
    "artists": (
        "part",
        """concat('<artist><id>', CASE WHEN p_partkey % 7 = 3 THEN 'x' ELSE '' END,
             CAST(p_partkey AS STRING), '</id><name>', p_name, '</name></artist>')""",
    ),
    "labels": (
        "supplier",
        "concat('<label><id>', CAST(s_suppkey AS STRING), '</id><name>', s_name, '</name></label>')",
    ),
    "masters": (
        "customer",
        """concat('<master id="', CAST(c_custkey AS STRING), '"><title>', c_name,
             '</title></master>')""",
    ),
    "releases": (
        "orders",
        """concat('<release id="', CAST(o_orderkey AS STRING), '">',
             CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE concat('<title>T', CAST(o_orderkey AS STRING),
               '</title>') END, '<artists><artist><id>', CAST(o_custkey + 1 AS STRING),
             '</id><name>A</name></artist><artist><id>1</id><name>B</name></artist></artists>',
             '<labels><label name="L" catno="c" id="', CAST(o_orderkey % 50 AS STRING), '"/></labels>',
             '<tracklist>', repeat('<track><title>t</title><duration>1:00</duration></track>',
               CAST(o_orderkey % 3 AS INT)), '</tracklist></release>')""",
    ),
}


def _dump_folder(c, kinds):
    """A folder with the newest dump of some kinds, in parts of a bounded size, and an older one of nothing."""
    top = f"{shared_folder(c.spark)}/dumps-{uuid.uuid4().hex}"
    folder = Folder(c.spark, top)
    for kind in kinds:
        table, record = DUMPS[kind]
        key = c.table(table).columns[0]
        records = c.table(table).selectExpr(key, f"{record} AS value")
        _dump(c, kind, records, key, f"{top}/x_20250601_{kind}.xml")
        folder.put_new(f"x_20250501_{kind}.xml", f"<{kind}></{kind}>")
    return top


def _loaded(c, *kinds, again=False):
    """A store with the newest dumps of some kinds, loaded twice if ``again``."""
    top = _dump_folder(c, kinds)
    store = SnapshotStore(c.spark, f"{top}-store")
    for force in (False, True) if again else (False,):
        load.load_all(store, top, max_error_rate=0.5, force=force)
    return store


@register
def load_all_entities(c):
    """The newest dump of every kind, found in a folder and loaded: artists, labels, masters, releases."""
    store = _loaded(c, *DUMPS)
    named = [
        store.read(kind).select(F.lit(kind).alias("kind"), "id", F.col(name).alias("name"))
        for kind, name in (("artists", "name"), ("labels", "name"), ("masters", "title"), ("releases", "title"))
    ]
    return reduce(DataFrame.unionByName, named)


@register
def load_counters(c):
    """What two loads of the same releases created and updated, as counted while written."""
    store = _loaded(c, "releases", again=True)
    rows = store.read("load_counters").where(F.col("source_type") == "releases")
    return rows.where(F.col("table_name").isin("releases", "release_artists", "release_labels", "tracks")).groupBy(
        "table_name"
    ).agg(F.count("*").alias("loads"), F.sum("created").alias("created"), F.sum("updated").alias("updated"))


@register
def xml_rejected(c):
    """Rejected records of dumps, with their reason and text."""
    store = _loaded(c, "artists", "labels")
    return store.read("rejects").select("source_type", "reason", "fragment", F.col("file_name"))


def _catalogue_store(c, *tables):
    """A store with some of the catalogue's tables, the releases in two loads."""
    store = SnapshotStore(c.spark, f"{shared_folder(c.spark)}/store-{uuid.uuid4().hex}")
    store.append({t: getattr(c, t) for t in tables if t != "releases"})
    releases = c.releases.select("id", "master_id", "title", "country", "released")
    store.append({"releases": releases.where("id % 2 = 0")})
    store.append({"releases": releases.where("id % 2 = 1")})
    return store


@register
def store_upserts(c):
    """Stored releases of which some are then changed, some added and some replaced once more."""
    store = _catalogue_store(c, "user_collection")
    for nth, part in enumerate(("id % 97 = 3", "id % 97 < 5")):
        changed = c.releases.where(part).selectExpr("id", f"'changed {nth}' AS title")
        added = c.releases.where(f"{part} AND id <> 0").selectExpr("-id AS id", f"'added {nth}' AS title")
        changed = changed.unionByName(added)
        store.publish({"releases": load.refreshed(store, "releases", changed)})
    return store.read("releases").select("id", "master_id", "title", "country")


@register
def store_pruned_links(c):
    """Links of owned releases, once unused releases are pruned from the store."""
    store = _catalogue_store(c, "release_labels", "user_collection")
    load.prune_store(store)
    return load.owned_tables(store)["release_labels"].join(
        store.read("releases").select(F.col("id").alias("release_id"), "title"), "release_id"
    ).select("release_id", "label_id", "catalog_number", "title")


@register
def collaborations_indexed(c):
    """Collaborations by names that are found through the trigrams kept in a store."""
    store = _catalogue_store(c, "release_artists")
    store.publish({"artists": Change(c.artists), **load.name_changes(store, "artists", c.artists)})
    return load.collaborations_named(store, "RED", "plate")


# ------------------------------------------------------------------------- sinks
def _written(c, fmt, schema):
    """A sorted analysis written as a report, and read back."""
    folder = f"{shared_folder(c.spark)}/report-{uuid.uuid4().hex}"
    registry.report(c.tables(), folder, fmt)
    reader = c.spark.read.schema(schema).option("header", True)
    return reader.format(fmt).load(f"{folder}/genres")


GENRES = "genre string, release_count bigint, percentage double"


@register
def report_csv(c):
    return _written(c, "csv", GENRES)


@register
def report_json(c):
    return _written(c, "json", GENRES)


@register
def report_rows(c):
    """Every result of a report without limits, pressings too, read back: a line for each row."""
    folder = f"{shared_folder(c.spark)}/report-{uuid.uuid4().hex}"
    registry.report(c.tables(), folder, "csv", limit=None, with_pressings=True)
    lines = []
    for name in (*registry.ANALYSES, *registry.PRESSINGS):
        rows = c.spark.read.option("header", True).csv(f"{folder}/{name}").drop("added_to_collection")
        columns = [F.coalesce(F.col(x), F.lit("")) for x in sorted(rows.columns)]
        lines.append(rows.select(F.lit(name).alias("analysis"), F.concat_ws("|", *columns).alias("line")))
    return reduce(DataFrame.unionByName, lines)


# ------------------------------------------------------------ quality, provenance
@register
def load_provenance(c):
    """The provenance table after a load of the labels."""
    sources = c.data_sources
    loaded = load.provenance(sources, "labels", "x_20250601_labels.xml", c.labels, "s1")
    return loaded.select("source_type", "file_name", "record_count", "source_date")


@register
def dump_dates(c):
    files = c.table("orders").selectExpr(
        """CASE o_orderkey % 4 WHEN 0 THEN 'x_' || date_format(o_orderdate, 'yyyyMMdd') || '_a.xml.gz'
             WHEN 1 THEN 'x_20251399_a.xml' WHEN 2 THEN 'plain.xml'
             ELSE 'x_' || date_format(o_orderdate, 'yyyyMMdd') || '.xml' END AS name""",
        "o_orderkey AS id",
    )
    return files.select("id", dump_date("name").alias("dump_date"))


@register
def newest_dumps(c):
    """The dump with the latest date in its name, of one per order."""
    files = c.table("orders").selectExpr(
        "'x_' || date_format(o_orderdate, 'yyyyMMdd') || '_artists.xml' AS file_name",
        "CAST(o_orderkey AS STRING) AS path",
        "o_orderkey AS modified",
    )
    dated = files.withColumn("dump_date", dump_date("file_name"))
    return xml_dumps.newest_dump(dated).select("path", "file_name", "dump_date")


@register
def table_status(c):
    return quality.table_status(c.tables(), c.data_sources)


@register
def quality_gate(c):
    return quality.quality_gate(_items(c), json_documents.has_release())


@register
def rating_rejects(c):
    """Ratings outside 0 to 5, read from the event values."""
    items = c.table("events").selectExpr(
        "event_id AS instance_id", "CAST(floor(value) AS INT) AS rating"
    )
    return quality.split_valid(items, quality.rating_in_range())[1]


@register
def latest_loads(c):
    return quality.latest_loads(c.data_sources)


@register
def files_not_loaded(c):
    files = c.table("orders").selectExpr("'dump_' || CAST(o_orderkey AS STRING) AS file_name")
    return quality.not_yet_loaded(files, c.data_sources)


# ------------------------------------------------------------------- expressions
@register
def track_durations(c):
    return c.tracks.select(
        "release_id", "position", "title", "duration", "duration_seconds",
        duration_text("duration_seconds").alias("formatted"),
    )


@register
def release_dates(c):
    texts = c.table("orders").selectExpr(
        "o_orderkey AS id",
        """CASE o_orderkey % 8
             WHEN 0 THEN date_format(o_orderdate, ' yyyy-MM-dd ')
             WHEN 1 THEN date_format(o_orderdate, 'yyyy-M')
             WHEN 2 THEN date_format(o_orderdate, 'yyyy')
             WHEN 3 THEN date_format(o_orderdate, "yyyy-MM-'00'")
             WHEN 4 THEN date_format(o_orderdate, 'yyyy/MM/dd')
             WHEN 5 THEN ''
             WHEN 6 THEN 'not-a-date'
             ELSE date_format(o_orderdate, 'yyyy-M-d') END AS text""",
    )
    return texts.select("id", partial_date("text").alias("released"))


@register
def loose_years(c):
    """Cast of loose text to a number, as in cached years."""
    texts = c.table("orders").selectExpr(
        "o_orderkey AS id",
        """CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) || 'x'
             WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE ' ' || CAST(o_orderkey AS STRING) END AS text""",
    )
    return texts.select("id", leading_int("text").alias("year"))


# -------------------------------------------------------------------- sampling
@register
def sample_closed_subset(c):
    """Keys of every table in the sampled subset."""
    subset = sampling.closed_subset(c.tables())
    keys = {
        "users": ["id"], "artists": ["id"], "labels": ["id"], "masters": ["id"],
        "releases": ["id"], "release_artists": ["release_id", "artist_id", "role"],
        "release_labels": ["release_id", "label_id", "catalog_number"],
        "tracks": ["release_id", "position", "title"], "user_collection": ["instance_id"],
    }
    return reduce(
        DataFrame.unionByName,
        [
            subset[name].select(
                F.lit(name).alias("table_name"),
                F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("row_key"),
            )
            for name, key in keys.items()
        ],
    )
