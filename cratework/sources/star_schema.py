"""The catalogue read from a star schema of orders, customers, parts and events.

Releases come from orders, masters from customers, artists from parts, labels
from suppliers, links and tracks from line items, collections from events.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratework.functions import duration_seconds

SCHEMAS = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def _credit(id_: str, anv: str = "NULL", join: str = "NULL", role: str = "NULL",
            tracks: str = "NULL") -> str:
    return (
        f"named_struct('id', CAST({id_} AS BIGINT), "
        f"'name', coalesce('Artist ' || CAST({id_} AS STRING), 'Unknown'), "
        f"'anv', CAST({anv} AS STRING), 'join', CAST({join} AS STRING), "
        f"'role', CAST({role} AS STRING), 'tracks', CAST({tracks} AS STRING))"
    )


def _label(id_: str, catno: str) -> str:
    return (
        f"named_struct('id', CAST({id_} AS BIGINT), 'name', 'Label ' || CAST({id_} AS STRING), "
        f"'catno', {catno})"
    )


_FIRST, _SECOND, _THIRD = "o_custkey * 2 + 1", "o_orderkey % 89 + 1", "o_orderkey % 83 + 1"
_CATNO = "'CAT-' || CAST(o_orderkey % 10 AS STRING)"

# Nested credits, labels and tracks of a release, with repeats and gaps.
DOCUMENTS = {
    "artists": "array(" + ", ".join([
        _credit(
            _FIRST, join="','",
            anv="CASE WHEN o_orderkey % 4 = 0 THEN 'Anv ' || CAST(o_orderkey AS STRING) END",
        ),
        _credit(_SECOND),
        _credit(_FIRST, anv="'Late'"),
        _credit("NULL"),
    ]) + ")",
    "extraartists": "array(" + ", ".join([
        _credit(_SECOND, role="'Producer'", tracks="'A1'"),
        _credit(_SECOND, role="'Producer'", tracks="'B1'"),
        _credit(_FIRST, role="''"),
        _credit(_THIRD, anv="'Guest'"),
    ]) + ")",
    "labels": "array(" + ", ".join([
        _label("o_custkey + 1", _CATNO),
        _label("o_custkey + 1", "''"),
        _label("o_custkey + 1", _CATNO),
        _label("NULL", _CATNO),
    ]) + ")",
    "tracklist": """
        CASE WHEN o_orderkey % 4 <> 0 THEN
          transform(sequence(1L, o_orderkey % 5 + 1), i -> named_struct(
            'position', CAST(i AS STRING),
            'title', CASE WHEN i = 3 THEN ''
                     ELSE concat('Track ', CAST(i AS STRING), ' of ', CAST(o_orderkey AS STRING)) END,
            'duration', concat(CAST(o_orderkey % 9 AS STRING), ':',
                               lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')),
            'type_', 'track')) END""",
}

# Genres and formats are JSON text, some of it NULL or not valid.
RELEASES = {
    "id": "o_orderkey",
    "master_id": "CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END",
    "title": "'Release ' || CAST(o_orderkey AS STRING)",
    "year": "year(o_orderdate)",
    "country": "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END",
    "released": "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END",
    "notes": "CASE o_orderstatus WHEN 'F' THEN 'Reissue' WHEN 'P' THEN '1990 remaster' END",
    "genres": """
        CASE WHEN o_orderkey % 17 = 0 THEN NULL
             WHEN o_orderkey % 13 = 0 THEN '["broken"'
             ELSE concat('["', o_orderpriority, '","',
                         CASE WHEN o_orderkey % 23 = 0 THEN o_orderpriority ELSE o_orderstatus END,
                         '"]') END""",
    "formats": """
        concat(CASE WHEN o_orderkey % 19 = 0 THEN '[{' ELSE concat('[{"name":"', o_orderstatus, '",') END,
               '"descriptions":["', CASE WHEN o_orderkey % 3 = 0 THEN 'Repress' ELSE 'LP' END, '"]}',
               CASE WHEN o_orderkey % 19 = 0 THEN ']'
                    WHEN o_orderkey % 9 = 0 THEN ',{"name":"All Media"}]'
                    ELSE concat(',{"name":"', o_orderstatus, '"}]') END)""",
    **DOCUMENTS,
}

# Durations in every accepted shape, and some that are blank or malformed.
TRACK_DURATION = """
    CASE l_partkey % 10
      WHEN 0 THEN ' '
      WHEN 1 THEN concat('1:', lpad(CAST(CAST(l_quantity AS INT) AS STRING), 2, '0'), ':',
                         lpad(CAST(l_partkey % 60 AS STRING), 2, '0'))
      WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS STRING)
      WHEN 3 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ':',
                         CAST(l_partkey % 60 % 10 AS STRING))
      WHEN 4 THEN NULL
      ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), ':',
                  lpad(CAST(l_partkey % 60 AS STRING), 2, '0')) END"""


def _by_release(links: DataFrame) -> DataFrame:
    """Distinct links, moved once: by release, as what joins them by release needs them too."""
    return links.repartition("release_id").distinct()


class StarSchemaCatalogue:
    """Lazy catalogue tables over the Parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder
        self._scans: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._scans:
            reader = self.spark.read.schema(SCHEMAS[name])
            self._scans[name] = reader.parquet(f"{self._folder}/{name}.parquet")
        return self._scans[name]

    @cached_property
    def releases(self) -> DataFrame:
        return self.table("orders").selectExpr(
            *[f"{expression} AS {name}" for name, expression in RELEASES.items()]
        )

    @cached_property
    def masters(self) -> DataFrame:
        main = (
            self.releases.where("master_id IS NOT NULL").groupBy("master_id").agg({"id": "min"})
        )
        return (
            self.table("customer")
            .join(main.withColumnRenamed("min(id)", "main").withColumnRenamed("master_id", "key"),
                  F.col("c_custkey") == F.col("key"), "left")
            .selectExpr(
                "c_custkey AS id",
                "c_name AS title",
                "CASE WHEN c_custkey % 4 <> 0 THEN main END AS main_release_id",
                "CAST(CASE WHEN c_custkey % 3 <> 0 THEN 1995 + c_custkey % 7 END AS INT) AS year",
            )
        )

    @cached_property
    def artists(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey AS id", "p_name AS name")

    @cached_property
    def labels(self) -> DataFrame:
        """Every label but the first of ten has a parent; some parents are not stored."""
        return self.table("supplier").selectExpr(
            "s_suppkey AS id",
            "s_name AS name",
            """CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey * 100 + 99
                    WHEN s_suppkey % 10 <> 0 THEN s_suppkey - s_suppkey % 10
               END AS parent_label_id""",
        )

    @cached_property
    def release_artists(self) -> DataFrame:
        return _by_release(self.table("lineitem").selectExpr(
            "l_orderkey AS release_id", "l_partkey AS artist_id", "l_returnflag AS role"
        ))

    @cached_property
    def release_labels(self) -> DataFrame:
        return _by_release(self.table("lineitem").selectExpr(
            "l_orderkey AS release_id",
            "l_suppkey AS label_id",
            "CAST(l_linenumber AS STRING) AS catalog_number",
        ))

    @cached_property
    def tracks(self) -> DataFrame:
        # Exploded from a list of one, so that the text is built once per row and not
        # again in every expression that reads it.
        lines = self.table("lineitem").selectExpr(
            "l_orderkey AS release_id",
            "CAST(l_linenumber AS STRING) AS position",
            "'Track ' || CAST(l_partkey AS STRING) AS title",
            f"explode(array({TRACK_DURATION})) AS duration",
        )
        return lines.withColumn("duration_seconds", duration_seconds("duration")).selectExpr(
            "*", "'track' AS type"
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.table("events").selectExpr("user_id AS id").distinct().selectExpr(
            "id", "'user' || CAST(id AS STRING) AS username"
        )

    @cached_property
    def user_collection(self) -> DataFrame:
        """Pairs of items share a release, and a quarter of the releases are not stored."""
        return self.table("events").selectExpr(
            "user_id",
            "2 * (event_id - event_id % 2) AS release_id",
            "1L AS folder_id",
            "event_id AS instance_id",
            "CAST(event_id % 6 AS INT) AS rating",
            "CAST(NULL AS STRING) AS notes",
            "ts AS date_added",
            """named_struct('year', CASE WHEN event_id % 9 <> 4 THEN
                 1950 + try_cast(get_json_object(props, '$.k') AS INT) END) AS basic_information""",
        )

    @cached_property
    def data_sources(self) -> DataFrame:
        """One provenance row per event; the event type says which table was loaded."""
        return self.table("events").selectExpr(
            """CASE event_type WHEN 'view' THEN 'artists' WHEN 'signup' THEN 'labels'
                 WHEN 'click' THEN 'masters' WHEN 'purchase' THEN 'releases'
                 ELSE 'collection' END AS source_type""",
            "'xml_dump' AS source_name",
            "ts AS last_updated",
            "'dump_' || CAST(event_id AS STRING) AS file_name",
            "event_id AS record_count",
        )

    def tables(self) -> dict[str, DataFrame]:
        return {
            name: getattr(self, name)
            for name in (
                "artists", "labels", "masters", "releases", "release_artists", "release_labels",
                "tracks", "users", "user_collection",
            )
        }
