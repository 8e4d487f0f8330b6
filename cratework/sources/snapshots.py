"""Stored tables as Parquet folders below one root.

A table is a list of folders, each split by a bucket of its key. A job adds a folder and says
which buckets of the earlier ones it replaces: none (rows are appended), those that hold the
keys it changed, or all. Nothing is changed in place. A job becomes visible by one commit
(``commit_log``), so all of it is seen or nothing, and a job that began from an older state fails
instead of undoing another. Folders of jobs that never got there are seen by nobody.

Buckets are Spark's own (``pmod(hash(key), n)``), and folders are written with Spark's bucketing,
so tables that have the same number of buckets join on their keys without an exchange. Their number
is a power of two near half the square root of the rows, with ``GRAIN`` rows in each at least: a
small change to n rows then rewrites in the order of sqrt(n) rows for each key. It grows with the table without rewriting it: a folder
keeps the number that it was written with, and a bucket of it holds those of its multiples.
"""

from __future__ import annotations

import math
import re
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cratework import schemas
from cratework.sources.commit_log import CommitLog, Folder

#: The column that places a row of a table in a bucket.
KEYS = {
    "artists": "id",
    "labels": "id",
    "masters": "id",
    "releases": "id",
    "release_artists": "release_id",
    "release_labels": "release_id",
    "tracks": "release_id",
    "user_collection": "user_id",
    "name_grams": "gram",
}

#: Rows that a bucket has at least, but for the first buckets of a table.
GRAIN = 2000

#: Folders of a table beyond which the smallest are joined.
MOST_FOLDERS = 12

#: Buckets of folders that one scan is told of by name; beyond, they are found in their folders.
MOST_NAMED = 5000

#: Spark's setting to list the partitions of a table in the catalogue once it is written.
_TRACKED = "spark.sql.hive.manageFilesourcePartitions"

#: A column of a change that says of a row whether it is ``created`` or ``updated``; not stored.
STATUS = "_status"


class StalePublish(RuntimeError):
    """Another job has published since this one read its tables."""


class Change(NamedTuple):
    """Rows for a table, and the buckets they replace: None for all, empty to append."""

    rows: DataFrame
    buckets: list[int] | None = None


class Staged(NamedTuple):
    """Rows that were written but are not shown yet: where, and how many of which status."""

    folder: str
    rows: int
    created: int
    updated: int
    present: list[int]


def buckets_for(rows: float, least: int, grain: int = GRAIN) -> int:
    """A power of two near half the square root of the rows, of ``grain`` rows each at least."""
    buckets = least
    while 4 * buckets * buckets < rows and buckets * grain < rows:
        buckets *= 2
    return buckets


def _spread(buckets: list[int], old: int, new: int) -> list[int]:
    """The buckets of ``new`` that lie in some of ``old``, which divides it."""
    return [b + old * i for i in range(new // old) for b in buckets]


def applied(state: dict, entry: dict) -> dict:
    """The state of all tables after a commit: their number of buckets and their folders.

    Of a folder, ``present`` are its buckets that still have rows, ``of`` how many had at first.
    If it was written with fewer buckets than the table has now, ``gone`` are those of the
    table's that were replaced since.
    """
    for change in entry["changes"]:
        table = state.setdefault(change["table"], {"buckets": change["buckets"], "folders": {}})
        folders = table["folders"]
        if change["replaces"] is None:
            folders.clear()
        for name in change["merges"]:
            del folders[name]
        dead = set(change["replaces"] or ())
        for name, folder in list(folders.items()):
            if not dead:
                break
            if folder["buckets"] == table["buckets"]:
                folder["present"] = [b for b in folder["present"] if b not in dead]
            else:
                folder["gone"] = sorted(dead.union(folder["gone"]))
                whole = folder["buckets"]
                folder["present"] = [
                    b
                    for b in folder["present"]
                    if not set(_spread([b], whole, table["buckets"])) <= set(folder["gone"])
                ]
            if not folder["present"]:
                del folders[name]
        if change["present"]:
            folders[change["folder"]] = {
                "buckets": change["buckets"],
                "rows": change["rows"],
                "present": change["present"],
                "of": len(change["present"]),
                "gone": [],
            }
        table["buckets"] = max(table["buckets"], change["buckets"])
        grown = table["buckets"]
        if change["keyed"]:
            grown = buckets_for(_live_rows(table), grown, change["grain"])
        for folder in folders.values():
            folder["gone"] = _spread(folder["gone"], table["buckets"], grown)
        table["buckets"] = grown
    return state


def _live_rows(table: dict) -> float:
    """About how many rows the state of a table has."""
    return sum(f["rows"] * len(f["present"]) / f["of"] for f in table["folders"].values())


class SnapshotStore:
    """The catalogue tables below ``root``, a folder all executors can reach."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        buckets: int = 16,
        most_folders: int = MOST_FOLDERS,
        state_every: int = 20,
        grain: int = GRAIN,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.most_folders = most_folders
        self.grain = grain
        self._log = CommitLog(spark, f"{self.root}/_log", applied, state_every)
        self._version: int | None = None
        self._state: dict = {}
        # Bucketed files are described to Spark by tables of this session alone. A catalogue
        # that others share is left as it is, and tables are then read without bucketing.
        self._bucketed = spark.conf.get("spark.sql.catalogImplementation") == "in-memory"

    # ------------------------------------------------------------------ state
    def _read_log(self) -> dict:
        """The state of all tables; read once until this store publishes."""
        if self._version is None:
            self._version = self._log.latest()
            self._state = self._log.state(self._version)
        return self._state

    def version(self) -> int:
        self._read_log()
        return self._version or 0

    def refreshed(self) -> SnapshotStore:
        """Forget the state that was read."""
        self._version = None
        return self

    def at(self, version: int) -> SnapshotStore:
        """The store as it was after an earlier publish, to read from."""
        earlier = SnapshotStore(self.spark, self.root, self.buckets, self.most_folders)
        earlier._version, earlier._state = version, self._log.state(version)
        return earlier

    def _table(self, table: str) -> dict:
        empty = {"buckets": self.buckets if table in KEYS else 1, "folders": {}}
        return self._read_log().get(table, empty)

    def n_buckets(self, table: str) -> int:
        return self._table(table)["buckets"]

    def _bucket(self, table: str) -> Column:
        return _bucket(KEYS[table], self.n_buckets(table))

    def buckets_of(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets that the keys of some rows are in; at most as many as a table has."""
        found = rows.select(self._bucket(table).alias("bucket")).distinct().collect()
        return sorted(r.bucket for r in found)

    # ------------------------------------------------------------------- read
    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The published state of a table, or some buckets of it; others are not opened."""
        state = self._table(table)
        return self._scan(table, state["folders"], state["buckets"], buckets)

    def _scan(
        self, table: str, folders: dict, n: int, buckets: list[int] | None = None
    ) -> DataFrame:
        schema = schemas.TABLES[table]
        base = f"{self.root}/{table}"
        if table not in KEYS or not folders:
            paths = [f"{base}/load={name}" for name in folders]
            if not paths:
                return self.spark.createDataFrame([], schema)
            return self.spark.read.schema(schema).parquet(*paths)
        wanted = None if buckets is None else set(buckets)
        if wanted is not None and len(wanted) == n:
            wanted = None
        live = {}
        for name, folder in folders.items():
            asked = None if wanted is None else {b % folder["buckets"] for b in wanted}
            live[name] = [b for b in folder["present"] if asked is None or b in asked]
        live = {name: found for name, found in live.items() if found}
        older = {name for name in live if folders[name]["buckets"] != n}
        if not live:
            return self.spark.createDataFrame([], schema)
        if self._bucketed and not older and sum(map(len, live.values())) <= MOST_NAMED:
            return self._as_bucketed(table, live, n)
        reader = self.spark.read.schema(f"{schema}, load string, bucket int")
        found = reader.option("basePath", base).parquet(*[f"{base}/load={name}" for name in live])
        kept = F.lit(False)
        own = f"pmod(hash({KEYS[table]}), {n})"
        for name, places in live.items():
            here = F.col("load") == name
            if len(places) < folders[name]["of"]:
                here &= _one_of("bucket", places)
            if name in older:
                if folders[name]["gone"]:
                    here &= ~_one_of(own, folders[name]["gone"])
                if wanted is not None:
                    here &= _one_of(own, sorted(wanted))
            kept |= here
        return found.where(kept).drop("load", "bucket")

    def _as_bucketed(self, table: str, live: Mapping[str, list[int]], n: int) -> DataFrame:
        """A scan of bucketed folders that says so, by an external table of this session."""
        name = f"cratework_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({schemas.TABLES[table]}, load string, bucket int) USING parquet "
            f"PARTITIONED BY (load, bucket) CLUSTERED BY ({KEYS[table]}) INTO {n} BUCKETS "
            f"LOCATION '{self.root}/{table}'"
        )
        places = " ".join(f"PARTITION (load='{f}', bucket={b})" for f, bs in live.items() for b in bs)
        self.spark.sql(f"ALTER TABLE {name} ADD {places}")
        return self.spark.table(name).drop("load", "bucket")

    def holding(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of a table whose key is in the one column of ``keys``; null keys are in none.

        Only the buckets of these keys are opened, found by a pass over the keys.
        """
        return self.holding_each([table], keys)[table]

    def holding_each(self, tables: Sequence[str], keys: DataFrame) -> dict[str, DataFrame]:
        """``holding`` of some tables, whose buckets are found by one pass over the keys."""
        named = keys.toDF("_key").where(F.col("_key").isNotNull())
        most = math.lcm(*map(self.n_buckets, tables))
        found = [r.bucket for r in named.select(_bucket("_key", most).alias("bucket")).distinct().collect()]
        named = named.distinct()
        rows = {}
        for table in tables:
            opened = self.read(table, sorted({b % self.n_buckets(table) for b in found}))
            rows[table] = opened.join(named, F.col(KEYS[table]) == F.col("_key"), "left_semi")
        return rows

    # ------------------------------------------------------------------ write
    def _stage(self, table: str, df: DataFrame) -> Staged:
        """Write rows for a table without showing them."""
        folder, seen = uuid.uuid4().hex, Observation()
        path = f"{self.root}/{table}/load={folder}"
        status = F.col(STATUS) if STATUS in df.columns else F.lit(None).cast("string")
        counted = df.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(status == "created").alias("created"),
            F.count_if(status == "updated").alias("updated"),
        )
        fields = self.spark.createDataFrame([], schemas.TABLES[table]).schema.fields
        fitted = counted.select(
            *[
                F.col(f.name) if f.name in df.columns
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in fields
            ]
        )
        if table not in KEYS:
            fitted.write.parquet(path)
            return Staged(folder, *self._counted(seen, table, path), [0])
        # Rebalanced by bucket: Spark splits what is large and joins what is small.
        placed = fitted.withColumn("bucket", self._bucket(table)).hint("rebalance", "bucket")
        writer = placed.write.partitionBy("bucket")
        if self._bucketed:
            name = f"cratework_{folder}"
            bucketed = writer.bucketBy(self.n_buckets(table), KEYS[table])
            # Scans name the buckets that they read: none is looked up for a table dropped at once.
            tracked = self.spark.conf.get(_TRACKED)
            self.spark.conf.set(_TRACKED, "false")
            try:
                bucketed.format("parquet").option("path", path).saveAsTable(name)
            finally:
                self.spark.conf.set(_TRACKED, tracked)
            self.spark.sql(f"DROP TABLE {name}")  # external: its files stay
        else:
            writer.parquet(path)
        names = Folder(self.spark, path).entries()
        present = sorted(int(m[1]) for m in map(re.compile(r"bucket=(\d+)$").match, names) if m)
        return Staged(folder, *self._counted(seen, table, path), present)

    def _counted(self, seen: Observation, table: str, path: str) -> tuple[int, int, int]:
        try:
            found = seen.get
        except Py4JJavaError:
            # Spark leaves counters out of a plan that it knows to be empty.
            if not self.spark.read.schema(schemas.TABLES[table]).parquet(path).isEmpty():
                raise
            return 0, 0, 0
        return found["rows"], found["created"], found["updated"]

    def publish(self, changes: Mapping[str, Change], load: Mapping[str, str] | None = None) -> int:
        """Stage the changes of some tables and show them all at once; returns the version.

        ``load`` names the job, by columns of ``load_counters``. With it, the rows that the job
        wrote, created and updated are added there, as counted while they were written.
        """
        version = self.version() + 1
        staged = {table: self._stage(table, change.rows) for table, change in changes.items()}
        changed = {table: (change.buckets, []) for table, change in changes.items()}
        if load is not None:
            staged["load_counters"] = self._stage("load_counters", self._counters(staged, load))
            changed["load_counters"] = ([], [])
        self._commit(version, staged, changed)
        for table in staged:
            self._tidy(table)
        return version

    def _counters(self, staged: Mapping[str, Staged], load: Mapping[str, str]) -> DataFrame:
        rows = [(t, s.rows, s.created, s.updated) for t, s in staged.items()]
        names = "table_name string, written bigint, created bigint, updated bigint"
        counted = self.spark.createDataFrame(rows, names)
        named = {name: F.lit(value) for name, value in load.items()}
        return counted.withColumns({**named, "at": F.current_timestamp()})

    def _commit(self, version: int, staged: Mapping[str, Staged], changed: Mapping) -> None:
        entry = {
            "changes": [
                {
                    "table": table,
                    "keyed": table in KEYS,
                    "grain": self.grain,
                    "folder": made.folder,
                    "buckets": self.n_buckets(table),
                    "rows": made.rows,
                    "present": made.present if made.rows else [],
                    "replaces": changed[table][0],
                    "merges": changed[table][1],
                }
                for table, made in staged.items()
            ]
        }
        if not self._log.commit(version, entry):
            raise StalePublish(f"version {version} is there already")
        self._version = None

    def replace(self, tables: Mapping[str, DataFrame]) -> int:
        """Publish whole next states of some tables."""
        return self.publish({table: Change(df) for table, df in tables.items()})

    def append(self, tables: Mapping[str, DataFrame]) -> int:
        """Publish more rows of some tables."""
        return self.publish({table: Change(df, []) for table, df in tables.items()})

    # ---------------------------------------------------------------- tidying
    def _tidy(self, table: str) -> None:
        """Joins the smallest folders of a table that has too many.

        A folder is taken as long as those before it have half its rows together, so every row
        is written again about as often as the table doubles.
        """
        folders = self._table(table)["folders"]
        if len(folders) <= self.most_folders:
            return
        ordered = sorted(folders.items(), key=lambda item: item[1]["rows"])
        taken, rows = {}, 0
        for nth, (name, folder) in enumerate(ordered):
            if nth >= self.most_folders // 2 and folder["rows"] > 2 * rows:
                break
            taken[name], rows = folder, rows + folder["rows"]
        try:
            self._join(table, taken)
        except StalePublish:
            self.refreshed()  # whoever was faster has more folders to join

    def _join(self, table: str, folders: dict) -> None:
        rows = self._scan(table, folders, self.n_buckets(table))
        staged = self._stage(table, rows)
        self._commit(self.version() + 1, {table: staged}, {table: ([], list(folders))})

    def compact(self, table: str) -> None:
        """Write a table's state as one folder, in as many buckets as it has now."""
        folders = self._table(table)["folders"]
        if folders:
            self._join(table, folders)

    def vacuum(self, keep: int = 2, hours: float = 24 * 7, landings: bool = False) -> list[str]:
        """Deletes what no job can need: folders that the last ``keep`` versions don't name.

        Younger ones than ``hours`` stay, as a job may be about to publish them. The log keeps
        what these versions need. ``landings`` takes old landed files too. Returns what went.
        """
        last, before = self._log.latest(), time.time() - hours * 3600
        first = max(self._log.oldest(), last - keep + 1)
        named: dict[str, set[str]] = {}
        for version in range(first, last + 1):
            for table, state in self._log.state(version).items():
                named.setdefault(table, set()).update(f"load={f}" for f in state["folders"])
        gone = []
        for table in schemas.TABLES:
            gone += self._sweep(table, named.get(table, set()), before)
        if landings:
            for kind in Folder(self.spark, f"{self.root}/_landing").entries():
                gone += self._sweep(f"_landing/{kind}", set(), before)
        self._log.forget(first, before)
        return gone

    def _sweep(self, place: str, kept: set[str], before: float) -> Iterator[str]:
        folder = Folder(self.spark, f"{self.root}/{place}")
        for name, changed in folder.entries().items():
            if name not in kept and changed < before:
                folder.delete(name)
                yield f"{place}/{name}"

    def landing(self, kind: str, snapshot: str) -> str:
        return f"{self.root}/_landing/{kind}/{snapshot}"


def _one_of(column: str, numbers: list[int]) -> Column:
    """Whether a column is one of many numbers; parsed at once, not made one by one."""
    return F.expr(f"{column} IN ({', '.join(map(str, numbers))})")


def _bucket(key: str, n: int) -> Column:
    """The bucket of a row, as Spark's bucketing has it."""
    return F.pmod(F.hash(key), F.lit(n)).cast("int")
