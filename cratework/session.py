"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on (zone) or that keep plans safe under skew.
# Sizes are left to the cluster: AQE sizes partitions from shuffle statistics,
# and joins are broadcast only when Spark's own size check allows it.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Plans are built several times faster without a recorded call site per expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


#: Folders of tables that ``written`` made and nothing has deleted yet.
_made: list[str] = []


def session(app_name: str = "cratework", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session. Extra settings use ``__`` in place of ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Unset, it is a folder in the warehouse, which all executors share as well. Spark's own
    default for that is a local folder, which on a cluster they don't share: it is refused there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not usable(warehouse, spark.sparkContext.master):
        raise ValueError(f"{warehouse} is local to the driver: set spark.checkpoint.dir")
    return f"{warehouse}/_work"


def usable(folder: str, master: str) -> bool:
    """Whether all tasks of a master can be expected to share a folder."""
    local = re.match(r"file:|/", folder) or not re.match(r"\w+:", folder)
    return not local or re.match(r"local(\[|$)", master) is not None


def written(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut.

    ``batch_rows`` bounds the rows that go to a Python worker at once while it is computed, for
    rows so wide that Spark's own bound would take too much of an executor's memory.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    # Nothing reads the shuffle files again once the table is there.
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        settings["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    _made.append(path)
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, when all that read them is written itself."""
    for table in tables:
        deleted(table.sparkSession, table._written_to)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    if path in _made:
        _made.remove(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, in the end, all tables that ``written`` makes within.

    For a job that stores its result inside; frames that read such tables end with it.
    """
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            deleted(spark, path)
