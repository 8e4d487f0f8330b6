"""Incremental collection sync over landed page files, into the stored tables.

Each micro-batch is parsed once, into a landing folder of its own, and published like a batch
sync: new items, status and provenance become visible together. The anti join against the
stored keys replaces stream state, so nothing has to fit in memory and no watermark is needed.
A batch that runs again after a failure overwrites its landing folder, and is skipped if its
provenance row says that it was published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cratework import schemas
from cratework.operators.quality import split_valid
from cratework.plans.load import publish_items
from cratework.plans.sync import is_valid_item
from cratework.sources.json_documents import collection_items
from cratework.sources.snapshots import SnapshotStore


def stream_items(
    spark: SparkSession, landing: str, user_id: int, json_lines: bool = False,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Streaming items of one user's page files."""
    reader = spark.readStream.schema(schemas.JSON_PAGE).option("multiLine", not json_lines)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return collection_items(reader.json(landing), user_id)


def start_sync(
    items: DataFrame,
    store: SnapshotStore,
    user_id: int,
    force: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """Take the new items of one user into the store's collection.

    Items that are not valid stay in their batch's landing folder and are counted in the
    status. The checkpoint is kept in the store, as its batch numbers name the landings.
    """
    checkpoint = f"{store.root}/_stream/user={user_id}"

    def apply(batch: DataFrame, batch_id: int) -> None:
        name = f"stream-{user_id}-{batch_id}"
        landing = store.landing("collection", name)
        batch.write.mode("overwrite").parquet(landing)
        sources = store.refreshed().read("data_sources")
        if sources.where(F.col("snapshot") == name).isEmpty():
            landed = store.spark.read.schema(items.schema).parquet(landing)
            publish_items(store, landed, user_id, name, landing, force)

    writer = items.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def rejected_items(store: SnapshotStore, user_id: int) -> DataFrame:
    """Items of a user's streamed batches that are not valid."""
    landings = store.landing("collection", f"stream-{user_id}-*")
    return split_valid(store.spark.read.parquet(landings), is_valid_item())[1]
