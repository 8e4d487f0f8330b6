"""Merges of new rows into stored tables; each returns the next state of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_per_key(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row per key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def first_per_key(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The first row per key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order.asc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    key: list[str],
    keep: tuple[str, ...] = (),
    status: str | None = None,
) -> DataFrame:
    """Merge by key: columns of ``incoming`` overwrite, also with NULL; others stay.

    Columns in ``keep`` are only set on new rows. ``incoming`` must be unique on
    the key (see ``last_per_key``). ``status`` names a column to add, which says whether a row
    was ``created`` or ``updated``; NULL on rows that stay.
    """
    renamed = incoming.select(
        *key,
        *[F.col(c).alias(f"_new_{c}") for c in incoming.columns if c not in key],
        F.lit(True).alias("_supplied"),
    )
    joined = stored.withColumn("_stored", F.lit(True)).join(renamed, key, "full_outer")

    def merged(name: str) -> Column:
        if name in key or name not in incoming.columns:
            return F.col(name)
        overwritten = F.col("_supplied").isNotNull()
        if name in keep:
            overwritten = F.col("_stored").isNull()
        value = F.when(overwritten, F.col(f"_new_{name}")).otherwise(F.col(name))
        return value.alias(name)

    created = F.when(F.col("_stored").isNull(), "created")
    marked = [created.when(F.col("_supplied").isNotNull(), "updated").alias(status)] if status else []
    return joined.select(*[merged(name) for name in stored.columns], *marked)


def refresh(
    stored: DataFrame,
    incoming: DataFrame,
    key: list[str],
    now: Column | None = None,
    status: str | None = None,
) -> DataFrame:
    """Upsert that keeps ``created_at`` of known rows and sets ``updated_at`` of all given."""
    now = F.current_timestamp() if now is None else now
    stamped = incoming.withColumn("created_at", now).withColumn("updated_at", now)
    return upsert(stored, stamped, key, keep=("created_at",), status=status)


def insert_new(
    stored: DataFrame,
    incoming: DataFrame,
    key: list[str],
    unique: bool = False,
    order: Column | None = None,
) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored, one per key: the first in ``order``.

    Without an order the smallest row of equal keys stays, on any number of partitions.
    ``unique`` says that ``incoming`` has one row per key already.
    """
    rows = incoming
    if not unique:
        order = F.struct(*[F.col(c) for c in incoming.columns]) if order is None else order
        rows = first_per_key(incoming, key, order)
    return rows.join(stored.select(*key), key, "left_anti")


def insert_ignore(
    stored: DataFrame,
    incoming: DataFrame,
    key: list[str],
    unique: bool = False,
    order: Column | None = None,
) -> DataFrame:
    """Append rows with a new key; a stored row always wins."""
    new = insert_new(stored, incoming, key, unique, order)
    return stored.unionByName(new.select(*stored.columns))


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Swap all child rows of every parent that has new ones; other parents keep theirs."""
    parents = incoming.select(parent).distinct()
    kept = stored.join(parents, parent, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def emptied(stored: DataFrame) -> DataFrame:
    """The table without rows, same schema."""
    return stored.where(F.lit(False))
