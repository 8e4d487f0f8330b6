"""Landed JSON: collection pages, and documents of single entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratework import schemas
from cratework.functions import iso_timestamp, partial_date, reference_id
from cratework.sources.positions import POSITION, file_position, position_of


def read_pages(
    spark: SparkSession, path: str | list[str], json_lines: bool = False
) -> DataFrame:
    """Collection pages, one per file; ``json_lines`` for one per line, which splits files."""
    reader = spark.read.schema(schemas.JSON_PAGE).option("multiLine", not json_lines)
    return reader.json(path)


def parse_pages(text: DataFrame, column: str = "value") -> DataFrame:
    """Collection pages from JSON text."""
    return text.select(F.inline(F.array(F.from_json(F.col(column), schemas.JSON_PAGE))))


def collection_items(pages: DataFrame, user_id: Column | int) -> DataFrame:
    """One row per item in the shape of the stored collection.

    Notes may be text or a list; a list is kept as its JSON text, an empty one as
    NULL. The release id is NULL when an item carries none (or 0).
    """
    user = user_id if isinstance(user_id, Column) else F.lit(user_id)
    items = pages.select(F.explode("releases").alias("i"))
    listed = F.try_parse_json("i.notes").cast("string")
    notes = F.when(F.col("i.notes").startswith("["), F.coalesce(listed, F.col("i.notes"))).otherwise(
        F.col("i.notes")
    )
    return items.select(
        user.cast("bigint").alias("user_id"),
        F.nullif("i.basic_information.id", F.lit(0).cast("bigint")).alias("release_id"),
        "i.folder_id",
        "i.instance_id",
        "i.rating",
        F.when(~notes.isin("", "[]"), notes).alias("notes"),
        iso_timestamp("i.date_added").alias("date_added"),
        "i.basic_information",
    )


def has_release(release_id: str = "release_id") -> Column:
    return F.col(release_id).isNotNull()


def _empty_if_absent(*names: str) -> list[Column]:
    return [F.coalesce(name, F.array()).alias(name) for name in names]


def _with_ids(column: str) -> Column:
    """Credits with their id read as a number."""
    return F.transform(
        F.coalesce(F.col(column), F.array()), lambda x: x.withField("id", reference_id(x["id"]))
    )


def _label_refs() -> Column:
    """Label references in the stored shape; the catalogue number has two spellings."""
    return F.transform(
        F.coalesce("labels", F.array()),
        lambda x: F.struct(
            reference_id(x["id"]).alias("id"),
            x["name"].alias("name"),
            F.coalesce(
                F.nullif(x["catno"], F.lit("")),
                F.nullif(x["catalog_number"], F.lit("")),
                x["catno"],
            ).alias("catno"),
        ),
    )


def artist_rows(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("id") != 0).select(
        *position_of(documents),
        "id", "name", F.col("realname").alias("real_name"), "profile", "data_quality",
        F.coalesce("namevariations", F.array()).alias("name_variations"),
        *_empty_if_absent("aliases", "urls", "members", "groups", "images"),
    )


def label_rows(documents: DataFrame) -> DataFrame:
    """The parent stays NULL on this path."""
    return documents.where(F.col("id") != 0).select(
        *position_of(documents),
        "id", "name", F.col("contactinfo").alias("contact_info"), "profile", "data_quality",
        F.lit(None).cast("bigint").alias("parent_label_id"),
        F.coalesce(F.col("sublabels.id"), F.array()).alias("subsidiaries"),
        *_empty_if_absent("urls", "images"),
    )


def master_rows(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("id").isNotNull()).select(
        *position_of(documents),
        "id", "title", "year", F.col("main_release").alias("main_release_id"), "data_quality",
        *_empty_if_absent("artists", "genres", "styles", "images", "videos"),
    )


def release_rows(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("id").isNotNull()).select(
        *position_of(documents),
        "id", "title", "year", partial_date("released").alias("released"), "master_id", "country",
        "status", "data_quality",
        _with_ids("artists").alias("artists"),
        _with_ids("extraartists").alias("extraartists"),
        _label_refs().alias("labels"),
        *_empty_if_absent(
            "companies", "formats", "genres", "styles", "tracklist", "identifiers", "images",
            "videos",
        ),
        "notes", "estimated_weight",
    )


ROWS = {
    "artists": artist_rows,
    "labels": label_rows,
    "masters": master_rows,
    "releases": release_rows,
}


def read_documents(
    spark: SparkSession, path: str | list[str], kind: str, json_lines: bool = False
) -> DataFrame:
    """Rows of landed entity documents, one JSON object per file or, if asked, per line.

    ``position`` is where a document stands: file, first byte of the split, row in it.
    """
    reader = spark.read.schema(schemas.JSON_DOCUMENTS[kind]).option("multiLine", not json_lines)
    documents = reader.json(path)
    return ROWS[kind](documents.select("*", file_position().alias(POSITION)))


def parse_documents(text: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Rows of entity documents held as JSON text."""
    # Unpacked by a generator, so that each document is parsed once.
    document = F.from_json(F.col(column), schemas.JSON_DOCUMENTS[kind])
    return ROWS[kind](text.select(F.inline(F.array(document))))
