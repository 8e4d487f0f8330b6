"""XML catalogue dumps as typed rows.

A dump is split at a tag of its records, so plain files are read by many tasks
and one broken record spoils only itself: artists, masters and releases at the
closing tag, labels, which nest elements of their own name, at the bare opening
tag, as nested labels carry an id. A gzip file is unpacked by one task; its
fragments are spread over the cluster before any XML is parsed.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cratework import schemas
from cratework.functions import clean_text, dump_date, partial_date, safe_int, safe_long
from cratework.functions.text import is_ascii
from cratework.operators.quality import LoadRejected
from cratework.sources.commit_log import Folder
from cratework.sources.positions import POSITION, file_position, position_of

KINDS = ("artists", "labels", "masters", "releases")


#: Compressed bytes that one partition of unpacked fragments stands for.
GZIP_PARTITION_BYTES = 8 << 20

# Record element of each dump whose records never nest an element of the same name.
RECORD_TAGS = {"artists": "artist", "masters": "master", "releases": "release"}


# ------------------------------------------------------------------ nested lists
def _text(value: Column | str) -> Column:
    """Text of an element, NULL if blank.

    The XML reader has removed plain white space already; only text with other
    characters is searched again.
    """
    text = F.col(value) if isinstance(value, str) else value
    return F.when(is_ascii(text), F.when(text != "", text)).otherwise(clean_text(text))


def _bad_id(value: Column) -> Column:
    return (F.coalesce(value, F.lit("")) != "") & safe_long(value).isNull()


def _texts(items: str) -> Column:
    return F.filter(F.transform(F.col(items), _text), lambda x: x.isNotNull())


def _aliases() -> Column:
    aliases = F.transform(
        F.col("aliases.name"),
        lambda a: F.struct(safe_long(a["_id"]).alias("id"), _text(a["_VALUE"]).alias("name")),
    )
    return F.filter(aliases, lambda a: a["name"].isNotNull())


def _has_bad_alias() -> Column:
    """A named alias whose id is no number rejects the whole artist."""
    return F.exists(
        F.col("aliases.name"), lambda a: _text(a["_VALUE"]).isNotNull() & _bad_id(a["_id"])
    )


def _holds_something(item: Column, names: list[str]) -> Column:
    return reduce(or_, [item[name].isNotNull() for name in names])


def _credits(column: str) -> Column:
    """Credits with a bad id or nothing in them are dropped, those without an id kept."""
    texts = ["name", "anv", "join", "role", "tracks"]
    usable = F.filter(F.col(f"{column}.artist"), lambda c: ~_bad_id(c["id"]))
    credits = F.transform(
        usable,
        lambda c: F.struct(safe_long(c["id"]).alias("id"), *[_text(c[t]).alias(t) for t in texts]),
    )
    return F.filter(credits, lambda c: _holds_something(c, ["id", *texts]))


def _release_labels() -> Column:
    refs = F.transform(
        F.col("labels.label"),
        lambda r: F.struct(
            safe_long(r["_id"]).alias("id"),
            F.nullif(r["_name"], F.lit("")).alias("name"),
            F.nullif(r["_catno"], F.lit("")).alias("catno"),
        ),
    )
    return F.filter(refs, lambda r: _holds_something(r, ["id", "name", "catno"]))


def _formats() -> Column:
    """Descriptions count whether they are wrapped in their own list or not."""

    def one(item: Column) -> Column:
        every = F.concat(
            F.coalesce(item["description"], F.array()),
            F.coalesce(item["descriptions"]["description"], F.array()),
        )
        return F.struct(
            item["_name"].alias("name"),
            item["_qty"].alias("qty"),
            item["_text"].alias("text"),
            F.filter(F.transform(every, _text), lambda d: d.isNotNull()).alias("descriptions"),
        )

    described = F.transform(F.col("formats.format"), one)
    return F.transform(
        described,
        lambda f: f.withField(
            "descriptions", F.when(F.size(f["descriptions"]) > 0, f["descriptions"])
        ),
    )


def _tracklist() -> Column:
    tracks = F.transform(
        F.col("tracklist.track"),
        lambda t: F.struct(
            _text(t["position"]).alias("position"),
            _text(t["title"]).alias("title"),
            _text(t["duration"]).alias("duration"),
            F.nullif(t["_type"], F.lit("")).alias("type_"),
        ),
    )
    names = ["position", "title", "duration", "type_"]
    return F.filter(tracks, lambda t: _holds_something(t, names))


def _sublabels() -> Column:
    ids = F.transform(F.col("sublabels.label"), lambda s: safe_long(s["_id"]))
    return F.filter(ids, lambda i: i.isNotNull())


# -------------------------------------------------------------- record to columns
def _columns(kind: str) -> dict[str, Column]:
    if kind == "artists":
        return {
            "id": safe_long("id"),
            "name": _text("name"),
            "real_name": _text("realname"),
            "profile": _text("profile"),
            "data_quality": _text("data_quality"),
            "urls": _texts("urls.url"),
            "name_variations": _texts("namevariations.name"),
            "aliases": _aliases(),
        }
    if kind == "labels":
        return {
            "id": safe_long("id"),
            "name": _text("name"),
            "contact_info": _text("contactinfo"),
            "profile": _text("profile"),
            "data_quality": _text("data_quality"),
            "parent_label_id": safe_long("parentLabel._id"),
            "subsidiaries": _sublabels(),
            "urls": _texts("urls.url"),
        }
    if kind == "masters":
        return {
            "id": safe_long("_id"),
            "title": _text("title"),
            "main_release_id": safe_long("main_release"),
            "year": safe_int("year"),
            "data_quality": _text("data_quality"),
            "notes": _text("notes"),
            "genres": _texts("genres.genre"),
            "styles": _texts("styles.style"),
        }
    return {
        "id": safe_long("_id"),
        "master_id": safe_long("master_id"),
        "title": _text("title"),
        "year": safe_int("year"),
        "country": _text("country"),
        "released": partial_date("released"),
        "notes": _text("notes"),
        "data_quality": _text("data_quality"),
        "status": F.col("_status"),
        "artists": _credits("artists"),
        "extraartists": _credits("extraartists"),
        "labels": _release_labels(),
        "tracklist": _tracklist(),
        "genres": _texts("genres.genre"),
        "styles": _texts("styles.style"),
        "formats": _formats(),
    }


def _reason(kind: str) -> Column:
    """Why a record is rejected; NULL if it isn't.

    Records need a numeric id and a name or title; artists and labels no id 0.
    """
    id_column, text = ("_id", "title") if kind in ("masters", "releases") else ("id", "name")
    reason = F.when(F.col("_corrupt").isNotNull(), "not readable")
    reason = reason.when(safe_long(id_column).isNull(), "no numeric id")
    if kind in ("artists", "labels"):
        reason = reason.when(safe_long(id_column) == 0, "id 0")
    reason = reason.when(_text(text).isNull(), f"no {text}")
    if kind == "artists":
        reason = reason.when(F.coalesce(_has_bad_alias(), F.lit(False)), "alias id not numeric")
    return reason


def raw_schema(kind: str) -> str:
    return f"{schemas.XML_RECORDS[kind]}, _corrupt string"


def parse_fragments(
    fragments: DataFrame, kind: str, column: str = "fragment", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Raw records from one XML element per row; unreadable ones carry ``_corrupt``."""
    record = F.from_xml(
        F.col(column),
        raw_schema(kind),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    # Unpacked by a generator, so that each element is parsed once: a plain projection
    # would be merged into, and repeated by, every expression that reads a field of it.
    return fragments.select(*position_of(fragments), *keep, F.inline(F.array(record)))


def checked(raw: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed catalogue columns plus ``valid``; both come from one pass over the records.

    With ``fragment`` among the columns to ``keep``, those not valid keep it, and ``reason``.
    """
    columns = [column.alias(name) for name, column in _columns(kind).items()]
    reason = _reason(kind)
    kept = [F.when(reason.isNotNull(), F.col(c)).alias(c) if c == "fragment" else F.col(c) for c in keep]
    if "fragment" in keep:
        kept.append(reason.alias("reason"))
    typed = raw.select(*columns, reason.isNull().alias("valid"), *position_of(raw), *kept)
    # An empty list is stored as NULL.
    return typed.select(
        *[
            F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f.name)
            for f in typed.schema.fields
        ]
    )


def accepted(records: DataFrame) -> DataFrame:
    return records.where("valid").drop("valid")


# ------------------------------------------------------------------------- files
def _tags(kind: str) -> list[Column]:
    """``opened`` and ``closed`` root elements, and ``records`` whose tag was opened."""
    if kind == "labels":
        records = F.count_if(_is_label())
    else:
        records = F.sum(F.regexp_count("value", F.lit(f"<{RECORD_TAGS[kind]}(?=[\\s/>])")))
    return [
        F.count_if(F.col("value").rlike(f"<{kind}[\\s>]")).alias("opened"),
        F.count_if(F.col("value").contains(f"</{kind}>")).alias("closed"),
        F.coalesce(records, F.lit(0)).cast("bigint").alias("records"),
    ]


def _is_label() -> Column:
    """Neither what stands before the first label, nor a nested one without an attribute."""
    value = F.col("value")
    before = value.rlike("<labels[\\s>]") & ~value.contains("</label>") | (F.trim(value) == "")
    return ~before & ~value.rlike("^[^<]*</label>")


def _gzip_partitions(spark: SparkSession, path: str | list[str]) -> int:
    """Partitions for the fragments of gzip files, by their size; 0 for plain files."""
    files = spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".gz"))
    size = files.agg(F.sum("length")).first()[0]
    if size is None:
        return 0
    return max(spark.sparkContext.defaultParallelism, size // GZIP_PARTITION_BYTES + 1)


def _read_pieces(
    spark: SparkSession, path: str | list[str], kind: str, separator: str, tags: Observation | None
) -> DataFrame:
    text = spark.read.option("lineSep", separator).text(path)
    text = text.select("value", file_position().alias("piece"))
    if tags is not None:
        text = text.observe(tags, *_tags(kind))
    partitions = _gzip_partitions(spark, path)
    return text.repartition(partitions) if partitions else text


def read_fragments(
    spark: SparkSession, path: str | list[str], kind: str, tags: Observation | None = None
) -> DataFrame:
    """``fragment``: one XML element per row, cut out of the text of the dump; ``position``.

    ``tags`` observes ``opened`` and ``closed`` root elements, which differ if a file ends
    early, and the ``records`` whose tag was opened, of which a broken one may hide the next.
    """
    if kind == "labels":
        text = _read_pieces(spark, path, kind, "<label>", tags).where(_is_label())
        closed = F.substring_index("value", "</label>", -1)
        whole = F.substring("value", F.lit(1), F.char_length("value") - F.char_length(closed))
        # A nested label without an attribute ends the piece early; what stands after it
        # in its record is not read.
        cut = F.col("value").contains("<sublabels>") & ~F.col("value").contains("</sublabels>")
        record = F.when(cut, F.concat(F.col("value"), F.lit("</sublabels></label>"))).otherwise(
            F.when(F.col("value").contains("</label>"), whole).otherwise(F.col("value"))
        )
        fragment = F.concat(F.lit("<label>"), record)
        return text.select(
            fragment.alias("fragment"),
            F.struct("piece.*", F.lit(0).alias("nth")).alias(POSITION),
        )
    tag = RECORD_TAGS[kind]
    text = _read_pieces(spark, path, kind, f"</{tag}>", tags)
    # An opening tag that does not close itself starts the record; whatever closes
    # itself before that is a record of its own, an empty one.
    opening = f"<{tag}(?:\\s(?:[^<]*?[^/<])?)?>"
    empty = f"<{tag}(?:\\s[^<]*?)?/>"
    found = text.select("value", "piece", F.regexp_instr("value", F.lit(opening)).alias("start"))
    has_record = F.col("start") > 0
    before = F.when(has_record, F.expr("substring(value, 1, start - 1)")).otherwise(F.col("value"))
    record = F.concat(F.expr("substring(value, start)"), F.lit(f"</{tag}>"))
    pieces = F.concat(
        F.regexp_extract_all(before, F.lit(empty), F.lit(0)),
        F.when(has_record, F.array(record)).otherwise(F.array().cast("array<string>")),
    )
    exploded = found.select("piece", F.posexplode(pieces).alias("nth", "fragment"))
    return exploded.select("fragment", F.struct("piece.*", "nth").alias(POSITION))


def check_roots(opened: int, closed: int) -> None:
    """An empty file opens no root element, a truncated one never closes it."""
    if opened == 0 or opened != closed:
        raise LoadRejected(f"dump cut off: {opened} root elements opened, {closed} closed")


def read_records(
    spark: SparkSession,
    path: str | list[str],
    kind: str,
    tags: Observation | None = None,
    keep_fragments: bool = False,
) -> DataFrame:
    """Typed rows of a dump, ``valid`` and ``position``; nothing is rejected silently.

    ``keep_fragments`` adds ``fragment`` and ``reason``, set where a record is not valid.
    """
    keep = ("fragment",) if keep_fragments else ()
    fragments = read_fragments(spark, path, kind, tags)
    return checked(parse_fragments(fragments, kind, keep=keep), kind, keep)


def landed_schema(kind: str) -> str:
    """Columns of ``read_records`` with fragments, but ``valid``."""
    typed = checked(
        SparkSession.active().createDataFrame([], f"{raw_schema(kind)}, fragment string"),
        kind,
        ("fragment",),
    )
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema if f.name != "valid"
    )
    return f"{columns}, {POSITION} struct<file:string,split:bigint,row:bigint,nth:int>"


def read_dump(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """Accepted rows of a dump."""
    return accepted(read_records(spark, path, kind)).drop(POSITION)


def dump_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """path, file_name, modified, dump_date of the dumps of one kind; contents stay unread.

    A dump is a file, or a folder of that name with its parts, each a dump by itself.
    """
    listed = Folder(spark, folder)
    changed = listed.changed()
    if not listed.exists():
        raise FileNotFoundError(folder)
    named = [n for n in changed if re.search(f"_{kind}\\.xml", n) and n[0] not in "._"]
    rows = [(f"{listed.location}/{n}", n, changed[n]) for n in named]
    files = spark.createDataFrame(rows, "path string, file_name string, modified bigint")
    return files.select(
        "path",
        "file_name",
        F.timestamp_millis("modified").alias("modified"),
        dump_date("file_name").alias("dump_date"),
    )


def newest_dump(files: DataFrame) -> DataFrame:
    """The dump with the latest date in its name, then the latest change."""
    return files.orderBy(F.desc_nulls_last("dump_date"), F.desc("modified"), "file_name").limit(1)
