"""Line dedup: range-partitioned line hashes, and keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratework.llm.common import folded, text_or_empty
from cratework.session import written

# The white space stripped around a line.
LINE_SPACE = " \t\n\x0b\x0c\r"
WORD_BITS = 64


def line_key(line: Column) -> Column:
    return folded(F.btrim(line, F.lit(LINE_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """One row per line with a key of at least ``min_chars`` code points: hash, document, position.

    A document is known by its id and the digest of its text, so that rows which share an id
    but not a text keep bitmaps of their own.
    """
    text = text_or_empty(text_column)
    exploded = docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(text).alias("text_mark"),
        F.posexplode(_lines(text)).alias("pos", "line"),
    ).withColumn("key", line_key(F.col("line")))
    return exploded.where(F.char_length("key") >= max(1, min_chars)).select(
        F.unhex(F.md5("key")).alias("hash"), "doc_id", "text_mark", "pos"
    )


def first_occurrences(lines: DataFrame) -> DataFrame:
    """The first line of each hash in each document.

    The rows are partitioned by ranges of (hash, document), so a hash found everywhere spans
    many partitions, sorted by position, and streamed: the window needs no exchange of its own.
    """
    in_order = Window.partitionBy("hash", "doc_id").orderBy("pos")
    return (
        lines.select("hash", "doc_id", "pos")
        .repartitionByRange(F.col("hash"), F.col("doc_id"))
        .withColumn("nth", F.row_number().over(in_order))
        .where("nth = 1")
        .drop("nth")
    )


def frequent_hashes(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes found in at least ``min_docs`` documents; map tasks count before the shuffle."""
    counted = first_occurrences(lines).groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.where(F.col("n_docs") >= min_docs)


def keep_bitmaps(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """Per document with lines to drop: ``keep``, 64 lines per word, and ``n_dropped``.

    Words after the last dropped line are left out; all their lines stay. No text is moved.
    """
    # The bucket makes both sides of the join plain exchanges, so that Spark can split a hot hash.
    bucketed = [df.withColumn("bucket", F.xxhash64("hash")) for df in (lines, frequent)]
    dropped = bucketed[0].join(bucketed[1].select("bucket", "hash"), ["bucket", "hash"])
    words = dropped.groupBy(
        "doc_id", "text_mark", F.expr(f"pos div {WORD_BITS}").cast("int").alias("word")
    ).agg(F.expr(f"bit_or(shiftleft(1L, pos % {WORD_BITS}))").alias("mask"))
    per_doc = words.groupBy("doc_id", "text_mark").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("masks"),
        F.max("word").alias("last"),
        F.sum(F.bit_count("mask")).alias("n_dropped"),
    )
    keep = F.transform(
        F.sequence(F.lit(0), F.col("last")),
        lambda word: F.bitwise_not(F.coalesce(F.col("masks")[word], F.lit(0).cast("bigint"))),
    )
    return per_doc.select("doc_id", "text_mark", keep.alias("keep"), "n_dropped")


def drop_repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
) -> DataFrame:
    """``docs`` with the lines dropped whose key is found in at least ``min_docs`` documents.

    A key is the line without white space at its ends and with A to Z in lower case; keys under
    ``min_chars`` code points always stay. All columns are returned, the text replaced, followed
    by ``n_lines`` (before dropping) and ``n_dropped``, which replace columns of these names.

    Documents are told apart by id: rows that share an id count once, and NULL ids count as one
    document. NULL and empty texts are one empty line. A text all of whose lines go is empty.
    The line hashes are written once to the shared folder, as they are read three times.
    """
    lines = written(line_hashes(docs, id_column, text_column, min_chars))
    bitmaps = keep_bitmaps(lines, frequent_hashes(lines, min_docs)).select(
        F.col("doc_id").alias("__llm_doc_id"),
        F.col("text_mark").alias("__llm_text_mark"),
        F.col("keep").alias("__llm_keep"),
        F.col("n_dropped").alias("__llm_n_dropped"),
    )
    text = text_or_empty(text_column)
    joined = docs.join(
        bitmaps,
        F.col(id_column).eqNullSafe(F.col("__llm_doc_id")) & (F.xxhash64(text) == F.col("__llm_text_mark")),
        "left",
    )
    kept = F.array_join(F.filter(_lines(text), _stays), "\n")
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[
            F.when(F.col("__llm_keep").isNull(), text).otherwise(kept).alias(c)
            if c == text_column
            else F.col(c)
            for c in others
        ],
        F.size(_lines(text)).cast("bigint").alias("n_lines"),
        F.coalesce("__llm_n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def _stays(line: Column, position: Column) -> Column:
    word = F.get(F.col("__llm_keep"), F.floor(position / WORD_BITS).cast("int"))
    return word.isNull() | (F.getbit(word, position % WORD_BITS) == 1)
