"""Codes for vectors: per-part codebooks, searched by Orchard's neighbour lists."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cratework.llm.per_row import ship_package
from cratework.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: Vectors that are searched at once.
_SLICE = 2048

#: A label with more than this share of the rows is joined by broadcast; so at most 1,000 are.
_HOT_SHARE = 1000

#: Integer components stay under this, so that 64-bit sums of squares are exact.
_MOST = 1 << 27


class Orchard:
    """The nearest of a part's entries, by Orchard's search.

    ``order[e]`` lists the other entries by their distance from ``e``. A search stands at its
    best entry so far and walks that entry's list. A better entry becomes the standing one, and
    the walk goes on in its list from the start; entries measured before are marked and not
    measured again. An entry more than twice as far from the standing one as the vector is can't
    be nearer, so the walk stops there: in squared distances, beyond four times. Those at just
    twice the distance may tie and are measured, so that the lower index wins every tie.

    All vectors of a slice walk in step; those that stopped leave.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = entries[:, None, :] - entries[None, :, :]
        between = np.einsum("ijk,ijk->ij", apart, apart)
        order = np.argsort(between, axis=1, kind="stable")
        others = order != np.arange(len(entries))[:, None]
        self.order = order[others].reshape(len(entries), -1)
        self.reach = np.take_along_axis(between, self.order, axis=1)
        middle = between.astype(float).sum(axis=1)
        self.start = int(middle.argmin())

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector the index of its nearest entry, and their squared distance."""
        entries, n = self.entries, len(vectors)
        best = np.full(n, self.start)
        away = vectors - entries[self.start]
        least = np.einsum("ij,ij->i", away, away)
        marked = np.zeros((n, len(entries)), bool)
        marked[:, self.start] = True
        at = np.zeros(n, np.int64)
        width = self.order.shape[1]
        active = np.arange(n) if width else np.arange(0)
        while len(active):
            here, place = best[active], at[active]
            near = self.reach[here, place] <= 4 * least[active]
            active, here, place = active[near], here[near], place[near]
            entry = self.order[here, place]
            at[active] += 1
            fresh = ~marked[active, entry]
            rows, tried = active[fresh], entry[fresh]
            marked[rows, tried] = True
            away = vectors[rows] - entries[tried]
            distance = np.einsum("ij,ij->i", away, away)
            better = (distance < least[rows]) | ((distance == least[rows]) & (tried < best[rows]))
            rows, tried = rows[better], tried[better]
            best[rows], least[rows], at[rows] = tried, distance[better], 0
            active = active[at[active] < width]
        return best, least


def _finite(vector: Column) -> Column:
    """Whether a vector, all its components and their integers can be used."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, usable)


def integer_vectors(
    vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int = SCALE
) -> DataFrame:
    """``vec_id``, ``label`` and ``numbers`` (floor of ``scale`` times each component), finite only.

    The scaling is a power of two, so it is exact in floating point before the floor.
    """
    wide = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(
        F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), wide.alias("wide")
    ).where(_finite(F.col("wide")))
    small = F.forall("wide", lambda x: F.abs(x * scale) < _MOST)
    numbers = F.transform("wide", lambda x: F.floor(x * scale).cast("bigint"))
    return rows.select(
        "vec_id",
        "label",
        F.when(small, numbers)
        .otherwise(F.raise_error(F.lit(f"a component is over {_MOST // scale}: no exact distance")))
        .alias("numbers"),
    )


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"vectors of {width} components and others are mixed")
    return column.flatten().to_numpy().reshape(batch.num_rows, width)


def _searches(codebooks: np.ndarray) -> list[Orchard]:
    return [Orchard(entries) for entries in codebooks]


def _improved(numbers: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of the parts that it is nearest to.

    Every task adds up its vectors by (part, entry), so it sends one row for each, whatever the
    table's size; the sums are added as decimals, which can't overflow.
    """
    parts, entries, size = codebooks.shape
    shared = numbers.sparkSession.sparkContext.broadcast(codebooks)

    def add_up(batches):
        searches = _searches(shared.value)
        sums = np.zeros((parts, entries, size), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                rows = _matrix(batch.slice(at, _SLICE), "numbers", parts * size)
                for p, search in enumerate(searches):
                    part = rows[:, p * size : (p + 1) * size]
                    nearest, _ = search.nearest(part)
                    np.add.at(sums[p], nearest, part)
                    counts[p] += np.bincount(nearest, minlength=entries)
        used = np.argwhere(counts)
        if len(used):
            p, e = used.T
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p * entries + e, pa.int64()),
                    pa.array(counts[p, e], pa.int64()),
                    pa.array(list(sums[p, e]), pa.list_(pa.int64())),
                ],
                names=["entry", "n", "sums"],
            )

    added = numbers.select("numbers").mapInArrow(add_up, "entry bigint, n bigint, sums array<bigint>")
    totals = added.groupBy("entry").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(size)],
    )
    improved = codebooks.copy()
    for row in totals.collect():  # at most parts * entries rows
        improved[divmod(row["entry"], entries)] = [
            int(row[f"s{k}"]) // row["n"] for k in range(size)
        ]
    shared.unpersist()
    return improved


def first_codebooks(numbers: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors of the ``entries`` smallest ids, as (part, entry, component)."""
    ordered = numbers.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(entries)
    rows = [r["numbers"] for r in ordered.select("numbers").collect()]
    if not rows:
        return None
    width = len(rows[0])
    if width % parts or any(len(r) != width for r in rows):
        raise ValueError(f"vectors must all have one length, a multiple of {parts}")
    return np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def fit_codebooks(
    numbers: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray | None:
    """Codebooks over all rows; their size is fixed. None where there are no rows."""
    codebooks = first_codebooks(numbers, parts, entries)
    for _ in range(rounds if codebooks is not None else 0):
        codebooks = _improved(numbers, codebooks)
    return codebooks


def encode_vectors(numbers: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits a part) and ``error`` of each row."""
    parts, entries, size = codebooks.shape
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    shared = numbers.sparkSession.sparkContext.broadcast(codebooks)
    schema = StructType(
        [
            numbers.schema["vec_id"],
            numbers.schema["label"],
            StructField("code", StringType()),
            StructField("error", LongType()),
        ]
    )

    def run(batches):
        searches = _searches(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                piece = batch.slice(at, _SLICE)
                rows = _matrix(piece, "numbers", parts * size)
                codes = np.zeros((len(rows), parts), np.uint8)
                error = np.zeros(len(rows), np.int64)
                for p, search in enumerate(searches):
                    codes[:, p], distance = search.nearest(rows[:, p * size : (p + 1) * size])
                    error += distance
                code = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(code), pa.array(error)],
                    names=schema.names,
                )

    return numbers.mapInArrow(run, schema)


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over equal labels; NULLs are equal.

    A label that many rows share would go to one task of a join. Labels with more than a
    thousandth of the rows, fewer than a thousand by that, are broadcast instead.
    """
    per_label = written(
        coded.groupBy("label").agg(
            F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")
        )
    )
    rows = per_label.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * _HOT_SHARE > rows
    hot = F.broadcast(per_label.where(is_hot).select(F.col("label").alias("hot"), "label_error"))
    cold = per_label.where(~is_hot).select(F.col("label").alias("cold"), "label_error")
    same_hot = F.col("label").eqNullSafe(F.col("hot"))
    same_cold = F.col("label").eqNullSafe(F.col("cold"))
    columns = [*coded.columns, "label_error"]
    return (
        coded.join(hot, same_hot)
        .select(columns)
        .unionByName(
            coded.join(hot.select("hot"), same_hot, "left_anti").join(cold, same_cold).select(columns)
        )
    )


def compress_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """A code per vector and the codebooks' digest.

    Vectors are made integers (floor of 256 times each component) and cut into ``parts`` equal
    parts. Each part's codebook begins with that part of the vectors of the ``entries`` smallest
    ids (ties by the vector itself, NULL ids last), and each of ``rounds`` rounds replaces its
    entries by the floored means of the parts nearest to them; unused entries stay. Nearest is by
    squared distance, ties to the lower index.

    One row per kept vector: ``vec_id``, ``code``, ``error`` (squared distances, summed over
    parts), ``label_error`` (summed over the label), ``codebooks_sha256``. NULL vectors, and
    those with a NULL or non-finite component, are dropped. Repeated rows are kept. An empty
    table gives an empty result. Vectors of several lengths, of a length that can't be cut, or
    with components beyond 2^19, whose errors would not be exact, raise an error. Other columns
    are not read.

    The integer vectors are written once, as each round reads them all. A round sends at most
    ``parts * entries`` sums per task.
    """
    numbers = written(integer_vectors(vectors, id_column, vector_column, label_column))
    codebooks = fit_codebooks(numbers, parts, entries, rounds)
    if codebooks is None:
        empty = numbers.select(
            "vec_id",
            F.lit("").alias("code"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")],
        )
        return empty.withColumn("codebooks_sha256", F.lit(""))
    ship_package(vectors.sparkSession)
    coded = label_errors(written(encode_vectors(numbers, codebooks)))
    return coded.select(
        "vec_id",
        "code",
        "error",
        "label_error",
        F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"),
    )
