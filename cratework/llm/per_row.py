"""Columns computed per row in Arrow batches."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


#: Rows that are turned into Python objects at once; a batch may have 64 MB.
SLICE = 256

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that no task depends on their own path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="run-")) / package.name
    context.addPyFile(
        shutil.make_archive(str(archive), "zip", root_dir=package.parent, base_dir=package.name)
    )
    _shipped.add(context.applicationId)


def append_columns(
    df: DataFrame,
    inputs: list[str],
    fields: StructType | str,
    prepare: Callable[[], Callable[..., list[tuple]]],
) -> DataFrame:
    """``df`` followed by ``fields``, which replace columns of the same names.

    ``prepare()`` runs once per task and returns a function from the input columns of a batch,
    as lists, to one tuple of field values per row. Spark bounds a batch by rows and by bytes.
    """
    ship_package(df.sparkSession)
    if isinstance(fields, str):
        fields = StructType.fromDDL(fields)
    kept = [c for c in df.columns if c not in fields.names]
    schema = StructType([df.schema[c] for c in kept] + list(fields))
    types = [to_arrow_type(f.dataType) for f in fields]
    narrowed = df.select(*kept, *[c for c in inputs if c not in kept])
    places = [narrowed.columns.index(c) for c in inputs]
    count = len(kept)

    def run(batches):
        compute = prepare()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = compute(*[part.column(i).to_pylist() for i in places])
                columns = list(zip(*rows, strict=True))
                new = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:count], *new], names=[f.name for f in schema]
                )

    return narrowed.mapInArrow(run, schema)
