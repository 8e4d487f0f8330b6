import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Names that the operators add or use themselves.
CLASHING = ["score", "predicted", "n_words", "ids", "node", "bucket", "kept", "spans", "licenses"]
SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType())]
    + [StructField(c, StringType()) for c in CLASHING]
)


def documents(spark, rows):
    """Documents of (id, text), with extra columns."""
    return spark.createDataFrame([(i, t, *[None] * len(CLASHING)) for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, "One two three four five six seven."),
    (1, "One two three four five six seven."),
    (2, None),
    (3, ""),
    (None, "no id here"),
    (None, None),
    (4, LONG),
    (5, " \n\n \t\n"),
    (6, "é漢🙂 ÀÉ \x00\x01 ▁ <0x41>"),
]


@pytest.fixture
def odd(spark, small_jobs):
    return documents(spark, ODD)


@pytest.fixture
def nothing(spark, small_jobs):
    return documents(spark, [])
