"""The shared folder, and what is left in it."""

import os

import pytest

from cratework.session import _made, dropped, shared_folder, temporary, usable, written

pytestmark = pytest.mark.usefixtures("small_jobs")


def entries(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file:")))


def test_written_tables_are_deleted(spark):
    before = entries(spark) if os.path.exists(shared_folder(spark)) else set()
    first = written(spark.range(3), batch_rows=2)
    with temporary(spark):
        second = written(first.union(first))
        assert second.count() == 6 and len(entries(spark) - before) == 2
    assert len(entries(spark) - before) == 1 and first.count() == 3
    dropped(first)
    assert entries(spark) == before and first._written_to not in _made
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


@pytest.mark.parametrize(
    ("folder", "master", "fit"),
    [
        ("file:/a/warehouse", "local[8]", True),
        ("/a/warehouse", "local", True),
        ("spark-warehouse", "yarn", False),
        ("file:/a/warehouse", "local-cluster[3,2,3000]", False),
        ("file:/a/warehouse", "spark://host:7077", False),
        ("hdfs://host/warehouse", "yarn", True),
    ],
)
def test_a_local_folder_is_for_local_masters(folder, master, fit):
    assert usable(folder, master) == fit
