"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratework.session import dropped, written


def _stars(links: DataFrame, smaller: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours linked to the least of its neighbours and itself.

    ``links`` has rows (a, b) with a > b. Map tasks take partial minima, so a node with very many
    neighbours sends one row per task; the join back has plain exchanges that Spark can split.
    """
    if smaller:
        around = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    else:
        turned = links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        around = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(turned)
    least = around.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select(
        F.hex("node").alias("key"), "node", F.least("node", "least").alias("least")
    )
    joined = around.withColumn("key", F.hex("node")).join(least.drop("node"), "key")
    if smaller:
        pairs = joined.select(F.col("other").alias("a"), F.col("least").alias("b"))
        pairs = pairs.union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    else:
        pairs = joined.where(F.col("other") > F.col("node"))
        pairs = pairs.select(F.col("other").alias("a"), F.col("least").alias("b"))
    return pairs.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label): the least node that each node of ``links`` (a, b) is connected to.

    Nodes are binary. Every round writes its links to the shared folder, in place of those of the
    round before; the number of rounds
    grows with the logarithm of the longest chain. Links of a node with itself are ignored;
    without links the result is empty.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = written(ordered.where("a > b").distinct())
    state = None
    while True:
        before, current = current, written(_stars(_stars(current, smaller=False), smaller=True))
        dropped(before)
        found = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        after = tuple(found.first())
        if after == state or not after[0]:
            break
        state = after
    members = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return members.union(members.select(F.col("label").alias("node"), "label").distinct())
