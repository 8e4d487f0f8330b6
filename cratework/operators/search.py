"""Search for text inside names by a stored table of their trigrams, without reading the names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratework.functions import contains_ci
from cratework.functions.text import ascii_lower

GRAM = 3


def grams(text: Column) -> Column:
    """The different runs of three characters of a text, A to Z in lower case."""
    folded = ascii_lower(text)
    starts = F.sequence(F.lit(1), F.char_length(folded) - (GRAM - 1))
    runs = F.transform(starts, lambda at: F.substring(folded, at, F.lit(GRAM)))
    return F.when(F.char_length(folded) >= GRAM, F.array_distinct(runs)).otherwise(F.array())


def postings(entities: DataFrame, kind: str, name: str = "name") -> DataFrame:
    """``gram``, ``kind``, ``id``: a row for each trigram of each name."""
    return entities.select(
        F.explode(grams(F.col(name))).alias("gram"), F.lit(kind).alias("kind"), "id"
    )


def grams_of(text: str) -> list[str]:
    """The trigrams that every name holds which holds ``text``; none if it is too short.

    Wildcards in the text may stand for anything, so only the pieces between them count.
    """
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    pieces = re.split("[%_]", lower)
    return sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def with_text(
    entities: DataFrame, found: DataFrame, kind: str, text: str, name: str = "name"
) -> DataFrame:
    """The entities whose name contains ``text``, A to Z in either case.

    ``found`` has at least the postings of the text's trigrams. Names that have all of these are
    candidates, looked up by id, and then tested; so postings of older names do no harm. A text
    without trigrams is searched for in all names.
    """
    wanted = grams_of(text)
    tested = contains_ci(name, text)
    if not wanted:
        return entities.where(tested)
    held = found.where((F.col("kind") == kind) & F.col("gram").isin(wanted))
    counted = held.groupBy("id").agg(F.count_distinct("gram").alias("held"))
    candidates = counted.where(F.col("held") == len(wanted)).select("id")
    return entities.join(candidates, "id", "left_semi").where(tested)
