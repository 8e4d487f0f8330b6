"""Track durations between text and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratework.functions.text import strip

# S+, M+:SS or H+:MM:SS; SS and MM are not range-checked.
SHAPE = r"^[0-9]+(?::[0-9]{2}){0,2}$"


def _parse(text: Column) -> Column:
    """Each part counts sixty of the next; a number too large for a long gives NULL."""
    seconds = F.aggregate(
        F.split(text, ":"),
        F.lit(0).cast("bigint"),
        lambda total, part: F.try_add(
            F.try_multiply(total, F.lit(60)), part.try_cast("bigint")
        ),
    )
    return F.when(text.rlike(SHAPE), seconds).try_cast("int")


def duration_seconds(value: Column | str) -> Column:
    """``3:45`` -> 225, ``1:02:03`` -> 3723, ``45`` -> 45; anything else is NULL.

    White space around the text is ignored. The text is stripped once: as the
    element of a list it is a variable of what is computed from it.
    """
    text = F.col(value) if isinstance(value, str) else value
    return F.get(F.transform(F.array(strip(text)), _parse), F.lit(0))


def duration_text(value: Column | str) -> Column:
    """Seconds as ``M:SS`` or ``H:MM:SS``; NULL for NULL or negative."""
    seconds = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    hours = F.floor(seconds / 3600)
    minutes = F.floor(seconds % 3600 / 60)
    rest = seconds % 60
    return F.when(
        seconds >= 0,
        F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
            F.format_string("%d:%02d", minutes, rest)
        ),
    )
