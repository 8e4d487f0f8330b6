"""Partial dates, timestamps, dump dates and the effective year of a release."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratework.functions.text import strip

def partial_date(value: Column | str) -> Column:
    """Date of ``Y-m-d``, ``Y-m`` or ``Y``; missing parts are 1, bad dates are NULL.

    Missing parts are appended, so that each text is parsed once.
    """
    text = strip(value)
    missing = 2 - F.regexp_count(text, F.lit("-"))
    whole = F.concat(text, F.repeat(F.lit("-1"), missing))
    return F.when(~text.startswith("0000"), F.try_to_date(whole, "yyyy-M-d"))


def iso_timestamp(value: Column | str) -> Column:
    """Timestamp of ISO text with an offset or ``Z``; NULL when unreadable."""
    return F.try_to_timestamp(strip(value))


def dump_date(file_name: Column | str) -> Column:
    """Date in a dump file name such as ``catalogue_20250601_artists.xml.gz``."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.try_to_date(F.regexp_extract(name, r"^[^_]*_([0-9]{8})(?:_|\.|$)", 1), "yyyyMMdd")


def effective_year(
    release_year: Column | str, master_year: Column | str, cached_year: Column | str
) -> Column:
    """First known year: of the release date, of the master, of the cached item."""
    return F.coalesce(release_year, master_year, cached_year)
