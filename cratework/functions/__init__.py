"""Column functions; every one is a built-in expression, so no Python runs per row."""

from cratework.functions.dates import dump_date, effective_year, iso_timestamp, partial_date
from cratework.functions.documents import json_list, json_structs, is_valid_json, reference_id
from cratework.functions.durations import duration_seconds, duration_text
from cratework.functions.text import (
    ascii_lower,
    clean_text,
    contains_ci,
    leading_int,
    like_ci,
    safe_int,
    safe_long,
    strip,
)

__all__ = [
    "ascii_lower",
    "clean_text",
    "contains_ci",
    "dump_date",
    "duration_seconds",
    "duration_text",
    "effective_year",
    "is_valid_json",
    "iso_timestamp",
    "json_list",
    "json_structs",
    "leading_int",
    "like_ci",
    "partial_date",
    "reference_id",
    "safe_int",
    "safe_long",
    "strip",
]
