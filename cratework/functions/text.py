"""Text cleaning, lenient numbers and ASCII case-insensitive matching."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space around a value.
ASCII_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
OTHER_SPACE = (
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_ascii(value: Column | str) -> Column:
    return F.octet_length(_col(value)) == F.char_length(_col(value))


def strip(value: Column | str) -> Column:
    """Text without surrounding white space of any kind.

    ASCII text, the common case, is only searched for the ASCII kinds.
    """
    text = _col(value)
    return F.when(is_ascii(text), F.btrim(text, F.lit(ASCII_SPACE))).otherwise(
        F.btrim(text, F.lit(ASCII_SPACE + OTHER_SPACE))
    )


def clean_text(value: Column | str) -> Column:
    """Stripped text, with the empty string as NULL."""
    return F.nullif(strip(value), F.lit(""))


def safe_long(value: Column | str) -> Column:
    """Whole number from text, NULL when it is not one."""
    return _whole_number(value, "bigint")


def safe_int(value: Column | str) -> Column:
    return _whole_number(value, "int")


def _whole_number(value: Column | str, kind: str) -> Column:
    """The cast skips plain white space itself; other kinds are stripped on a second try."""
    text = _col(value)
    return F.coalesce(text.try_cast(kind), strip(text).try_cast(kind))


def leading_int(value: Column | str) -> Column:
    """Cast of loose text to a number: its leading digits, 0 without any, NULL for NULL."""
    text = _col(value).cast("string")
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")
    return F.when(text.isNotNull(), F.coalesce(digits, F.lit(0).cast("bigint")))


def ascii_lower(value: Column | str) -> Column:
    """Lower case for A to Z only; other letters keep their case."""
    return F.translate(_col(value), string.ascii_uppercase, string.ascii_lowercase)


def like_ci(value: Column | str, pattern: str) -> Column:
    """LIKE without ASCII case. ``%`` and ``_`` are wildcards; a backslash is itself."""
    folded = pattern.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return ascii_lower(value).like(folded.replace("\\", "\\\\"))


def contains_ci(value: Column | str, text: str) -> Column:
    """Case-insensitive contains. Wildcards in ``text`` stay wildcards."""
    return like_ci(value, f"%{text}%")
