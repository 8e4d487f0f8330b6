"""Document columns: typed arrays, or raw JSON text from the landing zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cratework.functions.text import safe_long


def is_valid_json(value: Column | str) -> Column:
    return F.try_parse_json(value).isNotNull()


def json_list(value: Column | str) -> Column:
    """Elements of JSON text as strings; invalid JSON gives NULL.

    An array gives its elements, an object its values, a scalar itself.
    """
    text = F.col(value) if isinstance(value, str) else value
    parsed = F.try_parse_json(text)
    return F.coalesce(
        F.from_json(text, "array<string>"),
        F.map_values(F.try_variant_get(parsed, "$", "map<string,string>")),
        F.when(parsed.isNotNull(), F.array(F.try_variant_get(parsed, "$", "string"))),
    )


def json_structs(value: Column | str, element: str) -> Column:
    """JSON array text as an array of ``element`` structs; invalid JSON gives NULL."""
    text = F.col(value) if isinstance(value, str) else value
    return F.from_json(text, f"array<{element}>")


def list_column(df: DataFrame, name: str) -> Column:
    """A list of strings, whether the column is typed or JSON text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return json_list(name)
    return F.col(name)


def struct_list_column(df: DataFrame, name: str, element: str) -> Column:
    """A list of structs, whether the column is typed or JSON text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return json_structs(name, element)
    return F.col(name)


def reference_id(value: Column | str) -> Column:
    """Numeric id from text that holds a number or an object with ``text`` or ``value``.

    0 and text that is no number give NULL.
    """
    text = F.col(value) if isinstance(value, str) else value
    nested = F.coalesce(
        F.nullif(F.get_json_object(text, "$.text"), F.lit("")),
        F.get_json_object(text, "$.value"),
    )
    number = F.when(text.startswith("{"), safe_long(nested)).otherwise(safe_long(text))
    return F.nullif(number, F.lit(0).cast("bigint"))
