"""Small column helpers shared by both planes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from planewatch import constants as K
from planewatch.schemas import CORRUPT


def blank_to_null(col: Column) -> Column:
    """An empty string in an optional scalar means the source did not say."""
    return F.nullif(col, F.lit(""))


def first_given(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def utc_time(text: Column, naive_is_utc: bool = False) -> Column:
    """RFC 3339 text to a timestamp, anything else to NULL.

    The shape is tested first because a cast alone also takes bare dates and blanks between
    date and time. Text without a zone gets an explicit ``Z``, so the session zone is never used.
    """
    zoned = F.when(text.rlike(K.ZONED_TIME), text)
    if naive_is_utc:
        zoned = zoned.when(text.rlike(K.NAIVE_TIME), F.concat(text, F.lit("Z")))
    return zoned.try_cast("timestamp")


def text_of(variant: Column) -> Column:
    """The string a VARIANT holds, NULL for JSON null, a missing value or any other type."""
    return F.when(F.schema_of_variant(variant) == "STRING", variant.cast("string"))


def is_text_or_absent(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant), F.lit("VOID")).isin("STRING", "VOID")


def decode_part(raw: Column, schema: str) -> Column:
    """Decode a JSON value strictly: one member of a wrong type and `CORRUPT` is set.

    The value is wrapped in an object. Only objects report bad fields, and text after the end of
    the value breaks the wrapper, where `from_json` alone would stop reading and not notice.
    """
    return F.from_json(
        F.concat(F.lit('{"v":'), raw, F.lit("}")), schema, {"columnNameOfCorruptRecord": CORRUPT}
    )


def lookup(table: dict[str, str], key: Column) -> Column:
    """Constant table lookup as an expression: no join, no shuffle, NULL when missing."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def non_empty(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def struct_or_null(*cols: Column) -> Column:
    """A group of fields that is absent when all of its members are."""
    present = cols[0].isNotNull()
    for c in cols[1:]:
        present = present | c.isNotNull()
    return F.when(present, F.struct(*cols))
