"""Conversions of stored values on reading, as Spark expressions.

A value that can't be converted raises an error that names the column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_GUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_SPAN = r"^(-)?(?:(\d+)\.)?(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,7})?))?$"


def _or_error(good: Column, made: Column, name: str, value: Column, type: str) -> Column:
    said = F.concat(F.lit(f"{name} can't be read as {type}: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(value.isNull() | good, made).otherwise(F.raise_error(said))


def to_guid(c: Column, name: str = "value") -> Column:
    """Lower-case canonical text; braces are dropped."""
    text = F.lower(F.regexp_replace(F.trim(c), r"^\{|\}$", ""))
    return _or_error(text.rlike(_GUID), text, name, c, "guid")


def to_date(c: Column) -> Column:
    return c.cast("date")


def to_time(c: Column) -> Column:
    """Time of day as HH:mm:ss.ffffff, from a timestamp or text."""
    return F.date_format(c.cast("timestamp_ntz"), "HH:mm:ss.SSSSSS")


def date_to_timestamp(c: Column) -> Column:
    """Midnight of a date."""
    return c.cast("timestamp_ntz")


def time_to_interval(c: Column) -> Column:
    """Time of day as text to an interval."""
    return text_to_interval(c)


def time_to_timestamp(c: Column) -> Column:
    """Time of day on the first day of year one."""
    return F.concat(F.lit("0001-01-01 "), c).cast("timestamp_ntz")


def text_to_interval(c: Column, name: str = "value") -> Column:
    """[-][d.]hh:mm[:ss[.fffffff]] to a day-time interval."""
    part = lambda n: F.coalesce(F.nullif(F.regexp_extract(c, _SPAN, n), F.lit("")), F.lit("0"))
    made = F.make_dt_interval(part(2).cast("int"), part(3).cast("int"), part(4).cast("int"), part(5).cast("decimal(18,6)"))
    signed = F.when(F.regexp_extract(c, _SPAN, 1) == "-", -made).otherwise(made)
    return _or_error(c.rlike(_SPAN), signed, name, c, "time span")


def time_of_day(c: Column) -> Column:
    """The interval since midnight."""
    return c - F.date_trunc("day", c).cast("timestamp_ntz")


def to_text(c: Column, type: str) -> Column:
    """Text that reads back to the same value, whatever the locale."""
    patterns = {"date": "yyyy-MM-dd", "timestamp_ntz": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestamp": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return F.date_format(c, patterns[type]) if type in patterns else c.cast("string")


def to_enum(c: Column, members: Mapping[str, int], name: str = "value") -> Column:
    """Name or number, case ignored, to the member's name; others raise."""
    pairs = [(k.upper(), k) for k in members] + [(str(v), k) for k, v in members.items()]
    table = F.create_map(*[F.lit(x) for pair in dict(pairs).items() for x in pair])
    key = F.upper(F.trim(c.cast("string")))
    return _or_error(F.map_contains_key(table, key), F.try_element_at(table, key), name, c, "enum")


def to_whole(c: Column, type: str = "int") -> Column:
    """To an integer type; halves go to the even neighbour, overflow raises."""
    return F.bround(c).cast(type)


def to_type(c: Column, type: str, name: str = "value") -> Column:
    """General conversion; failure names the column."""
    made = c.try_cast(type)
    return _or_error(made.isNotNull(), made, name, c, type)
