"""Columns that never throw: values of JSON text, names and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(column: str | Column, path: str) -> Column:
    return F.get_json_object(column, f"$.{path}")


def json_long(column: str | Column, path: str) -> Column:
    """Malformed and missing numbers are null."""
    return json_text(column, path).try_cast("bigint")


def json_bool(column: str | Column, path: str) -> Column:
    return json_text(column, path).try_cast("boolean")


def json_time(column: str | Column, path: str) -> Column:
    return json_text(column, path).try_cast("timestamp")


def owner_of(name: str | Column) -> Column:
    """What stands before the first slash."""
    return F.split_part(F.col(name) if isinstance(name, str) else name, F.lit("/"), F.lit(1))


def week_of(time: str | Column) -> Column:
    """The Monday of a time's or date's week."""
    return F.date_trunc("week", time).cast("date")


def monday_of(date: str) -> Column:
    """The same from the day of the week, for checks that don't share a formula with what they check."""
    return F.date_sub(F.col(date), F.pmod(F.dayofweek(date) + 5, F.lit(7)))


def hour_key(time: str | Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd-HH")


def micros_text(time: str | Column) -> Column:
    """UTC text with six digits of the second, in a session whose time zone is UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def hash_sample(key: str, parts: int) -> Column:
    """Whether a key falls to the first of so many equal parts."""
    return F.pmod(F.xxhash64(key), F.lit(parts)) == 0
