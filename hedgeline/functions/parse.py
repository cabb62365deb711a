"""Defensive parsing of what venues and judges send."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number at the start, as a lenient parser reads it: '1.5x' is 1.5.
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def number(value: Column) -> Column:
    """Double of the leading number; null if there is none or it isn't finite."""
    x = F.nullif(F.regexp_extract(value.cast("string"), LEADING_NUMBER, 1), F.lit("")).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def strings(value: Column) -> Column:
    """Elements of a JSON array as strings; anything else is the empty array."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def inside_unit(x: Column) -> Column:
    """x if it lies strictly between 0 and 1."""
    return F.when((x > 0) & (x < 1), x)


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def object_in(text: Column) -> Column:
    """From the first brace to the last one; null if there is no such stretch."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return blank_to_null(found)


def leading_whole(value) -> int | None:
    """The whole number that a request parameter begins with: 50 of `50abc` and of `50.9`; None if there is none."""
    found = re.match(r"\s*([+-]?\d+)", str(value))
    return int(found[1]) if found else None
