"""Formatting of numbers and times for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price presets, both ends inclusive.
PRICE_BANDS = {"longshot": (None, 0.1), "contested": (0.1, 0.9), "favourite": (0.9, None)}


def one_decimal(v: Column) -> Column:
    """Rounded by the exact binary value, ties away from zero: 5.85, which is a little less, is 5.8; 5.25 is 5.3."""
    tie = F.abs(v * 4) % 2 == 1  # quarters are the only ties that a double can hold
    return F.replace(F.format_number(v + F.when(tie, F.signum(v) * 1e-9).otherwise(0.0), 1), F.lit(","), F.lit(""))


def compact(v: Column) -> Column:
    """1234 is 1.2k, 5600000 is 5.6M."""
    unit = lambda size, mark: F.concat(one_decimal(v / size), F.lit(mark))
    return F.when(v >= 1e9, unit(1e9, "B")).when(v >= 1e6, unit(1e6, "M")).when(v >= 1e3, unit(1e3, "k")).otherwise(F.format_string("%d", F.floor(v + 0.5)))


def cents(price: Column) -> Column:
    return F.when(price.isNull(), "—").otherwise(F.concat(one_decimal(price * 100), F.lit("¢")))


def closes_in(close_time: Column, as_of: Column) -> Column:
    hours = (F.unix_micros(close_time) - F.unix_micros(as_of)) / 3.6e9
    return (
        F.when(close_time.isNull(), "—")
        .when(hours < 0, "closed")
        .when(hours < 24, F.format_string("%dh", F.greatest(F.lit(1), F.floor(hours + 0.5))))
        .when(hours < 24 * 60, F.format_string("%dd", F.floor(hours / 24 + 0.5)))
        .otherwise(F.date_format(close_time, "yyyy-MM-dd"))
    )


def ago(seconds: Column) -> Column:
    s = F.floor(seconds + 0.5)
    return F.when(s < 60, F.format_string("%ds ago", s)).otherwise(F.format_string("%dm ago", F.floor(s / 60 + 0.5)))


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.9, "very high").when(x >= 0.7, "high").when(x >= 0.4, "medium").otherwise("low")


def nice_max(v: Column) -> Column:
    """The next 1, 2, 5 or 10 times a power of ten; 1 for what isn't positive."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    n = v / size
    return F.when(v <= 0, 1.0).otherwise(F.when(n <= 1, 1).when(n <= 2, 2).when(n <= 5, 5).otherwise(10) * size)
