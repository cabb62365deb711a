"""Pages deep in a sorted list, without sorting what lies before them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a pass counts, and how many rows may be left to be sorted.
PIECES, MOST = 128, 100_000


@dataclass(frozen=True)
class Slice:
    """rows: those of all that may be on the page; before: how many lie before them; total: how many there are at all."""

    rows: DataFrame
    before: int
    total: int


def sort_key(key: Column, ascending: bool, kind: str) -> Column:
    """A number that rises as the list goes on; null where the key is."""
    number = F.unix_micros(key) if kind == "timestamp" else key
    return number if ascending else -number


def counted(rows: DataFrame, value: Column, pieces: int) -> tuple[list, list[int], int]:
    """Ends of ranges of about as many rows each, how many rows lie in each (the last is open), and how many have no value."""
    ends = rows.agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 10 * pieces).alias("q")).first()["q"]
    ends = sorted(set(ends or []))
    place = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e < value)) if ends else F.when(value.isNotNull(), F.lit(0))
    found = {r["p"]: r["n"] for r in rows.groupBy(F.when(value.isNotNull(), place).alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    return ends, [found.get(i, 0) for i in range(len(ends) + 1)], found.get(None, 0)


def slice_of(rows: DataFrame, key: Column, tie: str, limit: int, offset: int, pieces: int = PIECES, most: int = MOST) -> Slice:
    """The rows among which a page lies, by counting ranges of the key and then, where one key has very many rows, of the tie-breaker.

    Nulls of the key come last. Each pass counts all rows that are left, and
    leaves the ranges that the page reaches into; it ends when at most `most` rows are, or nothing more can be told apart.
    """
    total = rows.count()
    if offset >= total:
        return Slice(rows.where(F.lit(False)), 0, total)
    found, before = narrowed(rows, [key, F.col(tie)], offset, min(offset + limit, total), pieces, most)
    return Slice(found, before, total)


def narrowed(rows: DataFrame, values: list[Column], start: int, stop: int, pieces: int, most: int) -> tuple[DataFrame, int]:
    """Rows that hold those from start to stop, in the order of the values, and how many lie before them."""
    value = values[0]
    ends, counts, nulls = counted(rows, value, pieces)
    sums = [0]
    for n in [*counts, nulls]:
        sums.append(sums[-1] + n)
    if sums[-1] <= most:
        return rows, 0
    first = next(i for i in range(len(sums) - 1) if sums[i + 1] > start)
    last = next(i for i in range(first, len(sums) - 1) if sums[i + 1] >= stop)
    left = sums[last + 1] - sums[first]
    if left <= 0.5 * sums[-1] or left <= most:
        part = rows.where(within(value, ends, first, last))
        found, before = (part, 0) if left <= most else narrowed(part, values, start - sums[first], stop - sums[first], pieces, most)
        return found, before + sums[first]
    # One value has a great part of the rows: what is less, equal, greater and null is taken for itself.
    heavy = max(range(first, last + 1), key=lambda i: sums[i + 1] - sums[i])
    split = F.lit(ends[heavy]) if heavy < len(ends) else F.lit(rows.agg(F.max(value).alias("v")).first()["v"])
    tests = [value < split, value == split, value > split, value.isNull()]
    sizes = rows.agg(*(F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests))).first()
    out, begins, at = None, 0, 0
    for i, test in enumerate(tests):
        size = sizes[f"n{i}"]
        if size and start < at + size and stop > at:
            inner = values[1:] if i in (1, 3) else values
            whole = size <= most or not inner or size == sums[-1] and inner == values
            part, before = (rows.where(test), 0) if whole else narrowed(rows.where(test), inner, max(0, start - at), min(size, stop - at), pieces, most)
            begins = at + before if out is None else begins
            out = part if out is None else out.unionByName(part)
        at += size
    return out, begins


def within(value: Column, ends: list, first: int, last: int) -> Column:
    """Whether a value lies in one of the ranges from first to last; behind the open range come nulls."""
    if first > len(ends):
        return value.isNull()
    above = value > ends[first - 1] if first else value.isNotNull()
    below = value <= ends[last] if last < len(ends) else F.lit(True)
    return above & below | value.isNull() if last > len(ends) else above & below
