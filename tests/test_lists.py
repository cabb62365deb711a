"""Deep pages and trigram searches against plain ones."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hedgeline.operators import listing, paging, trigrams

NOW = dt.datetime(2024, 1, 15, tzinfo=dt.UTC)


@pytest.fixture(scope="module")
def many(spark):
    """50,000 rows; a third has one volume, a tenth none."""
    rng = F.rand(5)
    volume = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.round(rng * 1000, 2))
    df = spark.range(50_000).select("id", volume.alias("volume"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp").alias("_"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 977).alias("close_time"), (F.col("id") % 100 / 100).alias("price"), F.lit(0.6).alias("yes_ask"), F.lit(0.5).alias("yes_bid"))
    return df.cache()


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("sort", ["volume", "close_time", "spread"])
def test_deep_pages_hold_the_same_rows(spark, many, sort, ascending, monkeypatch):
    q = lambda offset: listing.ListQuery(sort=sort, ascending=ascending, limit=40, offset=offset)
    plain = {offset: [(r["id"], r["total_count"]) for r in listing.page(many, q(offset), F.lit(NOW)).collect()] for offset in (0, 20_000, 44_990, 49_980, 60_000)}
    monkeypatch.setattr(listing, "DEEP", 0)
    monkeypatch.setattr(paging, "slice_of", lambda *a, **k: bounded(*a, **k))
    original, sorted_rows = SLICE, []

    def bounded(rows, key, tie, limit, offset):
        part = original(rows, key, tie, limit, offset, pieces=40, most=2_500)
        sorted_rows.append(part.rows.count())
        return part

    for offset, expected in plain.items():
        assert [(r["id"], r["total_count"]) for r in listing.page(many, q(offset), F.lit(NOW)).collect()] == expected, offset
    assert max(sorted_rows) <= 2_500 and sorted_rows[-1] == 0


SLICE = paging.slice_of


def test_pages_of_few_or_no_rows(spark, many):
    part = paging.slice_of(many.limit(3), F.col("volume"), "id", 2, 2, pieces=4, most=1)
    assert part.total == 3 and part.rows.count() >= 1 and part.before <= 2
    assert paging.slice_of(many.where("id < 0"), F.col("volume"), "id", 2, 0).total == 0


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé_%") for _ in range(rng.randint(1, 6)))
    rows = [(i, f"T-{i}", " ".join(word() for _ in range(rng.randint(0, 5))).title() or None, word() if i % 3 else None, float(i), None) for i in range(600)]
    rows += [(1000, "abc\\d", "100%_sure", "ΟΔΟΣ ΟΔΟΣΑ", 1.0, None)]
    markets = spark.createDataFrame(rows, "id bigint, ticker string, title string, event_title string, volume double, close_time timestamp")
    table = trigrams.posting_table(spark, str(tmp_path_factory.mktemp("grams")), buckets=8)
    table.write(trigrams.postings(markets))
    return markets, table


@pytest.mark.parametrize("search", ["abc", "ABC", "ab", "é", "a_c", "a%c", "abca_b", "%%%", "___", "T-10", "T-1_", r"0\%\_s", r"abc\\d", "ΟΔΟΣ", "οδοσ", "nothing like it", "cab%abc", "bca cab"])
def test_searches_find_the_same_rows(searched, search):
    markets, table = searched
    plain = lambda rows: {r["id"] for r in listing.matching(rows, listing.ListQuery(search=search), F.lit(NOW)).collect()}
    assert plain(trigrams.like(markets, table, search)) == plain(markets)
    ahead = lambda rows: [r["id"] for r in listing.typeahead(rows, search, F.lit(NOW), 1000).collect()]
    assert ahead(trigrams.holding(markets, table, search)) == ahead(markets)


def test_few_rows_are_looked_at(searched):
    markets, table = searched
    near = trigrams.like(markets, table, "T-10")
    assert 0 < near.count() < markets.count() / 4
    assert trigrams.pieces(r"a%b_c\%d\\") == ["a", "b", "c%d\\"] and trigrams.sought(["ab"]) == [] and len(trigrams.sought(["abcdefghijklmnop"])) == trigrams.LOOKED_UP
    # rows that come later are found once their postings are there
    table.write(trigrams.postings(markets.limit(1).select(F.lit(5000).cast("bigint").alias("id"), F.lit("zebra").alias("title"), "event_title", F.lit("z").alias("ticker"))))
    assert [r["id"] for r in trigrams.like(markets.limit(1).select(F.lit(5000).cast("bigint").alias("id")), table, "zebr").collect()] == [5000]
