"""Operators that no query exercises, on small hand-made inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hedgeline.functions import parse
from hedgeline.operators import consensus, listing, match, similarity, store, trace
from hedgeline.schemas import MARKET, MATCHED, STATE, VERDICT, conform
from hedgeline.sources import landing

NOW = dt.datetime(2024, 1, 15, tzinfo=dt.UTC)


def markets(spark, venue, *rows):
    """ticker, title, volume, yes_ask, no_ask, close day (or None)."""
    made = [(i, t, venue, title, v, y, n, None if d is None else dt.datetime(2024, 1, d, tzinfo=dt.UTC), 1000 + i) for i, (t, title, v, y, n, d) in enumerate(rows, 1)]
    df = spark.createDataFrame(made, "id bigint, ticker string, venue string, title string, volume double, yes_ask double, no_ask double, close_time timestamp, timestamp bigint")
    return conform(df, STATE).withColumn("updated_at", F.lit(NOW))


def side_a(spark):
    return markets(spark, "a", ("A1", "Fed cuts rates in March 2024", 50.0, 0.4, 0.61, None), ("A2", "Lakers win the title", 90.0, 0.3, 0.72, 30), ("A3", "closed one", 99.0, 0.3, 0.7, 1), ("A4", "no quote", 99.0, None, None, 30), ("A5", "no volume", 0.0, 0.5, 0.5, 30))


def side_b(spark):
    return markets(spark, "b", ("B1", "Fed cuts rates in March 2024", 40.0, 0.45, 0.5, None), ("B2", "Lakers win the title", 70.0, 0.35, 0.6, 30), ("B3", "Rain in Paris", 10.0, 0.5, 0.5, 30))


def vector(rows):
    return rows.withColumn("vector", similarity.hashed_vectors(F.col("text")))


@pytest.mark.parametrize(("given", "limit"), [("50abc", 50), ("0.5", 100), ("600", 500), ("-3", 1), ("", 100), ("x", 100), (None, 100), ("20.9", 20)])
def test_limits_are_read_as_far_as_they_are_numbers(given, limit):
    assert listing.ListQuery.parse({"limit": given} if given is not None else {}).limit == limit


def test_match_filters():
    f = match.MatchFilters.parse({"limit": "300x", "start": "inf", "stop": 0, "search": "", "a_ticker": "A1"})
    assert f == match.MatchFilters(a_ticker="A1", limit=300) and not f.pinned
    assert match.MatchFilters.parse({"a_ticker": "A1", "b_ticker": "B1"}).pinned


def test_numbers_and_arrays_of_catalogues(spark):
    df = spark.createDataFrame([("1.5x", '["Yes","No"]'), ("Infinity", "[broken"), ("", None), ("0.25", "[]")], "n string, a string")
    out = df.select(parse.number(F.col("n")).alias("n"), parse.strings(F.col("a")).alias("a")).collect()
    assert [r["n"] for r in out] == [1.5, None, None, 0.25] and out[0]["a"] == ["Yes", "No"]
    assert not out[1]["a"]


def test_reads(spark):
    a = side_a(spark)
    assert [r["ticker"] for r in listing.candidates(a, F.lit(NOW)).collect()] == ["A2", "A1"]
    assert [r["ticker"] for r in listing.candidates(a, F.lit(NOW), search="fed").collect()] == ["A1"]
    assert listing.count(a).first()["count"] == 5
    assert listing.by_id(a, 2).first()["ticker"] == "A2" and listing.by_ticker(a, "A2").count() == 1
    assert [r["ticker"] for r in listing.fetch(a, F.lit(NOW), start=1001, stop=1002).collect()] == ["A1", "A2"]
    assert [r["ticker"] for r in listing.fetch(a, F.lit(NOW), ticker="A3").collect()] == ["A3"]
    assert [r["ticker"] for r in listing.fetch(a, F.lit(NOW), limit=1).collect()] == ["A2"]


def test_the_best_agreement_comes_first(spark):
    rows = spark.createDataFrame([(1, 1, "same", 0.7, 0.9), (1, 2, "same", 1.0, 0.6), (2, 1, "same", 1.0, 0.8)], "a_idx int, b_idx int, direction string, score double, avg_confidence double")
    assert [(r["a_idx"], r["b_idx"]) for r in consensus.best_first(rows).collect()] == [(2, 1), (1, 2), (1, 1)]


def test_saved_matches(spark):
    empty, now = spark.createDataFrame([], MATCHED), F.lit(NOW)
    row = spark.createDataFrame([(7, 8, "t", "c", 0.9, 0.4, 0.5, 1.0, 2.0)], "a_id bigint, b_id bigint, common_title string, category string, confidence double, a_price double, b_price double, a_volume double, b_volume double")
    one = store.save_match(empty, conform(row, MATCHED).drop("id", "is_active", "last_sync_at"), now)
    two = store.save_match(one, conform(row, MATCHED).drop("id", "is_active", "last_sync_at").withColumn("a_id", F.lit(9).cast("bigint")), now)
    assert [(r["id"], r["is_active"]) for r in two.orderBy("id").collect()] == [(1, True), (2, True)]
    assert store.saved_page(two, 1, 1).first()["id"] == 2 and store.saved_pair(two, 9, 8).first()["id"] == 2
    changed = store.update_match(two, 2, {"is_active": False, "a_id": 1}, now)
    assert {r["id"]: (r["is_active"], r["a_id"]) for r in changed.collect()} == {1: (True, 7), 2: (False, 9)}
    assert store.update_match(two, 2, {"a_id": 1}, now) is None and store.update_match(two, 5, {"is_active": True}, now) is None
    assert [r["id"] for r in store.saved_active(store.generated(changed)).collect()] == [1]
    left, hit = store.delete_match(two, 1)
    assert hit and left.count() == 1 and not store.delete_match(two, 9)[1]
    ids = spark.createDataFrame([(8,), (9,)], "id bigint")
    assert [r["id"] for r in store.cascade(two, ids).collect()] == [2]


def test_verdicts(spark):
    rows = [("A1", "B1", True, "exact", "same", 0.9, "", NOW), ("A2", "B1", False, None, None, None, None, NOW)]
    known = spark.createDataFrame(rows, VERDICT)
    newer = spark.createDataFrame([("A1", "B1", False, None, None, None, None, NOW - dt.timedelta(days=1))], VERDICT)
    kept = {r["a_ticker"]: r["is_match"] for r in store.save_verdicts(known, newer).collect()}
    assert kept == {"A1": False, "A2": False}
    assert store.verdicts_of(known, spark.createDataFrame([("A2",)], "ticker string")).count() == 1
    assert store.clear_verdicts(known).count() == 0 and store.clear_verdicts(known).columns == known.columns


def test_migration_adds_what_is_missing(spark):
    out = conform(spark.createDataFrame([("x", 1)], "ticker string, gone int"), MARKET)
    assert out.columns[0] == "ticker" and "gone" not in out.columns and out.first()["rules"] is None


def test_sorted_pages_fall_back_to_plain_ones():
    def refused(cursor):
        raise ValueError("422")

    plain = {None: (["1", "2"], "c"), "c": (["3"], None)}
    fetch = landing.sorted_or_plain(refused, lambda cursor: plain[cursor])
    assert list(landing.sweep_pages(fetch)) == [(["1", "2"], False), (["3"], True)]
    assert list(landing.sweep_pages(lambda cursor: (["x"], "next"), max_pages=2)) == [(["x"], False), (["x"], False)]


def test_stages_batches_and_agents_of_a_trace(spark):
    schema = trace.EVENT.split(", mode")[0]
    rows = [(1, "stage", "judge", "start", None, {"n": 1}, None, None, None, None, None, None, None), (5, "stage", "judge", "done", None, {"n": 3, "m": 2}, None, None, None, None, None, None, None), (2, "batch", None, "failed", None, None, 1, None, None, None, 0, 4, "late")]
    events = conform(spark.createDataFrame(rows, schema), trace.EVENT)
    (stage,) = trace.stages(events).collect()
    assert (stage["status"], stage["started"], stage["ended"], stage["stats"]) == ("done", 1, 5, {"n": 3, "m": 2})
    (batch,) = trace.batches(events).collect()
    assert (batch["batch"], batch["status"], batch["pairs"], batch["error"]) == (1, "failed", 4, "late")


def test_vectors_of_texts(spark):
    rows = vector(spark.createDataFrame([(1, "rates cut in March"), (2, "rates cut in March"), (3, "")], "id bigint, text string")).collect()
    assert rows[0]["vector"] == rows[1]["vector"] and sum(x * x for x in rows[0]["vector"]) == pytest.approx(1)
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 0.5]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(similarity.dot(F.col("a"), F.col("b"))).collect()] == [4.0, 0.0]
    import numpy as np

    make = lambda: lambda texts: np.ones((len(texts), 2))
    known = spark.createDataFrame([("old", [5.0, 5.0])], "text string, vector array<float>")
    out = {r["text"]: r["vector"] for r in similarity.embed(spark.createDataFrame([("old",), ("new",), (None,)], "text string"), "text", make, known).collect()}
    assert out == {"old": [5.0, 5.0], "new": [1.0, 1.0]}


@pytest.mark.parametrize("partitions", ["1", "2", "7"])
def test_ids_are_whole_whatever_the_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(30_000).select(F.when(F.col("id") % 100 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("name"), F.col("id").alias("k")).repartition(5)
        found = store.with_ids(rows, "name", "k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["id"] for r in sorted(found, key=lambda r: (r["name"] is not None, r["name"] or "", r["k"]))] == list(range(1, 30_001))
    assert store.with_ids(rows.limit(0), "name").count() == 0
