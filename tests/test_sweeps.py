"""Sweeps of two venues: restarts, saved matches, incomplete sweeps, failures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hedgeline.sources import catalogue
from hedgeline.sources.buckets import BucketedTable
from hedgeline.streaming import sweeps

pytestmark = pytest.mark.usefixtures("many_small_jobs")
COLUMNS = "ticker string, venue string, price double, volume double, yes_ask double, no_ask double, yes_bid double, close_time timestamp, liquidity double, book_depth double, open_interest double"


def rows(spark, venue, **prices):
    return spark.createDataFrame([(t, venue, p, 10.0, 0.5, 0.5, 0.4, None, None, None, None) for t, p in prices.items()], COLUMNS)


def at(day: int):
    return F.lit(dt.datetime(2024, 1, day, tzinfo=dt.UTC))


def nothing(spark):
    return spark.createDataFrame([], "id bigint")


def prices(spark, root, venue):
    return {r["ticker"]: r["price"] for r in sweeps.state_of(spark, root, venue).collect()}


def test_sweeps_of_two_venues(spark, tmp_path):
    root = str(tmp_path)
    assert sweeps.apply_sweep(spark, root, "a", rows(spark, "a", x=0.1, y=0.2), at(1), True, nothing(spark)) == {"kept": 2, "pruned": 0}
    sweeps.apply_sweep(spark, root, "b", rows(spark, "b", x=0.7, z=0.8), at(2), True, nothing(spark))
    assert prices(spark, root, "a") == {"x": 0.1, "y": 0.2} and prices(spark, root, "b") == {"x": 0.7, "z": 0.8}
    # An incomplete sweep prunes nothing, an empty one neither, a complete one what it lacks.
    assert sweeps.apply_sweep(spark, root, "a", rows(spark, "a", x=0.1), at(3), False, nothing(spark))["pruned"] == 0
    assert sweeps.apply_sweep(spark, root, "a", rows(spark, "a", x=0.1).limit(0), at(4), True, nothing(spark)) == {"kept": 0, "pruned": 0}
    ids = sweeps.state_of(spark, root, "a").where("ticker = 'y'").select("id")
    assert sweeps.apply_sweep(spark, root, "a", rows(spark, "a", x=0.3), at(5), True, ids)["pruned"] == 0
    assert sweeps.apply_sweep(spark, root, "a", rows(spark, "a", x=0.3), at(6), True, nothing(spark))["pruned"] == 1
    assert prices(spark, root, "a") == {"x": 0.3} and prices(spark, root, "b") == {"x": 0.7, "z": 0.8}
    history = sorted((r["ticker"], r["price"], r["recorded_at"].day) for r in sweeps.history_of(spark, root, "a").collect())
    assert history == [("x", 0.1, 1), ("x", 0.3, 5), ("y", 0.2, 1)]
    (state,) = sweeps.state_of(spark, root, "a").collect()
    assert (state["created_at"].day, state["updated_at"].day) == (1, 6)


def test_the_first_of_a_ticker_counts_and_bad_rows_are_told(spark, tmp_path):
    twice = rows(spark, "a", x=0.1).union(rows(spark, "a", x=0.9)).union(rows(spark, "a", y=0.5).withColumn("volume", F.lit(0.0))).coalesce(1)
    assert sweeps.apply_sweep(spark, str(tmp_path), "a", twice, at(1), True, nothing(spark)) == {"kept": 1, "rejected_no_activity": 1, "pruned": 0}
    assert prices(spark, str(tmp_path), "a") == {"x": 0.1}


def test_a_rejected_first_row_keeps_its_ticker_out_where_pages_move(spark, tmp_path):
    """Venue a's repeats go before rows are judged; venue b's rows are all judged."""
    for venue, kept in (("a", {}), ("b", {"x": 0.9})):
        twice = rows(spark, venue, x=0.1).withColumn("volume", F.lit(0.0)).union(rows(spark, venue, x=0.9)).coalesce(1)
        counts = sweeps.apply_sweep(spark, str(tmp_path), venue, twice, at(1), True, nothing(spark))
        assert counts == {"kept": len(kept), "rejected_no_activity": 1, "pruned": 0} and prices(spark, str(tmp_path), venue) == kept


def test_nothing_of_a_sweep_that_stops_is_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    history = lambda: sorted((r["ticker"], r["price"]) for r in sweeps.history_of(spark, root, "a").collect())
    sweeps.apply_sweep(spark, root, "a", rows(spark, "a", x=0.1), at(1), True, nothing(spark))
    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("full")))
        with pytest.raises(OSError, match="full"):
            sweeps.apply_sweep(spark, root, "a", rows(spark, "a", x=0.7, y=0.2), at(2), True, nothing(spark))
    assert prices(spark, root, "a") == {"x": 0.1} and history() == [("x", 0.1)]
    sweeps.apply_sweep(spark, root, "a", rows(spark, "a", x=0.4), at(3), True, nothing(spark))
    assert prices(spark, root, "a") == {"x": 0.4} and history() == [("x", 0.1), ("x", 0.4)]


def test_a_small_sweep_writes_little_and_leaves_what_a_rewrite_would(spark, tmp_path):
    n, root = 60_000, str(tmp_path)
    whole = lambda ids, price: spark.range(*ids).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("ticker"), F.lit("a").alias("venue"), F.lit(price).alias("price"), F.lit(10.0).alias("volume"), F.concat(*(F.sha2(F.concat(F.lit(f"{i}"), F.col("id").cast("string")), 512) for i in range(4))).alias("title"), F.lit(0.5).alias("yes_ask"), F.lit(0.5).alias("no_ask"), F.lit(0.4).alias("yes_bid"), *(F.lit(None).cast(k).alias(c) for c, k in (("close_time", "timestamp"), ("liquidity", "double"), ("book_depth", "double"), ("open_interest", "double"))))
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "venue=a/state").rglob("*.parquet"))
    sweeps.apply_sweep(spark, root, "a", whole((0, n), 0.1), at(1), True, nothing(spark))
    full = size()
    before = sweeps.state_of(spark, root, "a").select("ticker", "id", "price", "created_at").where("ticker <> 't7'").agg(F.sum("id"), F.count("*")).first()
    sweeps.apply_sweep(spark, root, "a", whole((0, n // 100), 0.2).drop("title"), at(2), False, nothing(spark))
    assert size() - full < 0.05 * full
    now = sweeps.state_of(spark, root, "a")
    assert now.where("ticker <> 't7'").agg(F.sum("id"), F.count("*")).first() == before
    assert {r["price"]: r["count"] for r in now.groupBy("price").count().collect()} == {0.1: n - n // 100, 0.2: n // 100}
    assert now.where("title IS NULL").count() == 0  # what the sweep doesn't know stays
    table = sweeps.state_table(spark, root, "a")
    rewritten = now.exceptAll(now.limit(0)).collect()
    table.compact(every=True)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, rewritten)) and not sum(table.manifest().delta_rows)


class Pages:
    """A catalogue that counts how often a page is fetched, in a file, as pages are fetched in a process of Spark's."""

    ROWS = {None: (["x=0.1", "y=0.2"], "p1"), "p1": (["z=0.3"], "p2"), "p2": (["x=0.9", "v=0.5"], None)}


def fetched(log):
    return log.read_text().split() if log.exists() else []


def fetch_pages(options):
    def fetch(cursor):
        with open(options["log"], "a") as out:
            out.write(f"{cursor}\n")
        return Pages.ROWS[cursor]

    return fetch


def from_lines(raw, now):
    part = lambda i: F.split("row", "=")[i]
    lit = lambda v: F.lit(v).cast("double")
    return raw.select(part(0).alias("ticker"), F.lit("a").alias("venue"), part(1).cast("double").alias("price"), lit(10).alias("volume"), lit(0.5).alias("yes_ask"), lit(0.5).alias("no_ask"), lit(0.4).alias("yes_bid"), F.lit(None).cast("timestamp").alias("close_time"), *(lit(None).alias(c) for c in ("liquidity", "book_depth", "open_interest")))


def test_a_catalogue_streams_page_by_page_and_fetches_none_twice(spark, tmp_path, monkeypatch):
    log, root, status = tmp_path / "log", str(tmp_path / "root"), sweeps.Status()
    days = iter(range(1, 30))

    def run(**options):
        clock = lambda: dt.datetime(2024, 1, next(days), tzinfo=dt.UTC)
        sweeps.catalogue_stream(spark, root, "a", "tests.test_sweeps:fetch_pages", from_lines, nothing, clock, status, log=log, **options).awaitTermination()

    run(pages_per_batch=1)
    run(pages_per_batch=1)
    assert fetched(log) == ["None", "p1"] and status.sweeps == 0 and not sweeps.state_table(spark, root, "a").manifest().version
    run(pages_per_batch=1)
    assert fetched(log) == ["None", "p1", "p2"] and prices(spark, root, "a") == {"x": 0.1, "y": 0.2, "z": 0.3, "v": 0.5}
    run()  # a whole sweep at once
    assert len(fetched(log)) == 6 and status.sweeps == 2
    # cut short by the page cap: z and v aren't there, and nothing is pruned
    run(max_pages=1)
    assert len(fetched(log)) == 7 and status.sweeps == 3 and status.counts == {"kept": 2, "pruned": 0} and len(prices(spark, root, "a")) == 4
    # a batch that is planned but not done reads its pages again from where they landed
    monkeypatch.setattr(sweeps, "apply_sweep", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(Exception, match="gone"):
        run()
    monkeypatch.undo()
    assert len(fetched(log)) == 10
    run(max_pages=1)
    assert fetched(log)[:10] == ["None", "p1", "p2"] * 2 + ["None"] + ["None", "p1", "p2"] and len(fetched(log)) <= 11 and status.sweeps >= 4


def test_landed_sweeps_are_read_as_tables(spark, tmp_path):
    catalogue.register(spark)
    read = lambda **more: sorted(map(tuple, spark.read.format(catalogue.NAME).options(landing=str(tmp_path / "landing"), fetcher="tests.test_sweeps:fetch_pages", log=str(tmp_path / "log"), **more).load().select("sweep", "page", "place", "last", "complete", "row").collect()))
    expected = [(1, 0, 0, False, False, "x=0.1"), (1, 0, 1, False, False, "y=0.2"), (1, 1, 0, False, False, "z=0.3"), (1, 2, 0, True, True, "x=0.9"), (1, 2, 1, True, True, "v=0.5")]
    assert read() == expected and read(sweep="1") == expected
    landing = catalogue.Landing(str(tmp_path / "empty"))
    assert catalogue.next_page(landing, lambda cursor: ([], "more"), 5) and list(landing.rows(landing.pages()[0])) == [(1, 0, 0, True, True, None)]


def test_a_stream_goes_on_after_a_restart_and_keeps_good_numbers(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    days, status = iter(range(1, 20)), sweeps.Status()

    def run(checkpoint, normalise=lambda raw, now: raw):
        source = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(landing)
        clock = lambda: dt.datetime(2024, 1, next(days), tzinfo=dt.UTC)
        sweeps.sweep_stream(source, root, "a", normalise, str(tmp_path / checkpoint), nothing, clock=clock, status=status).awaitTermination()

    rows(spark, "a", x=0.1, y=0.2).coalesce(1).write.parquet(landing)
    run("one")
    rows(spark, "a", x=0.4).coalesce(1).write.mode("append").parquet(landing)
    run("one")
    assert prices(spark, root, "a") == {"x": 0.4} and status.sweeps == 2
    run("new")  # all files again, under a new checkpoint: versions go on
    assert status.sweeps == 4 and prices(spark, root, "a") in ({"x": 0.4}, {"x": 0.1, "y": 0.2})
    good = dict(status.counts)
    with pytest.raises(Exception, match="boom"):
        run("bad", lambda raw, now: raw.select(F.raise_error(F.lit("boom")).alias("venue")))
    assert status.counts == good and "boom" in status.error


def test_venues_are_turned_on_and_off(spark):
    class Query:
        isActive = True

        def stop(self):
            self.isActive = False

    started = []
    ingestion = sweeps.Ingestion({"a": lambda status: started.append(status) or Query(), "b": lambda status: Query()})
    ingestion.turn("a", True)
    ingestion.turn("a", True)
    assert len(started) == 1 and ingestion.status()["a"]["running"] and not ingestion.status()["b"]["running"]
    ingestion.turn("a", False)
    assert not ingestion.status()["a"]["running"]


def test_price_changes_across_ranges(spark):
    prices = [1.0, 1.0, None, None, 2.0, 2.0, 1.0, 1.0, 1.0]
    ticks = spark.createDataFrame([("hot", i, p) for i, p in enumerate(prices)] + [("new", 4, None), ("late", 8, 3.0)], sweeps.TICK)
    known = spark.createDataFrame([("hot", 1.0), ("gone", 9.0)], "ticker string, price double")
    for ranges in (1, 3, 9):
        changes, lasts = sweeps.ranged_changes(ticks, known, ranges)
        assert {tuple(r) for r in changes.collect()} == {("hot", 2, None), ("hot", 4, 2.0), ("hot", 6, 1.0), ("new", 4, None), ("late", 8, 3.0)}
        assert {tuple(r) for r in lasts.collect()} == {("hot", 1.0), ("gone", 9.0), ("new", None), ("late", 3.0)}
    nothing = sweeps.ranged_changes(ticks.limit(0), known, 3)
    assert nothing[0].count() == 0 and nothing[1].count() == 2


def test_a_stream_of_nothing_has_no_changes(spark):
    assert sweeps.stream_price_changes(spark, spark.createDataFrame([], sweeps.TICK)).count() == 0
