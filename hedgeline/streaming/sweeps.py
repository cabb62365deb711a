"""Catalogue sweeps as Structured Streaming: change history and state, one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..config import DEFAULTS
from ..functions import quality
from ..operators import normalize, store
from ..operators.trace import observed
from ..schemas import HISTORY, MARKET, STATE, conform
from ..sources.buckets import BucketedTable
from ..sources.catalogue import NAME, register
from ..sources.landing import deleted, scratch_folder


TICK = "ticker string, event_id bigint, price double"


def cuts_of(ticks: DataFrame, ranges: int) -> Column:
    """Which of so many ranges of event_id a tick lies in, from 0; the ranges hold about as many ticks each."""
    found = ticks.agg(F.percentile_approx("event_id", [i / ranges for i in range(1, ranges)], max(1000, 20 * ranges)).alias("q")).first()["q"] if ranges > 1 else []
    return reduce(lambda so_far, q: so_far + (F.col("event_id") > q).cast("int"), sorted(set(found or [])), F.lit(0))


def ranged_changes(ticks: DataFrame, known: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """The ticks whose price isn't the one before, and each ticker's last price then; known holds the last prices so far.

    A ticker's ticks are compared range by range, and a range hands on only its last price, so
    that no task holds all ticks of a ticker.
    """
    own, across = Window.partitionBy("ticker", "_range").orderBy("event_id"), Window.partitionBy("ticker").orderBy("_range")
    rows = ticks.withColumn("_range", cuts_of(ticks, ranges))
    lasts = rows.groupBy("ticker", "_range").agg(F.max_by("price", "event_id").alias("price"))
    lasts = known.select("ticker", F.lit(-1).alias("_range"), "price").union(lasts.select("ticker", "_range", "price"))
    handed = lasts.select("ticker", "_range", F.lag("price").over(across).alias("_handed"), (F.row_number().over(across) == 1).alias("_new"))
    rows = rows.withColumn("_place", F.row_number().over(own)).withColumn("_before", F.lag("price").over(own)).join(handed, ["ticker", "_range"])
    before = F.when(F.col("_place") == 1, F.col("_handed")).otherwise(F.col("_before"))
    changes = rows.where((F.col("_place") == 1) & F.col("_new") | ~F.col("price").eqNullSafe(before))
    return changes.select("ticker", "event_id", "price"), lasts.groupBy("ticker").agg(F.max_by("price", "_range").alias("price"))


def price_change_stream(ticks: DataFrame, root: str, ranges: int = 16) -> StreamingQuery:
    """Append the change-only history of a stream of ticks (ticker, event_id, price) to root/history, a batch as it arrives.

    Batches come in the order of event_id. What a batch writes is named by its number and written over
    when it runs again, and it goes on from the last prices that the batch before wrote.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("ticker string, price double").parquet(f"{root}/last/v={number - 1}") if number else spark.createDataFrame([], "ticker string, price double")
        changes, lasts = ranged_changes(batch, known, ranges)
        changes.write.mode("overwrite").parquet(f"{root}/history/v={number}")
        lasts.write.mode("overwrite").parquet(f"{root}/last/v={number}")

    return ticks.writeStream.foreachBatch(save).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()


def stream_price_changes(spark: SparkSession, ticks: DataFrame, sweeps: int = 4) -> DataFrame:
    """Land the ticks sweep by sweep in their order, take in each as it has landed, and return the history that comes out."""
    base = scratch_folder(spark, "sweeps")
    ticks = ticks.select("ticker", "event_id", "price")
    ticks.withColumn("sweep", cuts_of(ticks, sweeps)).write.partitionBy("sweep").parquet(f"{base}/sorted")
    for sweep in range(sweeps):
        landed = spark.read.schema(f"{TICK}, sweep int").parquet(f"{base}/sorted").where(F.col("sweep") == sweep)
        landed.drop("sweep").write.mode("append").parquet(f"{base}/landing")
        price_change_stream(spark.readStream.schema(TICK).parquet(f"{base}/landing"), base).awaitTermination()
    return spark.read.schema(TICK).parquet(f"{base}/history/v=*")


def venue_folder(root: str, venue: str) -> str:
    """Each venue has a state, a history and ids of its own, so its sweeps touch no other's rows."""
    return f"{root}/venue={venue}"


def state_table(spark: SparkSession, root: str, venue: str) -> BucketedTable:
    """A venue's current state, by ticker."""
    return BucketedTable(spark, f"{venue_folder(root, venue)}/state", STATE, ("ticker",))


def apply_sweep(spark: SparkSession, root: str, venue: str, incoming: DataFrame, now: Column, complete: bool, referenced: DataFrame) -> dict[str, int]:
    """One sweep of a venue: keep good rows, append price changes, add what changed to the state, and prune if the sweep is complete.

    incoming: market rows with the quality signals. referenced: id of rows that saved matches hold, which are never pruned.
    A ticker's first row counts. Venue a's pages move while they are read, so there repeats go before rows are judged, and
    a ticker whose first row is rejected stays out; venue b has none, and all its rows are judged.

    The rows are written once and read from there, so that history and state agree. The state gets a delta of what the
    sweep changes; the version that it commits is the one that the history has been written under, so nothing of a sweep
    that stops before its end is seen, and the next one writes over it. A sweep that is run again changes no price and so adds no history.
    Returns how many rows were kept, pruned and, as rejected_REASON, left out.
    """
    where, table = venue_folder(root, venue), state_table(spark, root, venue)
    at = table.manifest()
    rows, state = incoming.where(F.col("venue") == venue).withColumn("_turn", F.monotonically_increasing_id()), table.read(at=at)
    if venue == "a":
        rows = normalize.first_seen(rows, "ticker", "_turn")
    rows = rows.withColumn("_reason", quality.reject_reason(now))
    rows.write.mode("overwrite").parquet(f"{where}/swept/v={at.version + 1}")
    rows = spark.read.schema(rows.schema).parquet(f"{where}/swept/v={at.version + 1}")
    counts = {f"rejected_{r['_reason']}" if r["_reason"] else "kept": r["count"] for r in rows.groupBy("_reason").count().collect()}  # a row for each reason
    first = normalize.first_seen(rows.where("_reason IS NULL"), "ticker", "_turn").drop("_reason", "_turn")
    history = store.changed_prices(conform(first, MARKET), state, "ticker", "venue", "price", "volume", "timestamp").withColumn("recorded_at", now)
    history.write.mode("overwrite").parquet(f"{where}/history/v={at.version + 1}")
    tickers, new = first.select("ticker"), Observation()
    merged = store.merge(state.join(tickers, "ticker", "left_semi").select(*state.columns), conform(first, MARKET), now)
    merged.observe(new, F.count_if(F.col("id").isNull()).alias("n")).write.mode("overwrite").parquet(f"{where}/merged/v={at.version + 1}")
    merged = spark.read.schema(STATE).parquet(f"{where}/merged/v={at.version + 1}")
    if observed(new, "n")["n"]:
        merged = store.give_ids(merged, store.top_id(state))
    gone = store.stale(state.join(tickers, "ticker", "left_anti"), now, referenced, complete, DEFAULTS.prune_stale, counts.get("kept", 0))
    pruned = Observation()
    table.write(merged, gone.select("ticker").observe(pruned, F.count("*").alias("n")))
    for name in ("swept", "merged"):
        deleted(spark, f"{where}/{name}/v={at.version + 1}")
    return {"kept": 0, **counts, "pruned": observed(pruned, "n")["n"]}


def state_of(spark: SparkSession, root: str, venue: str) -> DataFrame:
    """A venue's markets now."""
    return state_table(spark, root, venue).read()


def history_of(spark: SparkSession, root: str, venue: str) -> DataFrame:
    """The price history of a venue, up to the last sweep that has come to its end."""
    version = state_table(spark, root, venue).manifest().version
    rows = spark.read.schema(f"{HISTORY}, v bigint").parquet(f"{venue_folder(root, venue)}/history") if version else spark.createDataFrame([], f"{HISTORY}, v bigint")
    return rows.where(F.col("v") <= version).drop("v")


@dataclass
class Status:
    """What a venue's sweeps did last; an error keeps the last good numbers."""

    sweeps: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    error: str | None = None

    def done(self, counts: dict[str, int]) -> None:
        self.sweeps, self.counts, self.error = self.sweeps + 1, counts, None

    def failed(self, error: Exception) -> None:
        self.error = f"{type(error).__name__}: {error}"


def sweep_stream(source: DataFrame, root: str, venue: str, normalise: Callable[[DataFrame, Column], DataFrame], checkpoint: str, referenced: Callable[[SparkSession], DataFrame], complete: Callable[[int], bool] = lambda _: True, clock: Callable[[], datetime] = lambda: datetime.now(UTC), status: Status | None = None, seconds: int | None = None) -> StreamingQuery:
    """One query for a venue; its batches follow each other, so sweeps never overlap, and a stopped one is not saved: the snapshot flips at its end.

    normalise: raw rows and the time as market rows. referenced: the ids that saved matches hold now.
    seconds: the interval of a live run; None takes what has landed and ends.
    """
    status = status or Status()

    def save(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        now = F.lit(clock())
        try:
            status.done(apply_sweep(batch.sparkSession, root, venue, normalise(batch, now), now, complete(batch_id), referenced(batch.sparkSession)))
        except Exception as error:
            status.failed(error)
            raise

    writer = source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


class Ingestion:
    """Sweeps of several venues, each of which can be turned on and off. starts: by venue, what starts its query with a status to fill."""

    def __init__(self, starts: dict[str, Callable[[Status], StreamingQuery]]):
        self.starts, self.queries, self.states = starts, {}, {venue: Status() for venue in starts}

    def turn(self, venue: str, on: bool) -> None:
        query = self.queries.pop(venue, None)
        if query is not None and query.isActive:
            if on:
                self.queries[venue] = query
                return
            query.stop()
        if on:
            self.queries[venue] = self.starts[venue](self.states[venue])

    def status(self) -> dict[str, dict]:
        return {venue: {"running": venue in self.queries and self.queries[venue].isActive, "sweeps": s.sweeps, "counts": s.counts, "error": s.error} for venue, s in self.states.items()}


def catalogue_stream(spark: SparkSession, root: str, venue: str, fetcher: str, normalise: Callable[[DataFrame, Column], DataFrame], referenced: Callable[[SparkSession], DataFrame], clock: Callable[[], datetime] = lambda: datetime.now(UTC), status: Status | None = None, seconds: int | None = None, **options) -> StreamingQuery:
    """Sweeps of a paged catalogue, page by page: the source lands pages, and when a sweep's last page has come the sweep is applied.

    fetcher: module:function, as in sources.catalogue. normalise gets the rows as JSON in column `row`. Whether a
    sweep is complete is what its pages say; one that the page cap cuts short prunes nothing. A query that is
    started again goes on behind the last page that landed.
    """
    register(spark)
    status, landing = status or Status(), f"{venue_folder(root, venue)}/pages"
    options = {"landing": landing, "fetcher": fetcher, **{k: str(v) for k, v in options.items()}}

    def save(batch: DataFrame, batch_id: int) -> None:
        ended = batch.where("last").select("sweep", "complete").distinct().orderBy("sweep").collect()  # a row for each sweep
        for sweep in ended:
            rows = spark.read.format(NAME).option("landing", landing).option("sweep", str(sweep["sweep"])).load()
            now = F.lit(clock())
            try:
                status.done(apply_sweep(spark, root, venue, normalise(rows.where("row IS NOT NULL").orderBy("page", "place"), now), now, sweep["complete"], referenced(spark)))
            except Exception as error:
                status.failed(error)
                raise

    source = spark.readStream.format(NAME).options(**options).load()
    writer = source.writeStream.foreachBatch(save).option("checkpointLocation", f"{venue_folder(root, venue)}/progress")
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
