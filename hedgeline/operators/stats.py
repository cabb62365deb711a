"""Venue statistics: totals, price distribution, activity, and what the dashboard shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.quality import is_open, reject_reason


def venue_summary(markets: DataFrame, as_of: Column) -> DataFrame:
    open_ = is_open(F.col("close_time"), as_of)
    return markets.groupBy("venue").agg(F.count("*").alias("total"), F.count_if(open_).alias("open"), F.coalesce(F.sum(F.when(open_, F.col("volume"))), F.lit(0.0)).alias("open_volume"), F.max("updated_at").alias("last_update"))


def price_histogram(markets: DataFrame, as_of: Column, buckets: int = DEFAULTS.price_buckets) -> DataFrame:
    """Open markets by tenths of the price, each venue with all buckets; a price of 1 is in the last."""
    inside = markets.where(is_open(F.col("close_time"), as_of) & F.col("price").between(0, 1))
    bucket = F.least(F.floor(F.col("price") * buckets), F.lit(buckets - 1)).cast("int")
    counts = inside.groupBy("venue", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    dense = markets.select("venue").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    out = dense.join(counts, ["venue", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy("venue"))  # over a venue's buckets
    return out.withColumn("share", F.col("n") / F.when(total == 0, 1).otherwise(total))


def top_by_volume(markets: DataFrame, as_of: Column, k: int = 8) -> DataFrame:
    """Each venue's largest open markets."""
    rows = markets.where(is_open(F.col("close_time"), as_of)).select("venue", "ticker", F.coalesce("title", "event_title").alias("title"), "volume", "price")
    place = F.row_number().over(W.partitionBy("venue").orderBy(F.desc("volume"), "ticker"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def hourly_activity(events: DataFrame, group: str, at: str, as_of: Column, hours: int = DEFAULTS.history_hours) -> DataFrame:
    """Rows by full hours before as_of, each group with all hours."""
    age = F.unix_micros(as_of) - F.unix_micros(F.col(at).cast("timestamp"))
    recent = events.where((age >= 0) & (age < hours * 3_600_000_000)).groupBy(group, F.floor(age / 3_600_000_000).cast("int").alias("hours_ago")).agg(F.count("*").alias("n"))
    dense = events.select(group).distinct().withColumn("hours_ago", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    return dense.join(recent, [group, "hours_ago"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def scatter_feed(matched: DataFrame, rows: int = 300) -> DataFrame:
    return matched.orderBy(F.desc_nulls_last("last_sync_at"), "id").limit(rows).select("id", "confidence", "price_spread", "total_combined_volume", "common_title")


def quality_tally(markets: DataFrame, as_of: Column) -> DataFrame:
    return markets.groupBy(F.coalesce(reject_reason(as_of), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def overview(markets: DataFrame, history: DataFrame, matched: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """All of a dashboard's tables; both venues in one pass each."""
    return {"summary": venue_summary(markets, as_of), "histogram": price_histogram(markets, as_of), "top": top_by_volume(markets, as_of), "activity": hourly_activity(history, "venue", "recorded_at", as_of), "matches": scatter_feed(matched)}


def dashboard(activity: DataFrame, matched: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row: moves of the last day, mean spread and confidence of saved matches, the best edge."""
    moves = activity.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("moves_24h"))
    saved = matched.agg(F.coalesce(F.avg("price_spread"), F.lit(0.0)).alias("mean_spread"), F.coalesce(F.avg(F.col("confidence").cast("double")), F.lit(0.0)).alias("mean_confidence"))
    best = quotes.agg(F.max("net_edge").alias("best_edge"))
    return moves.crossJoin(F.broadcast(saved)).crossJoin(F.broadcast(best))  # one row each
