"""Activity by the hour as a stream: counts of full hours of event time, in state that ends with the watermark and a table that the last word of each hour stays in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..config import DEFAULTS
from ..sources.buckets import BucketedTable

ACTIVITY = "kind string, hour timestamp, n bigint"
#: An hour ends with its full hour and begins behind the one before, as ages are counted.
BEHIND = "1 microsecond"


def activity_table(spark: SparkSession, root: str) -> BucketedTable:
    """Counts by kind and hour (its end)."""
    return BucketedTable(spark, f"{root}/hours", ACTIVITY, ("kind", "hour"), buckets=8)


def activity_stream(events: DataFrame, root: str, group: str, at: str, late: str = "2 hours", seconds: int | None = None) -> StreamingQuery:
    """Count a stream's rows by group and hour. Rows are taken as long as they are less than `late` behind the newest one; then their hour is closed and its state goes.

    What a batch changes is written over the table's hours, so a batch that runs again changes nothing.
    """
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(F.col(group).alias("kind"), F.window("_at", "1 hour", startTime=BEHIND).alias("w")).agg(F.count("*").alias("n"))
    changed = counts.select("kind", (F.col("w.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("hour"), "n")
    table = activity_table(events.sparkSession, root)
    writer = changed.writeStream.outputMode("update").foreachBatch(lambda batch, _: table.write(batch)).option("checkpointLocation", f"{root}/progress")
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def rolling(table: DataFrame, as_of: Column, hours: int = DEFAULTS.history_hours) -> DataFrame:
    """kind, hours_ago, n of the hours before as_of, a full hour; each kind has all hours."""
    age = F.unix_micros(as_of) - F.unix_micros("hour")
    recent = table.where((age >= 0) & (age < hours * 3_600_000_000)).select("kind", F.floor(age / 3_600_000_000).cast("int").alias("hours_ago"), "n")
    dense = table.select("kind").distinct().withColumn("hours_ago", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    return dense.join(recent, ["kind", "hours_ago"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
