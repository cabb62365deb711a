"""Activity by the hour as a stream: late rows, closed hours, restarts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hedgeline.operators import stats
from hedgeline.streaming import activity

pytestmark = pytest.mark.usefixtures("many_small_jobs")
AS_OF = dt.datetime(2024, 1, 15)


def events(spark, *rows):
    return spark.createDataFrame([(k, AS_OF - dt.timedelta(minutes=m)) for k, m in rows], "event_type string, ts timestamp_ntz")


def test_late_rows_count_within_the_watermark_only(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")

    def land(*rows):
        events(spark, *rows).coalesce(1).write.mode("append").parquet(landing)
        source = spark.readStream.schema("event_type string, ts timestamp_ntz").parquet(landing)
        activity.activity_stream(source, root, "event_type", "ts", late="2 hours").awaitTermination()

    land(("x", 600), ("x", 599), ("y", 480), ("x", 480))  # an hour's end belongs to it: 8 hours ago
    land(("x", 300))
    land(("y", 361), ("x", 590))  # within two hours of the newest row, and far behind it
    land(("x", 0), ("y", 1))
    table = activity.activity_table(spark, root).read()
    found = {(r["kind"], r["hours_ago"]): r["n"] for r in activity.rolling(table, F.lit(AS_OF)).collect()}
    assert {k: n for k, n in found.items() if n} == {("x", 10): 1, ("x", 9): 1, ("y", 8): 1, ("x", 8): 1, ("x", 5): 1, ("y", 6): 1, ("x", 0): 1, ("y", 0): 1}
    assert len(found) == 48
    everything = spark.read.parquet(landing).where(F.col("ts") != F.lit(AS_OF - dt.timedelta(minutes=590)))
    batch = {(r["event_type"], r["hours_ago"]): r["n"] for r in stats.hourly_activity(everything, "event_type", "ts", F.lit(AS_OF)).collect()}
    assert batch == found
