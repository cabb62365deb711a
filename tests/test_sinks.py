"""Lines that are seen as a whole batch or not at all."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from hedgeline.operators import store
from hedgeline.sources import sinks


def test_events_come_in_order_and_end_with_a_result(spark, tmp_path):
    path = str(tmp_path / "run")
    events = spark.range(500).select((499 - F.col("id")).alias("t"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("stage")).repartition(7)
    sinks.write_events(events.where("t < 300"), path)
    sinks.write_events(events.where("t >= 300"), path)
    sinks.finish(path, {"matched": 3})
    *lines, last = map(json.loads, sinks.committed(path))
    assert [x["t"] for x in lines] == list(range(500)) and lines[0]["stage"] == "é 499"
    assert last == {"type": "result", "success": True, "matched": 3}
    sinks.finish(path, error="gone")
    assert json.loads(list(sinks.committed(path))[-1]) == {"type": "error", "success": False, "error": "gone"}


def test_nothing_of_an_aborted_write_is_seen(spark, tmp_path):
    path = tmp_path / "run"
    sinks.register(spark)
    rows = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("boom"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="boom"):
        rows.write.format(sinks.NAME).mode("append").option("path", str(path)).save()
    assert list(sinks.committed(str(path))) == [] and (not path.exists() or all(p.name.startswith(".") for p in path.iterdir()))  # a task that was late may have staged what nobody reads


def test_what_a_lost_attempt_left_is_taken_away(spark, tmp_path):
    writer = sinks.BatchWriter({"path": str(tmp_path)})
    staged = tmp_path / f".{writer.staging}"
    staged.mkdir()
    for name in ("part-00000-1.jsonl", "part-00000-2.jsonl"):
        (staged / name).write_text(f"{name}\n")
    writer.commit([sinks.Written(writer.staging, "part-00000-2.jsonl", 1), None])
    assert list(sinks.committed(str(tmp_path))) == ["part-00000-2.jsonl"] and not staged.exists()


def test_recordsets_come_in_chunks(spark, tmp_path):
    path = str(tmp_path / "sets")
    sinks.write_recordsets(spark.range(2500).coalesce(1).select("id", F.col("id").cast("string").alias("name")), path)
    lines = list(sinks.committed(path))
    assert [len(json.loads(x)) for x in lines] == [1000, 1000, 500]
    back = store.from_json_records(spark.createDataFrame([(x,) for x in lines], "records string"), "records", "id: bigint, name: string")
    assert back.agg(F.sum("id"), F.count("name")).first() == (2500 * 2499 // 2, 2500)
    sinks.write_recordsets(spark.range(0).select("id"), path)
    assert len(list(sinks.committed(path))) == 3


def test_a_batch_of_a_stream_that_comes_again_changes_nothing(spark, tmp_path):
    sinks.register(spark)
    landing, path = str(tmp_path / "landing"), str(tmp_path / "out")

    def run(checkpoint):
        lines = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(landing).select(F.to_json(F.struct("id")).alias("value"))
        lines.writeStream.format(sinks.NAME).option("path", path).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    for first in (0, 10):
        spark.range(first, first + 10).coalesce(1).write.mode("append").parquet(landing)
    run("one")
    expected = sorted(sinks.committed(path))
    assert len(expected) == 20 and sinks.batches(path) == ["batch=00000000", "batch=00000001"]
    run("again")  # the same batches under another checkpoint
    assert sorted(sinks.committed(path)) == expected
    assert not [p.name for p in (tmp_path / "out").iterdir() if "staging" in p.name]
