"""Lines of JSON as a sink that commits in two phases: df.write or df.writeStream, format("ordered_lines").

Tasks write files into a staging folder, and what they commit is the name of
their file. The driver then takes away what no task committed and gives the
folder its name, in one move; if the write is aborted the folder goes. So a
reader sees a whole batch or nothing of it. A batch of a stream that comes
again finds its folder there and changes nothing.

Files are named by partition: rows that were ranged and sorted before are in order from file to file.

Options: path. chunk: if given, each line is an array of so many records at most (a recordset), else each is a line of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from .catalogue import file_system

NAME = "ordered_lines"
CHUNK = 1_000


@dataclass
class Written(WriterCommitMessage):
    """A task's file, where it is staged, and how many records it holds."""

    staging: str
    name: str
    rows: int


def lines_of(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[bytes, int]]:
    """The lines, each with the number of records in it. Records are strings of JSON, in the column value."""
    held: list[str] = []
    for batch in batches:
        for value in batch.column("value").to_pylist():
            held.append(value)
            if len(held) == (chunk or 1):
                yield (f"[{','.join(held)}]" if chunk else held[0]).encode() + b"\n", len(held)
                held = []
    if held:
        yield f"[{','.join(held)}]".encode() + b"\n", len(held)


class Commits:
    """Both writers: staging for the tasks, one move for the driver."""

    def __init__(self, options):
        self.path, self.chunk, self.staging = options["path"], int(options.get("chunk", 0)), f"staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = file_system(self.path)
        context = TaskContext.get()
        name, rows = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.jsonl", 0
        system.create_dir(f"{base}/.{self.staging}", recursive=True)
        with system.open_output_stream(f"{base}/.{self.staging}/{name}") as out:
            for line, n in lines_of(iterator, self.chunk):
                out.write(line)
                rows += n
        return Written(self.staging, name, rows)

    def publish(self, messages: list[Written | None], target: str) -> None:
        system, base = file_system(self.path)
        from pyarrow import fs

        for message in filter(None, messages):
            self.staging = message.staging  # a stream's commits are made by a writer of their own
        staged = f"{base}/.{self.staging}"
        if system.get_file_info(f"{base}/{target}").type != fs.FileType.NotFound:
            self.discard()
            return
        system.create_dir(staged, recursive=True)
        good = {m.name for m in messages if m is not None and m.rows}
        for info in system.get_file_info(fs.FileSelector(staged)):
            if info.base_name not in good:
                system.delete_file(info.path)
        system.move(staged, f"{base}/{target}")

    def discard(self, messages: list[Written | None] = ()) -> None:
        for message in filter(None, messages):
            self.staging = message.staging
        system, base = file_system(self.path)
        from pyarrow import fs

        if system.get_file_info(f"{base}/.{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/.{self.staging}")


class BatchWriter(Commits, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages, f"batch={next_batch(self.path):08d}")

    def abort(self, messages: list[Written | None]) -> None:
        self.discard(messages)


class StreamWriter(Commits, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, f"batch={batchId:08d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.discard(messages)


def batches(path: str) -> list[str]:
    """The folders that have been committed, in order."""
    from pyarrow import fs

    system, base = file_system(path)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("batch="))


def next_batch(path: str) -> int:
    found = batches(path)
    return int(found[-1].removeprefix("batch=")) + 1 if found else 0


class OrderedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OrderedLines)


def write_events(events: DataFrame, path: str, order: str = "t") -> None:
    """Events as lines in the order of a column, committed as one batch."""
    register(events.sparkSession)
    events.repartitionByRange(order).sortWithinPartitions(order).select(F.to_json(F.struct("*")).alias("value")).write.format(NAME).mode("append").option("path", path).save()


def write_recordsets(rows: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Rows as arrays of at most so many records, as store.from_json_records reads them."""
    register(rows.sparkSession)
    rows.select(F.to_json(F.struct("*")).alias("value")).write.format(NAME).mode("append").option("path", path).option("chunk", chunk).save()


def finish(path: str, result: dict | None = None, error: str | None = None) -> None:
    """The last line of a run: its result or its error."""
    system, base = file_system(path)
    system.create_dir(base, recursive=True)
    line = {"type": "error", "success": False, "error": error} if error is not None else {"type": "result", "success": True, **(result or {})}
    with system.open_output_stream(f"{base}/.end.jsonl") as out:
        out.write(json.dumps(line).encode() + b"\n")
    system.move(f"{base}/.end.jsonl", f"{base}/end.jsonl")


def committed(path: str) -> Iterator[str]:
    """All lines that readers may see, in order, the last one behind them."""
    from pyarrow import fs

    system, base = file_system(path)
    files = [f.path for b in batches(path) for f in sorted(system.get_file_info(fs.FileSelector(f"{base}/{b}")), key=lambda f: f.path)]
    end = f"{base}/end.jsonl"
    for file in files + ([end] if system.get_file_info(end).type != fs.FileType.NotFound else []):
        with system.open_input_stream(file) as lines:
            yield from lines.read().decode().splitlines()
