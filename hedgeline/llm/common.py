"""Helpers that the corpus operators share: scratch tables, batch sizes, table access."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..sources.landing import shared_folder

#: Rows in an Arrow batch that holds whole texts. Texts reach 100 kB and more, so that the default of 10,000 rows could be over a GB.
TEXT_BATCH_ROWS = 512
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark's own readers so that any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bound the Arrow batches of the session, as rows of texts differ a thousandfold in length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def parallelism(spark: SparkSession) -> int:
    """How many partitions shuffles of this session have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 50_000) -> DataFrame:
    """mapInPandas over frames of about so many rows, for narrow rows in a session whose Arrow batches are sized for texts."""
    import pyarrow as pa

    out = to_arrow_schema(_parse_datatype_string(schema))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield pa.Table.from_batches(held).to_pandas()
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).to_pandas()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in f(gathered(batches)):
            if len(frame):
                yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    return df.mapInArrow(run, schema)


class Scratch:
    """Intermediate tables in the folder that all executors share (spark.checkpoint.dir).

    A written table cuts the lineage: after the loss of an executor only the
    tasks that read it run again. What is still there when the session's JVM
    ends is deleted then; `released` does so as soon as a result is written.
    """

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        where, system = self._at("")
        system.deleteOnExit(where)
        self.tables: dict[str, str] = {}
        Scratch.opened.append(self)

    def _at(self, name: str):
        """A table's path and its file system."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write df once and return the written table."""
        before = self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")  # what was written is read from now on, so the shuffle files behind it can go
        try:
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.base}/{name}")
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def keep_bucketed(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """Write df once, hashed by the keys into as many buckets as shuffles have partitions and sorted in each, so that joins by the keys need no shuffle."""
        buckets, self.tables[name] = parallelism(self.spark), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        before = self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            writer = df.repartition(buckets, *keys).write.mode("overwrite").option("compression", "zstd").option("path", f"{self.base}/{name}")
            writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(self.tables[name])
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.table(self.tables[name])

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them, once what reads them has been written elsewhere."""
        for known in [name] if name else list(self.tables):
            if known in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(known)}")
        where, system = self._at(name)
        system.delete(where, True)


@contextmanager
def released() -> Iterator[None]:
    """Deletes the scratch tables that were opened inside, once what was made from them is written or collected."""
    before = len(Scratch.opened)
    try:
        yield
    finally:
        for scratch in Scratch.opened[before:]:
            scratch.drop()
        del Scratch.opened[before:]


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, take no part."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its case: the given ones, with as many signs behind them as it takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
