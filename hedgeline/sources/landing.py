"""Where catalogue pages arrive, and how a sweep walks through them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULTS
from ..schemas import CATALOGUE_A, CATALOGUE_B


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset, a local session gets a temporary folder; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="hedgeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for what nobody wants after this session; it goes when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return folder


def deleted(spark: SparkSession, path: str) -> bool:
    """Take a folder away, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def landed(spark: SparkSession, path: str, venue: str, stream: bool = False) -> DataFrame:
    """Catalogue pages as lines of JSON, all at once or as a stream."""
    reader = spark.readStream.option("maxFilesPerTrigger", 1) if stream else spark.read
    return reader.schema(CATALOGUE_A if venue == "a" else CATALOGUE_B).json(path)


#: A page by its cursor: rows as JSON strings, and the next cursor or None.
FetchPage = Callable[[str | None], tuple[list[str], str | None]]


def sweep_pages(fetch: FetchPage, max_pages: int = DEFAULTS.max_pages) -> Iterator[tuple[list[str], bool]]:
    """Pages of one sweep and whether the sweep is complete with it: no cursor or an empty page ends it, the page cap cuts it short."""
    cursor = None
    for _ in range(max_pages):
        rows, cursor = fetch(cursor)
        done = not rows or not cursor
        yield rows, done
        if done:
            return


def sorted_or_plain(fetch_sorted: FetchPage, fetch_plain: FetchPage) -> FetchPage:
    """Ask for sorted pages until the venue refuses the first one, then go on unsorted."""
    state = {"plain": False}

    def fetch(cursor: str | None) -> tuple[list[str], str | None]:
        if not state["plain"]:
            try:
                return fetch_sorted(cursor)
            except ValueError:  # what a connector raises for a 4xx answer
                if cursor is not None:
                    raise
                state["plain"] = True
        return fetch_plain(cursor)

    return fetch
