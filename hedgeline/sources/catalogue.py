"""A venue's paged catalogue as a Spark source: spark.readStream or spark.read, format("venue_catalogue").

A cursor leads from each page to the next, so pages are fetched one after the
other; each is landed as a file of its own, with the cursor behind it, before
its rows are anybody's. Offsets count landed pages: a query that starts again
reads files and fetches only what has not landed. Rows are read from the files
by the executors, a task for each page.

Options: landing, a folder that driver and executors share. fetcher, module:function
of a function that gets the options and gives one from a cursor (None at first) to the page's rows as JSON and the next cursor.
max_pages of a sweep; pages_per_batch, all of a sweep's if not given. sweep: of a batch read, which landed sweep.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..config import DEFAULTS

NAME = "venue_catalogue"
SCHEMA = "sweep bigint, page int, place int, last boolean, complete boolean, row string"


@dataclass(frozen=True)
class Page(InputPartition):
    sweep: int
    page: int


def file_system(where: str) -> tuple[fs.FileSystem, str]:
    """A folder's file system and its path there."""
    return fs.FileSystem.from_uri(where) if "://" in where or where.startswith(("/", "file:")) else (fs.LocalFileSystem(), where)


class Landing:
    """Pages as files: a line of what is known of the page, then a line for each row."""

    def __init__(self, where: str):
        self.system, self.base = file_system(where)

    def path(self, page: Page) -> str:
        return f"{self.base}/sweep={page.sweep:08d}/page={page.page:06d}.jsonl"

    def pages(self, sweep: int | None = None) -> list[Page]:
        """The pages of a sweep, or of the last one, in order."""
        if sweep is None:
            sweeps = self.system.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
            sweep = max((int(f.base_name.removeprefix("sweep=")) for f in sweeps if f.base_name.startswith("sweep=")), default=0)
        found = self.system.get_file_info(fs.FileSelector(f"{self.base}/sweep={sweep:08d}", allow_not_found=True))
        return sorted((Page(sweep, int(m[1])) for f in found if (m := re.fullmatch(r"page=(\d+)\.jsonl", f.base_name))), key=lambda p: p.page)

    def put(self, page: Page, head: dict, rows: list[str]) -> None:
        """A whole page or none: what is being written has another name."""
        path = self.path(page)
        self.system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.system.open_output_stream(f"{path}.tmp") as out:
            out.write("\n".join([json.dumps(head), *(json.dumps(row) for row in rows)]).encode())
        self.system.move(f"{path}.tmp", path)

    def read(self, page: Page) -> tuple[dict, list[str]]:
        with self.system.open_input_stream(self.path(page)) as lines:
            head, *rows = lines.read().decode().split("\n")
        return json.loads(head), [json.loads(row) for row in rows]

    def rows(self, page: Page) -> Iterator[tuple]:
        """A page's rows; a page without rows is one row that holds none, so that its end of the sweep is told."""
        head, rows = self.read(page)
        for place, row in enumerate(rows or [None]):
            yield page.sweep, page.page, place, head["last"], head["complete"], row


def next_page(landing: Landing, fetch, max_pages: int) -> bool:
    """Fetch and land the page behind the last one that landed; whether the sweep ends with it."""
    known = landing.pages()
    head = landing.read(known[-1])[0] if known else {"last": True}
    page = Page(known[-1].sweep + 1 if known else 1, 0) if head["last"] else Page(known[-1].sweep, known[-1].page + 1)
    rows, cursor = fetch(None if head["last"] else head["next"])
    complete = not rows or not cursor
    last = complete or page.page + 1 >= max_pages
    landing.put(page, {"next": cursor, "last": last, "complete": complete}, rows)
    return last


def fetcher(options):
    module, _, name = options["fetcher"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SweepReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageReader(self.options)


class SweepReader(DataSourceReader):
    """A sweep that has landed, or one that is fetched now."""

    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[Page]:
        landing = Landing(self.options["landing"])
        if "sweep" not in self.options:
            while not next_page(landing, fetcher(self.options), int(self.options.get("max_pages", DEFAULTS.max_pages))):
                pass
        return landing.pages(int(self.options["sweep"]) if "sweep" in self.options else None)

    def read(self, partition: Page) -> Iterator[tuple]:
        return Landing(self.options["landing"]).rows(partition)


class PageReader(DataSourceStreamReader):
    """Offsets say up to which page of which sweep has been read."""

    def __init__(self, options):
        self.options = dict(options)
        self.landing = Landing(self.options["landing"])

    def initialOffset(self) -> dict:
        return {"sweep": 0, "page": -1}

    def latestOffset(self) -> dict:
        """Lands what comes next and counts it in."""
        most = int(self.options.get("max_pages", DEFAULTS.max_pages))
        fetch = fetcher(self.options)
        for _ in range(int(self.options.get("pages_per_batch", most))):
            if next_page(self.landing, fetch, most):
                break
        last = self.landing.pages()[-1]
        return {"sweep": last.sweep, "page": last.page}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        found = [page for sweep in range(max(1, start["sweep"]), end["sweep"] + 1) for page in self.landing.pages(sweep)]
        return [p for p in found if (start["sweep"], start["page"]) < (p.sweep, p.page) <= (end["sweep"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.landing.rows(partition)

    def commit(self, end: dict) -> None:
        """Pages stay where they landed: a sweep is read as a whole once its last one is there."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CatalogueSource)
