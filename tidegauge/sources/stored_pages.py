"""Stored pages of a forge as a data source that stops at what is old.

A sweep stores the pages of each project as path/PROJECT/NUMBER.json, a list of requests each,
those updated last first, as a forge gives them. A filter on updated_at is pushed into the
source: pages are read in their order until one holds a request that is older, since all
after it are older too. So a sweep for what is new reads the pages that are new.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "project string, page int, id bigint, updated_at timestamp, body string"


def instant(text) -> datetime | None:
    """An ISO time, in UTC if it names no zone; None if it is none."""
    try:
        at = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


@dataclass
class Project(InputPartition):
    name: str
    folder: str


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    """A task for each project, since a project's pages are read one after the other."""

    def __init__(self, path: str):
        self.path, self.since, self.strict = path.rstrip("/"), None, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) or f.attribute != ("updated_at",):
                yield f
                continue
            value = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
            bound = value, isinstance(f, GreaterThan)
            if self.since is None or bound > (self.since, self.strict):
                self.since, self.strict = bound

    def partitions(self) -> list[Project]:
        from pyarrow import fs

        store, root = _files(self.path)
        found = store.get_file_info(fs.FileSelector(root))
        return [Project(f.base_name, f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.Directory]

    def stale(self, at: datetime) -> bool:
        return self.since is not None and (at < self.since or (self.strict and at == self.since))

    def read(self, partition: Project) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = _files(self.path)
        named = [(f.base_name.removesuffix(".json"), f.path) for f in store.get_file_info(fs.FileSelector(partition.folder))]
        for number, path in sorted((int(n), p) for n, p in named if n.isdigit()):
            with store.open_input_stream(path) as f:
                rows = [(r, instant(r.get("updated_at"))) for r in json.loads(f.read())]
            for r, at in rows:
                if self.since is None or (at is not None and not self.stale(at)):
                    yield partition.name, number, r.get("id"), at, json.dumps(r)
            if any(at is not None and self.stale(at) for _, at in rows):
                return


class StoredPages(DataSource):
    """spark.read.format("stored_pages").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def sweep(spark: SparkSession, path: str, since=None, schema: str | None = None) -> DataFrame:
    """The requests of all projects, updated at `since` (a column or a time) or later; a
    request without a time is in none but a whole sweep. With a schema, such as
    payloads.MERGE_REQUEST, they are parsed as payloads.merge_requests takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredPages)
    rows = spark.read.format("stored_pages").load(path)
    if since is not None:
        rows = rows.where(F.col("updated_at") >= F.lit(since).cast("timestamp"))
    return rows if schema is None else rows.select(F.from_json("body", schema).alias("r")).select("r.*")
