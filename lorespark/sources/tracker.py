"""Issues and wiki pages as Spark data sources: JSON answers of a tracker's search in a folder, one partition for each file.

    tracker.register(spark)
    spark.read.format("tracker_issues").load(folder).where("project = 'PAY'")
    spark.read.format("tracker_pages").schema("page_id string, title string").load(folder)

Comparisons of columns with constants are pushed down: rows that fail are left out before texts are rendered. A schema given to the
reader names the columns wanted; the others, texts above all, are not made. Folders may be in any file system that pyarrow opens by its URI.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

ISSUE = "key string, project string, summary string, status string, issuetype string, assignee string, updated string, text string"
PAGE = "page_id string, space string, title string, updated string, excerpt string, markdown string"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _issue(raw: dict, column: str) -> Any:
    from lorespark.sources import markup

    fields = raw.get("fields") or {}
    match column:
        case "key":
            return raw.get("key")
        case "project":
            return (raw.get("key") or "").rpartition("-")[0] or None
        case "text":
            return markup.issue_text(json.dumps(raw))
        case "summary" | "updated":
            return fields.get(column)
    return markup.plain_value(fields.get(column)) or None


def _page(raw: dict, column: str) -> Any:
    from lorespark.sources import markup

    match column:
        case "page_id":
            return None if raw.get("id") is None else str(raw["id"])
        case "space":
            return (raw.get("space") or {}).get("key")
        case "updated":
            return (raw.get("version") or {}).get("when")
        case "markdown":
            return markup.to_markdown(((raw.get("body") or {}).get("storage") or {}).get("value") or "")
        case "excerpt":
            return markup.excerpt(raw.get("excerpt"))
    return raw.get(column)


def _holds(row: Any, f: Filter) -> bool:
    """Whether a value passes a filter; null passes none."""
    if isinstance(f, IsNotNull):
        return row is not None
    if row is None:
        return False
    match f:
        case EqualTo():
            return row == f.value
        case In():
            return row in f.value
        case GreaterThan():
            return row > f.value
        case GreaterThanOrEqual():
            return row >= f.value
        case LessThan():
            return row < f.value
        case LessThanOrEqual():
            return row <= f.value
    return row.startswith(f.value)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    KINDS = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull, StringStartsWith)

    def __init__(self, folder: str, schema: StructType, pages: bool):
        self.folder, self.columns, self.pages, self.filters = folder, schema.names, pages, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, self.KINDS) and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, at = _opened(self.folder)
        found = files.get_file_info(fs.FileSelector(at, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".json")]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # an empty folder
            return
        files, _ = _opened(self.folder)
        with files.open_input_stream(partition.value) as stream:
            answer = json.loads(stream.read())
        value = _page if self.pages else _issue
        for raw in answer.get("results" if self.pages else "issues") or []:
            if all(_holds(value(raw, f.attribute[0]), f) for f in self.filters):
                yield tuple(value(raw, c) for c in self.columns)


class Issues(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracker_issues"

    def schema(self) -> str:
        return ISSUE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, False)


class Pages(Issues):
    @classmethod
    def name(cls) -> str:
        return "tracker_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, True)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind in (Issues, Pages):
        spark.dataSource.register(kind)
