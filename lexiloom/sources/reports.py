"""A Python data source of a paged search report: a table, or a stream that goes on where it ended.

A report lies in a folder, one file for each page of a day's answer:
``day=YYYY-MM-DD/page-<number>.json``, an object whose ``rows`` have keys (the
query first), clicks, impressions, ctr and position.  A stream's offset is the
last day and page that were read; a run that starts again with its checkpoint
reads the pages after that, one task a page, and no page twice.  Pages of a day
land in order, and a day's pages before those of later days.

A page without rows gives one row without a query and with ``empty``, so a day
that was asked for and had nothing is told from one that was not asked for.  A
page that is no JSON object gives one row with ``error``.  Values that are
missing are null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "day string, page int, query string, clicks double, impressions double, ctr double, position double, empty boolean, error boolean"


@dataclass
class Page(InputPartition):
    path: str
    day: str
    page: int


def pages(path: str) -> list[Page]:
    """All landed pages, by day and number."""
    from pyarrow import fs

    own, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    listed = own.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    found = ((f.path, re.search(r"day=(\d{4}-\d\d-\d\d)/page-(\d+)\.json$", f.path)) for f in listed if f.type == fs.FileType.File)
    return sorted((Page(p, m[1], int(m[2])) for p, m in found if m), key=lambda x: (x.day, x.page))


def rows_of(path: str, page: Page) -> Iterator[tuple]:
    from pyarrow import fs

    own = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
    with own.open_input_stream(page.path) as f:
        content = f.read()
    try:
        rows = json.loads(content).get("rows") or []
        made = [(r.get("keys") or [None], *(None if r.get(c) is None else float(r[c]) for c in ("clicks", "impressions", "ctr", "position"))) for r in rows]
    except (ValueError, AttributeError, TypeError):
        yield page.day, page.page, *[None] * 5, False, True
        return
    if not made:
        yield page.day, page.page, *[None] * 5, True, False
    for keys, *numbers in made:
        yield page.day, page.page, keys[0], *numbers, False, False


class ReportReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Page]:
        return pages(self.path) or [Page("", "", -1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return rows_of(self.path, partition) if partition.path else iter(())


class ReportStreamReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": "", "page": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        landed = pages(self.path)
        return {"day": landed[-1].day, "page": landed[-1].page} if landed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Page]:
        after, upto = ((o["day"], o["page"]) for o in (start, end))
        return [p for p in pages(self.path) if after < (p.day, p.page) <= upto]

    def read(self, partition: Page) -> Iterator[tuple]:
        return rows_of(self.path, partition)


class ReportSource(DataSource):
    """The rows of all pages below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "search_report_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReportReader:  # noqa: ANN001
        return ReportReader(self.options["path"])

    def streamReader(self, schema) -> ReportStreamReader:  # noqa: ANN001, N802
        return ReportStreamReader(self.options["path"])
