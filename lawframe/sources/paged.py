"""A data source for listings that answer page by page: `spark.read.format("paged")` and `spark.readStream.format("paged")`.

Options: `root`, a folder (any URI that pyarrow's file systems know) of saved answers or an http(s) address; `items`, the
columns of an item as a DDL string; `page`, items asked for at once; `pages`, pages a task reads; `tries` and `wait`, of a
page that fails; `walk`, `offset` or `mark`.

offset: `tables.json` names the tables (congress, session, total). A task has a range of places of one table, known from
the totals alone, and asks for pages from the place it has come to; what a page holds beyond the range is another task's,
so pages may overlap, be short or long, and come twice. Where no page begins at the place, the one at the multiple of
`page` before it is read from there on. On a stream the offsets are the totals read so far.
mark: a chain of pages, each naming the next; the driver follows the marks and tasks read the pages' items. On a stream
the offset is the mark to go on from; a page is read once it names a next one. A run's first look follows the chain from
its beginning, as Spark doesn't tell a source where its checkpoint ends; later ones go on from there.

A page that is missing, empty too early or no JSON gives a row with `error` and no item, and ends its range.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

HEAD = "congress int, session int, place long, total long, error string"
#: Statuses of an answer that may be another the next time.
PASSING = {429, 500, 502, 503, 504}


class Pages:
    """Saved or served pages by name; None for a page that isn't there."""

    def __init__(self, options: dict[str, str]):
        self.root, self.page = options["root"].rstrip("/"), int(options.get("page", 100))
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 1.0))

    def _raw(self, name: str, query: dict[str, Any]) -> bytes | None:
        if self.root.startswith(("http://", "https://")):
            address = f"{self.root}/{name}" + (f"?{urllib.parse.urlencode(query)}" if query else "")
            try:
                with urllib.request.urlopen(address, timeout=60) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                raise
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(self.root)
        file = f"{base}/{name}" + "".join(f"-{urllib.parse.quote(str(v), safe='')}" for k, v in query.items() if k != "limit") + ".json"
        try:
            with at.open_input_stream(file) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def get(self, name: str, **query: Any) -> dict | None:
        """The page as JSON, tried again after a pause (twice as long each time, or as the answer says) where a failure may pass."""
        for left in range(self.tries - 1, -1, -1):
            try:
                raw = self._raw(name, query)
                return None if raw is None else json.loads(raw)
            except urllib.error.HTTPError as e:
                if e.code not in PASSING or not left:
                    raise
                after = e.headers.get("Retry-After", "")
                pause = float(after) if after.isdigit() else self.wait * 2 ** (self.tries - 1 - left)
            except (OSError, urllib.error.URLError):
                if not left:
                    raise
                pause = self.wait * 2 ** (self.tries - 1 - left)
            time.sleep(pause)
        return None

    def totals(self) -> dict[tuple[int, int], int]:
        listing = self.get("tables") or {}
        return {(int(t["congress"]), int(t["session"])): int(t["total"]) for t in listing.get("tables", [])}

    def entries(self, congress: int, session: int, offset: int) -> dict | None:
        """The page that begins at the offset; where none does, the rest of the page at the multiple of `page` before it, which may go on that far."""
        found, over = self.get("entries", congress=congress, session=session, offset=offset, limit=self.page), offset % self.page
        if found is None and over:
            before = self.get("entries", congress=congress, session=session, offset=offset - over, limit=self.page) or {}
            rest = (before.get("items") or [])[over:]
            return {"items": rest} if rest else None
        return found

    def marked(self, mark: str) -> dict | None:
        return self.get("marks", mark=mark, limit=self.page)


@dataclass
class Range(InputPartition):
    """Places start to stop (not included) of a table."""

    congress: int
    session: int
    start: int
    stop: int
    total: int


@dataclass
class Marked(InputPartition):
    """The items of one page of a chain, the first of which is at `place`."""

    mark: str


def ranges(totals: dict[tuple[int, int], int], page: int, pages: int, done: dict[tuple[int, int], int] | None = None) -> list[Range]:
    """Ranges of page * pages places; of tables read up to `done`, what is beyond."""
    step, done = page * pages, done or {}
    return [Range(c, s, at, min(at + step, n), n) for (c, s), n in sorted(totals.items()) for at in range(done.get((c, s), 0), n, step)]


def fitted(value: Any, kind: Any) -> Any:
    """A JSON value as a column's type; None for what it can't be."""
    if value is None:
        return None
    try:
        if isinstance(kind, (IntegerType, LongType, ShortType)):
            return int(value)
        if isinstance(kind, (DoubleType, FloatType)):
            return float(value)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else None
    except (TypeError, ValueError):
        return None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


class Rows:
    """Reads ranges and pages into rows; goes to the tasks."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.options = schema.fields[5:], options

    def row(self, congress: int | None, session: int | None, place: int | None, total: int | None, item: Any = None, error: str | None = None) -> tuple:
        known = item if isinstance(item, dict) else {}
        return (congress, session, place, total, error, *(fitted(known.get(f.name), f.dataType) for f in self.fields))

    def read(self, part: InputPartition | None) -> Iterator[tuple]:
        """Spark reads None where there are no partitions."""
        pages = Pages(self.options)
        if isinstance(part, Range):
            yield from self.of_range(pages, part)
        elif isinstance(part, Marked):
            page = pages.marked(part.mark) or {}
            for i, item in enumerate(page.get("items") or []):
                yield self.row(None, None, i, None, item)

    def of_range(self, pages: Pages, part: Range) -> Iterator[tuple]:
        at = part.start
        head = (part.congress, part.session)
        while at < part.stop:
            try:
                page = pages.entries(*head, at)
            except ValueError as e:
                yield self.row(*head, at, part.total, error=f"page at {at} is no JSON: {e}")
                return
            items = (page or {}).get("items") or []
            if not items:
                yield self.row(*head, at, part.total, error=f"page at {at} is {'missing' if page is None else 'empty'}")
                return
            for i, item in enumerate(items[: part.stop - at]):
                yield self.row(*head, at + i, part.total, item, None if isinstance(item, dict) else "no object")
            at += len(items)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.rows, self.options = Rows(schema, options), options

    def partitions(self) -> list[InputPartition]:
        pages = Pages(self.options)
        if self.options.get("walk") == "mark":
            return list(chain(pages, "*", last=True)[0])
        return ranges(pages.totals(), pages.page, int(self.options.get("pages", 10)))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows.read(partition)


def chain(pages: Pages, mark: str, stop: str | None = None, last: bool = False) -> tuple[list[Marked], str]:
    """The pages from a mark on, up to the mark `stop`, and the mark to go on from. `last`: with the page that names no next one."""
    found: list[Marked] = []
    while mark != stop and (page := pages.marked(mark)) is not None:
        following = page.get("next")
        if following or last:
            found.append(Marked(mark))
        if not following:
            break
        mark = following
    return found, mark


class PagedStream(DataSourceStreamReader):
    """Offsets are JSON: totals by table, or a mark. A batch is planned from its two offsets alone, so it is the same when it is run again."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.rows, self.options, self.pages = Rows(schema, options), options, Pages(options)
        self.marks, self.seen = options.get("walk") == "mark", "*"

    def initialOffset(self) -> dict:
        return {"mark": "*"} if self.marks else {}

    def latestOffset(self) -> dict:
        if self.marks:
            self.seen = chain(self.pages, self.seen)[1]
            return {"mark": self.seen}
        return {f"{c}-{s}": n for (c, s), n in self.pages.totals().items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.marks:
            return list(chain(self.pages, start["mark"], end["mark"])[0])
        tables = lambda x: {tuple(map(int, k.split("-"))): n for k, n in x.items()}
        return ranges(tables(end), self.pages.page, int(self.options.get("pages", 10)), tables(start))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows.read(partition)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return f"{HEAD}, {self.options['items']}"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(schema, dict(self.options))
