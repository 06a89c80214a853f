"""A folder of pages of events as a stream that is polled, a bounded number of lines at a time.

Pages are text files of one event a line. They arrive in the order of their names, and the last one may still grow; a
line counts once its line feed is there or a later page has arrived. The offset of the stream is the place after the
last line read, with the stamp of the last event that had one: the cursor a service of events would be asked with. It
follows the order of arrival, so stamps that go back and forth lose and repeat nothing.

A poll takes ``limit`` lines at most. Alone it is a batch, and its lines are read on the driver, as polling a service
does. With ``batch_bytes`` a batch takes as many polls as that many bytes hold: the driver looks only for the end of the
batch and its last stamp, and tasks poll ranges of the pages side by side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

FIRST_STAMP = "1970-01-01T00:00:00.000000"
SCHEMA = "value string, page string, place long"
# What is read of a page at once, and what a task polls of a batch.
BLOCK, RANGE = 1 << 16, 16 << 20


class _Pages:
    """The pages of a folder, through pyarrow's file systems: a local path, HDFS or an object store."""

    def __init__(self, folder: str):
        from pyarrow import fs

        if "://" in folder:
            self.store, self.root = fs.FileSystem.from_uri(folder)
        else:
            self.store, self.root = fs.LocalFileSystem(), folder.removeprefix("file:")

    def sizes(self, first: str) -> list[tuple[str, int]]:
        """Names and sizes from ``first`` on; hidden files and those of other tools are no pages."""
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name >= first and f.base_name[0] not in "._")

    def names(self, first: str) -> list[str]:
        return [name for name, _ in self.sizes(first)]

    def lines(self, page: str, place: int, whole: bool) -> Iterator[tuple[int, bytes, int]]:
        """(begin, line, end) from a byte on; a last line without its line feed only of a ``whole`` page."""
        with self.store.open_input_file(f"{self.root}/{page}") as file:
            file.seek(place)
            held = b""
            while True:
                part = file.read(BLOCK)
                held += part
                pieces = held.split(b"\n")
                for line in pieces[:-1]:
                    yield place, line, place + len(line) + 1
                    place += len(line) + 1
                held = pieces[-1]
                if not part:
                    break
            if held and whole:
                yield place, held, place + len(held)

    def lines_of(self, page: str, begin: int, end: int, inside: bool) -> Iterator[tuple[int, bytes, int]]:
        """Those that begin in a range of bytes. ``inside``: the range may begin within a line, which is not its own."""
        found = self.lines(page, begin - inside, True)
        if inside:
            next(found, None)  # the rest of that line, or the line feed before the range
        for place, line, after in found:
            if place >= end:
                return
            yield place, line, after

    def line_end(self, page: str, first: int, target: int, size: int, whole: bool) -> int:
        """The end of the line that reaches ``target``, where that line counts already; else that of the last one that does."""
        with self.store.open_input_file(f"{self.root}/{page}") as file:
            at = max(min(target, size), first + 1) - 1
            file.seek(at)
            while at < size and (part := file.read(min(BLOCK, size - at))):
                if b"\n" in part:
                    return at + part.index(b"\n") + 1
                at += len(part)
            if whole:
                return size
            high = max(min(target, size), first)
            while high > first:
                low = max(first, high - BLOCK)
                file.seek(low)
                if b"\n" in (part := file.read(high - low)):
                    return low + part.rindex(b"\n") + 1
                high = low
        return first


class PageReader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit

    def initialOffset(self) -> dict:
        return {"page": "", "place": 0, "stamp": FIRST_STAMP}

    def _from(self, start: dict) -> Iterator[tuple[str, int, bytes, int]]:
        pages = _Pages(self.folder)
        names = pages.names(start["page"])
        for i, page in enumerate(names):
            first = start["place"] if page == start["page"] else 0
            for place, line, end in pages.lines(page, first, i + 1 < len(names)):
                yield page, place, line, end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for page, place, line, after in self._from(start):
            if len(rows) == self.limit:
                break
            end |= {"page": page, "place": after}
            if line.strip():
                rows.append((line.decode("utf-8", "replace"), page, place))
                end["stamp"] = stamp_of(line) or end["stamp"]
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again after a failure: pages only ever grow at their end."""
        for page, place, line, after in self._from(start):
            if (page, after) > (end["page"], end["place"]):
                return
            if line.strip():
                yield line.decode("utf-8", "replace"), page, place

    def commit(self, end: dict) -> None:
        pass


class Ranges(InputPartition):
    """(page, begin, end, inside) of what a task polls, in the order of arrival."""

    def __init__(self, pieces: list[tuple[str, int, int, bool]]):
        self.pieces = pieces


class PageRangesReader(DataSourceStreamReader):
    """The same lines and offsets as ``PageReader``, many polls a batch."""

    def __init__(self, folder: str, limit: int, batch_bytes: int):
        self.folder, self.limit, self.batch_bytes = folder, limit, batch_bytes
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"page": "", "place": 0, "stamp": FIRST_STAMP}

    def latestOffset(self) -> dict:
        self.at = self.ahead(self.at or self.initialOffset())
        return self.at

    def ahead(self, start: dict) -> dict:
        """The end of the batch from ``start`` on, after a line."""
        pages, left, end, passed = _Pages(self.folder), self.batch_bytes, dict(start), []
        names = pages.sizes(start["page"])
        for i, (page, size) in enumerate(names):
            first = start["place"] if page == start["page"] else 0
            if left > 0 and size > first:
                after = pages.line_end(page, first, first + left, size, i + 1 < len(names))
                if after > first:
                    end |= {"page": page, "place": after}
                    passed.append((page, first, after))
                    left -= after - first
        return end | {"stamp": self._last_stamp(pages, passed) or start["stamp"]}

    def _last_stamp(self, pages: _Pages, passed: list[tuple[str, int, int]]) -> str | None:
        """Of the last event that has one, looked for from the end."""
        for page, first, high in reversed(passed):
            while high > first:
                low = max(first, high - BLOCK)
                for _, line, _ in reversed([*pages.lines_of(page, low, high, low > first)]):
                    if stamp := stamp_of(line):
                        return stamp
                high = low
        return None

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        if self.at is None:  # a restart plans the last batch of the checkpoint first
            self.at = end
        out, room = [], 0
        for page, size in _Pages(self.folder).sizes(start["page"]):
            first = start["place"] if page == start["page"] else 0
            last = end["place"] if page == end["page"] else size
            begin = first
            while page <= end["page"] and begin < last:
                if room <= 0:
                    out.append([])
                    room = RANGE
                after = min(last, begin + room)
                out[-1].append((page, begin, after, begin > first))
                room -= after - begin
                begin = after
        return [Ranges(pieces) for pieces in out]

    def read(self, partition: Ranges) -> Iterator:
        """A record batch a poll."""
        import pyarrow as pa

        pages, rows = _Pages(self.folder), []
        columns = {"value": pa.string(), "page": pa.string(), "place": pa.int64()}
        polled = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], [*columns])
        for page, begin, end, inside in partition.pieces:
            for place, line, _ in pages.lines_of(page, begin, end, inside):
                if line.strip():
                    rows.append((line.decode("utf-8", "replace"), page, place))
                if len(rows) == self.limit:
                    yield polled()
                    rows = []
        if rows:
            yield polled()

    def commit(self, end: dict) -> None:
        pass


def stamp_of(line: bytes) -> str | None:
    """The stamp of an event; lines that are no events have none."""
    try:
        event = json.loads(line)
    except ValueError:
        return None
    stamp = event.get("timestamp") if isinstance(event, dict) else None
    return str(stamp) if stamp else None


class PagedEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_events"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> PageReader:
        return PageReader(self.options["path"], int(self.options.get("limit", 1000)))


class PagedEventBatches(PagedEvents):
    @classmethod
    def name(cls) -> str:
        return "paged_event_batches"

    def streamReader(self, schema) -> PageRangesReader:
        return PageRangesReader(self.options["path"], int(self.options["limit"]), int(self.options["batch_bytes"]))


def read_pages(spark: SparkSession, folder: str, limit: int = 1000, batch_bytes: int | None = None) -> DataFrame:
    """Lines of the pages of ``folder`` as a stream, at most ``limit`` a poll; a batch is a poll, or with ``batch_bytes``
    as many as that many bytes hold, a line more at most."""
    source = PagedEvents if batch_bytes is None else PagedEventBatches
    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name()).option("path", folder).option("limit", limit)
    return (reader if batch_bytes is None else reader.option("batch_bytes", batch_bytes)).load()
