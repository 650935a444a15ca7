"""Growing logs as streams: lines appended to a file that was read before arrive, too.

An offset holds, for each file of a folder, the byte up to which it has been read, always the end of a line, so a line
that is still being written waits for its end. Spark's checkpoint keeps the offsets: a restarted stream goes
on at the byte where its last batch ended, and each line is read once. Large files are read in ranges by
many tasks; a line belongs to the range that it starts in.

The folder may be on any store that ``pyarrow.fs`` reads. Defined cases: names that start with a dot or an underscore
aren't read; a file that is gone is left out; a file that has become shorter than what was read is an error, since rotated logs need
names of their own; a carriage return before the line end goes; bytes that aren't UTF-8 are replaced; empty lines are lines.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
SCHEMA = "file string, offset long, value string"
#: Bytes that are read at once in search of a line's end.
BLOCK = 1 << 16


def opened(path: str) -> tuple[stores.FileSystem, str]:
    if path.startswith("file:"):
        return stores.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return stores.FileSystem.from_uri(path)
    return stores.LocalFileSystem(), path


@dataclass
class Range(InputPartition):
    """Lines of ``file`` that start at ``begin`` or later and before ``end``; ``low`` and ``high``
    are ends of lines."""

    file: str
    low: int
    begin: int
    end: int
    high: int

    def __post_init__(self) -> None:
        super().__init__(None)


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.names = options["path"], options.get("names", "*")
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.until = int(options["until"]) if "until" in options else None
        self.seen: dict[str, tuple[int, int]] = {}  # size of a file, and the end of its last whole line

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, folder = opened(self.folder)
        ends = {}
        for info in store.get_file_info(stores.FileSelector(folder, allow_not_found=True)):
            name = info.base_name
            if info.type != stores.FileType.File or name[0] in "._" or not fnmatch.fnmatch(name, self.names):
                continue
            size = info.size if self.until is None else min(info.size, self.until)
            known, end = self.seen.get(name, (0, 0))
            if size != known:
                end = last_line_end(store, f"{folder}/{name}", size, end if size > known else 0)
                self.seen[name] = size, end
            ends[name] = end
        return ends

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, high in sorted(end.items()):
            low = start.get(name, 0)
            if high < low:
                raise ValueError(f"{name} has {high} bytes of whole lines; {low} had been read")
            out += [Range(name, low, at, min(at + self.range_bytes, high), high) for at in range(low, high, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, folder = opened(self.folder)
        with store.open_input_file(f"{folder}/{partition.file}") as file:
            at, data = partition.begin, b""
            if at > partition.low:  # the line that this byte is in is another range's, unless it starts here
                at, data = first_line_start(file, at, partition.high)
            if at >= partition.end:
                return
            data += file.read_at(partition.end - at - len(data), at + len(data)) if partition.end > at + len(data) else b""
            while not data[partition.end - at - 1 :].endswith(b"\n") and at + len(data) < partition.high:
                more = file.read_at(min(BLOCK, partition.high - at - len(data)), at + len(data))
                data += more[: more.find(b"\n") + 1] if b"\n" in more else more
        cut = data.find(b"\n", partition.end - at - 1) + 1
        lines = data[: cut or len(data)].split(b"\n")[:-1]
        for begin in range(0, len(lines), 10_000):
            part = lines[begin : begin + 10_000]
            offsets = [at]
            for line in part:
                offsets.append(offsets[-1] + len(line) + 1)
            at = offsets.pop()
            texts = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in part]
            yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(part)), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], ["file", "offset", "value"])


def last_line_end(store: stores.FileSystem, path: str, size: int, low: int) -> int:
    """Where the last whole line of the first ``size`` bytes ends; ``low`` if none ends after it."""
    with store.open_input_file(path) as file:
        high = size
        while high > low:
            begin = max(low, high - BLOCK)
            found = file.read_at(high - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            high = begin
    return low


def first_line_start(file: pa.NativeFile, at: int, high: int) -> tuple[int, bytes]:
    """The first line start at ``at`` or later, and the bytes after it that have been read."""
    at -= 1
    while at < high:
        data = file.read_at(min(BLOCK, high - at), at)
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1, data[found + 1 :]
        at += len(data)
    return high, b""


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(self.options)


def lines(spark: SparkSession, folder: str, names: str = "*", range_bytes: int = 32 << 20, until: int | None = None) -> DataFrame:
    """(file, offset, value) of the lines of ``folder`` as they are written. ``until``: read no
    file past this byte."""
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format(FORMAT).option("path", folder).option("names", names).option("rangeBytes", range_bytes)
    return (reader if until is None else reader.option("until", until)).load()
