"""Files of lines that grow, as a stream: offsets are a byte and an identity for each file, and only complete lines are read.

A batch ends behind the last line end of each file; what follows it waits. A file that was truncated, replaced, or
written anew in place is read from its start: its offset holds the file's identity (the inode, where the store has
one) and a checksum of the bytes before it, and either one that differs, or a file shorter than its offset, resets it.
Long stretches are cut into ranges, one a task; a range has the lines that begin in it. Spark keeps the offsets in the
stream's checkpoint, so a restarted stream goes on where its last batch ended, and a batch that runs again reads the
same ranges.

The driver lists the folder and reads a few kilobytes of each file's end, as for any file source; lines are read by
tasks. The folder is one that ``pyarrow.fs`` opens and that all executors share.
"""

from __future__ import annotations

import fnmatch
import os
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tracemill.functions.text import parsed_json

SCHEMA = "path string, at long, text string"
#: Bytes of a range, of a look back for a line's end, and of a checksum.
RANGE, LOOK, MARK = 64 << 20, 64 << 10, 256


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    first: bool


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str):
        self.folder, self.pattern = folder, pattern
        self.seen: dict[str, tuple[int, int]] = {}  # size and line end at the last look, so that a long open line isn't searched anew

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        store, root = _open(self.folder)
        found = {}
        for info in sorted(store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda i: i.path):
            if info.type == pafs.FileType.File and fnmatch.fnmatch(os.path.basename(info.path), self.pattern):
                try:
                    found[info.path] = self._state(store, info.path, info.size)
                except FileNotFoundError:
                    continue
        return {"files": found}

    def _state(self, store: pafs.FileSystem, path: str, size: int) -> list:
        identity = os.stat(path).st_ino if isinstance(store, pafs.LocalFileSystem) else 0
        with store.open_input_file(path) as f:
            end = self._line_end(f, size)
            return [identity, end, self._mark(f, end)]

    @staticmethod
    def _line_end(f: pa.NativeFile, size: int) -> int:
        at = size
        while at > 0:
            start = max(0, at - LOOK)
            f.seek(start)
            k = f.read(at - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            at = start
        return 0

    @staticmethod
    def _mark(f: pa.NativeFile, end: int) -> int:
        start = max(0, end - MARK)
        f.seek(start)
        return zlib.crc32(f.read(end - start))

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        store, _ = _open(self.folder)
        out = []
        for path, (identity, stop, _) in end["files"].items():
            begin = self._resume(store, path, start["files"].get(path), identity, stop)
            out += [Range(path, at, min(at + RANGE, stop), at == begin) for at in range(begin, stop, RANGE)]
        return out

    def _resume(self, store: pafs.FileSystem, path: str, before: list | None, identity: int, stop: int) -> int:
        if before is None or before[0] != identity or stop < before[1]:
            return 0
        try:
            with store.open_input_file(path) as f:
                return before[1] if self._mark(f, before[1]) == before[2] else 0
        except FileNotFoundError:
            return 0

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.folder)
        try:
            f = store.open_input_file(partition.path)
        except FileNotFoundError:
            return
        shape = pa.schema([("path", pa.string()), ("at", pa.int64()), ("text", pa.string())])
        with f:
            for rows in _lines(f, partition):
                at, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(at)), pa.array(at, pa.int64()), pa.array(text)], schema=shape)

    def commit(self, end: dict) -> None:
        pass


def _lines(f: pa.NativeFile, r: Range, block: int = 1 << 20) -> Iterator[list[tuple[int, str]]]:
    """Lists of place and text of the lines that begin in the range, blank ones aside; the last one may end behind it."""
    at = r.start - (not r.first)  # a line begins at the range's start if the byte before it ends one
    f.seek(at)
    rest, skip = b"", not r.first
    while at < r.end or rest:
        data = f.read(block)
        if not data:
            return
        lines = (rest + data).split(b"\n")
        rest = lines.pop()
        rows = []
        for line in lines:
            if at >= r.end:
                break
            if not skip and line.strip():
                rows.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
            skip = False
            at += len(line) + 1
        if rows:
            yield rows
        if at >= r.end:
            return


class Tail(DataSource):
    """Options: path, the folder; pattern, of the files' names."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("pattern", "*.jsonl"))


def tail(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """A stream of path, at (the line's first byte) and text, a row for each complete line that isn't blank."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's Python processes get no files of the application
    spark.dataSource.register(Tail)
    return spark.readStream.format("line_tail").option("pattern", pattern).load(folder)


def tail_json(spark: SparkSession, folder: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """The lines as records; those that aren't JSON are left out, not fatal."""
    lines = tail(spark, folder, pattern)
    return lines.where(parsed_json(F.col("text")).isNotNull()).select(F.from_json("text", schema).alias("x")).select("x.*")
