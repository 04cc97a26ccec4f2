"""Resumable stream of the lines of files that still grow, as a Spark data source.

    spark.dataSource.register(SensorLineSource)
    spark.readStream.format("sensor_lines").option("path", "/var/log/sensor/*.jsonl").load()

The offset of a stream is the read position in bytes of every file, so it is part of the
query's checkpoint.  Only whole lines are read: a half-written last line waits until its end is
there.  A file is known by its device and inode, so one that is renamed is read on and the
new file of its old name from the start, if the pattern matches both names.  A file that became
shorter or has another first line was cut and is read again from the start.  All machines
must see the files.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "raw string, source_file string, line_start bigint"
#: Bytes that one task reads; lines are not cut.
SLICE_BYTES = 64_000_000
_BLOCK = 1 << 20


class LineSlice(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def whole_lines_end(path: str, start: int, size: int) -> int:
    """Place after the last line end between two places, ``start`` if there is none."""
    with open(path, "rb") as file:
        at = size
        while at > start:
            low = max(start, at - _BLOCK)
            file.seek(low)
            found = file.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


def line_after(path: str, place: int, end: int) -> int:
    """Start of the first line at or after a place."""
    with open(path, "rb") as file:
        file.seek(place)
        while place < end:
            block = file.read(min(_BLOCK, end - place))
            if not block:
                break
            found = block.find(b"\n")
            if found >= 0:
                return place + found + 1
            place += len(block)
    return end


def first_line(path: str) -> str:
    """Digest of the first line, which tells a file from what it was before it was cut."""
    with open(path, "rb") as file:
        return hashlib.sha1(file.readline(4096)).hexdigest()


class SensorLineReader(DataSourceStreamReader):
    def __init__(self, pattern: str, slice_bytes: int):
        self.pattern, self.slice_bytes = pattern, slice_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Per file identity: path, digest of the first line and end of the last whole line."""
        now = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                state = os.stat(path)
                end = whole_lines_end(path, 0, state.st_size)
                head = first_line(path) if end else ""
            except FileNotFoundError:
                continue  # renamed since the listing; found under its new name next time
            now[f"{state.st_dev}:{state.st_ino}"] = {"path": path, "first": head, "end": end}
        return now

    def partitions(self, start: dict, end: dict) -> list[LineSlice]:
        slices = []
        for identity, to in end.items():
            begun = start.get(identity)
            same = begun is not None and begun["first"] == to["first"] and begun["end"] <= to["end"]
            low = begun["end"] if same else 0
            while low < to["end"]:
                high = min(low + self.slice_bytes, to["end"])
                high = line_after(to["path"], high - 1, to["end"]) if high < to["end"] else high
                slices.append(LineSlice(to["path"], low, high))
                low = high
        return slices

    def read(self, partition: LineSlice) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            file.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = file.readline()
                if not line:
                    break
                text = line.rstrip(b"\r\n").decode("utf-8", errors="replace")
                if text.strip():
                    yield text, partition.path, at
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class SensorLineSource(DataSource):
    """Options: ``path`` (a glob pattern) and ``sliceBytes``."""

    @classmethod
    def name(cls) -> str:
        return "sensor_lines"

    def schema(self) -> str | StructType:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SensorLineReader(self.options["path"], int(self.options.get("sliceBytes", SLICE_BYTES)))


def position(offset: str | dict) -> dict[str, int]:
    """Read position per path of an offset, for people."""
    held = json.loads(offset) if isinstance(offset, str) else offset
    return {entry["path"]: entry["end"] for entry in held.values()}
