"""A streaming source for line files that grow: new bytes of each file once, whole lines only, through rotation and loss.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").option("path", "/logs/alerts.json*").load()

gives (value, path, position). The offset of a stream is, for each file identity, how far it has been read. A file is known by its identity
(device and inode for local files) and not by its name, so one that is renamed is read on under its new name, as long
as the pattern finds it, and a new file under the old name begins at 0. A file that is shorter than its position was cut in place:
it begins at 0 again. An end without a line break waits for the rest of its line; a line longer than any limit is read whole.

Option `bytes_per_task` cuts what is new into tasks, at line breaks. `attempts` and `pause` say how often, and with what pause (doubled
each time), a task asks for a file that is gone or fails; then the batch fails and is read again, from the same offsets, when the query
restarts. `transport` names a class (module:Class) with the two methods of LocalFiles, for files behind a connection that workers open
themselves. The files must be reachable under the same path from the driver and all executors.

Bytes that are not UTF-8 are replaced. Blank lines and carriage returns at line ends are dropped. No file, or an empty one, gives no rows.
"""

from __future__ import annotations

import glob
import importlib
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "value string, path string, position long"
STEP = 1 << 20


class LocalFiles:
    """Files that this machine opens."""

    def found(self, pattern: str) -> list[tuple[str, str, int]]:
        """(identity, path, size) of the files of a pattern."""
        out = []
        for path in sorted(glob.glob(pattern)):
            try:
                s = os.stat(path)
            except OSError:
                continue  # renamed or removed meanwhile: found under its new name next time, or gone
            out.append((f"{s.st_dev}:{s.st_ino}", path, s.st_size))
        return out

    def read(self, path: str, start: int, end: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(end - start)


def transport(options: dict) -> LocalFiles:
    name = options.get("transport")
    if not name:
        return LocalFiles()
    module, kind = name.split(":")
    return getattr(importlib.import_module(module), kind)()


@dataclass
class Range(InputPartition):
    identity: str
    path: str
    start: int
    end: int


class Lost(OSError):
    """A file was not found, or was shorter than what is due, after all attempts."""


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.pattern = options, options["path"]
        self.bytes_per_task = int(options.get("bytes_per_task", 64 << 20))
        self.attempts, self.pause = int(options.get("attempts", 3)), float(options.get("pause", 2))
        self.files = transport(options)
        self.known: dict | None = None  # the last offset this reader has seen

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _line_end(self, path: str, start: int, end: int) -> int:
        """The end of the last whole line in [start, end), or start."""
        at = end
        while at > start:
            low = max(start, at - STEP)
            cut = self.files.read(path, low, at).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
        return start

    def latestOffset(self) -> dict:  # noqa: N802
        """How far whole lines reach in each file; files that are gone keep their entry while another may bring them back."""
        offset = {k: dict(v) for k, v in (self.known or {}).items()}
        for identity, path, size in self.files.found(self.pattern):
            old = offset.get(identity, {"position": 0, "cuts": 0})
            start, cuts = (old["position"], old["cuts"]) if size >= old["position"] else (0, old["cuts"] + 1)
            try:
                offset[identity] = {"path": path, "position": self._line_end(path, start, size), "cuts": cuts}
            except OSError:
                if identity in offset:
                    continue
        self.known = offset
        return offset

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = end
        out = []
        for identity, to in sorted(end.items()):
            old = start.get(identity, {"position": 0, "cuts": 0})
            at = old["position"] if old["cuts"] == to["cuts"] else 0
            while at < to["position"]:
                # tasks are cut at bytes here, and where a task begins and ends at lines is for the task to see
                until = min(to["position"], at + self.bytes_per_task)
                out.append(Range(identity, to["path"], at, until))
                at = until
        return out

    def _now(self, part: Range) -> str:
        """The path that has the identity now."""
        for identity, path, size in self.files.found(self.pattern):
            if identity == part.identity and size >= part.end:
                return path
        raise Lost(f"{part.path} is gone or was cut")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        pause = self.pause
        for attempt in range(self.attempts):
            try:
                yield from self._read(self._now(partition), partition)
                return
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(pause)
                pause *= 2

    def _read(self, path: str, part: Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin in [start, end); a task whose start lies within a line leaves it to the one before."""
        start = part.start
        if start and self.files.read(path, start - 1, start) != b"\n":
            start = self._next_line(path, start)
        values, positions = [], []
        if start < part.end:
            data = self.files.read(path, start, part.end)
            while data and not data.endswith(b"\n"):
                more = self.files.read(path, start + len(data), start + len(data) + STEP)
                if not more:
                    break
                cut = more.find(b"\n")
                data += more[: cut + 1] if cut >= 0 else more
            at = start
            for line in data.split(b"\n")[:-1]:
                text = line.rstrip(b"\r")
                if text.strip():
                    values.append(text.decode("utf-8", "replace"))
                    positions.append(at)
                at += len(line) + 1
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([part.path] * len(values), pa.string()), pa.array(positions, pa.int64())], ["value", "path", "position"])

    def _next_line(self, path: str, at: int) -> int:
        while chunk := self.files.read(path, at, at + STEP):
            cut = chunk.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(chunk)
        return at

    def commit(self, end: dict) -> None:
        """Nothing to free: the files are not ours."""


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> GrowingReader:  # noqa: N802
        if "path" not in self.options:
            raise ValueError("option path: the file or pattern to follow")
        return GrowingReader(dict(self.options))
