"""A Spark data source for logs that are still being written: one line of JSON for a record, a file for a stretch of time.

``spark.read.format("landed_log").schema(...).load(folder)`` reads every ``*.ndjson``,
``*.json`` and ``*.txt`` below the folder, plain or packed (``.zst``, ``.gz``), a task a
file. A record ends with a newline, so what follows the last one is a record that is
half written: it is left out and read whole next time, and so is the end of a packed
file whose frame is open. A line that is ended and broken fails the job, with its file
and number. Empty lines count as lines but hold no record.

The fields of the schema are taken by name from each line's object: strings, whole and
floating numbers and booleans; a field that holds an object or list is given to a
string column as JSON. Missing ones are null. The columns ``file`` (below the folder) and
``line`` (from 1), where the schema asks for them, say where a record stands.

Pruning: a file's name or folder tells its time as ``20240115T09`` (an hour) or
``20240115``, ``2024-01-15`` or ``day=19737`` (a day); others may hold any time. The option
``since`` (nanoseconds) leaves out files that ended before it and, of the others, records
whose field ``clock`` (option, ``t_ingest`` by default) is below it. It is an
option, as Spark hands filters to such sources only where a setting allows it.

As a stream, files are read once their stretch of time is over, that is when one of a
later time is there; the offset is the end of the last stretch read. Files are opened by
pyarrow's file systems, so the folder may lie wherever these reach.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "landed_log"
SCHEMA = "seq long, stream string, t_ingest long, t_event long, payload string"
HOUR, DAY = 3600 * 10**9, 86400 * 10**9
NEVER = 1 << 63
ROWS = 10_000
CHUNK = 1 << 20
_NAME = re.compile(r"\.(ndjson|json|txt)(\.zst|\.gz)?$")
_STAMP = re.compile(r"(?<!\d)(\d{4})-?(\d\d)-?(\d\d)(?:T(\d\d))?(?!\d)")
_DAY = re.compile(r"(?:^|/)day=(\d+)(?:/|$)")


class BrokenLine(ValueError):
    """A line that is ended but is no record."""


def end_of(path: str) -> int:
    """The end, not included, of the time that a file's path tells; `NEVER` if it tells none."""
    folder, _, name = path.rpartition("/")
    for part in (name, folder):
        for found in reversed(list(_STAMP.finditer(part))):
            year, month, day, hour = found.groups()
            try:
                start = datetime(int(year), int(month), int(day), int(hour or 0), tzinfo=UTC)
            except ValueError:
                continue
            return int(start.timestamp()) * 10**9 + (HOUR if hour else DAY)
    found = _DAY.search(folder)
    return (int(found[1]) + 1) * DAY if found else NEVER


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's file system and its path there; ``file:/x`` is a spelling of ``file:///x``."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder.rstrip("/")
    files, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return files, path.rstrip("/")


def listed(folder: str) -> list[str]:
    """The log's files, as paths below the folder, in the order of their names."""
    files, top = _opened(folder)
    found = [f.path for f in files.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file]
    below = sorted(p[len(top) + 1 :] for p in found)
    return [p for p in below if _NAME.search(p) and not any(part.startswith(("_", ".")) for part in p.split("/"))]


def _chunks(raw, path: str) -> Iterator[bytes]:
    """A file's bytes, unpacked, as far as they are there."""
    if path.endswith(".zst"):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
        read, unfinished = raw.read1, (zstandard.ZstdError,)
    elif path.endswith(".gz"):
        import gzip

        read, unfinished = gzip.GzipFile(fileobj=raw).read1, (EOFError,)
    else:
        read, unfinished = raw.read, ()
    while True:
        try:
            chunk = read(CHUNK)
        except unfinished:
            return
        if not chunk:
            return
        yield chunk


def lines_of(raw: io.RawIOBase, path: str) -> Iterator[tuple[int, bytes]]:
    """The ended lines of a file that are not empty, numbered from 1; one chunk and one line are held at once."""
    number, pieces = 0, []
    for chunk in _chunks(raw, path):
        first, *more = chunk.split(b"\n")
        pieces.append(first)
        for part in more:
            number += 1
            line = b"".join(pieces)
            if line.strip():
                yield number, line
            pieces = [part]


@dataclass
class LogFile(InputPartition):
    path: str


def _field(value, kind: pa.DataType):
    if value is None:
        return None
    if pa.types.is_string(kind) and not isinstance(value, str):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    if pa.types.is_floating(kind) and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


class _Reading:
    """What batch and stream share: the options, and the records of a file."""

    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.folder = options["path"]
        self.arrow = to_arrow_schema(schema)
        self.clock = options.get("clock", "t_ingest")
        self.since = int(options["since"]) if options.get("since") is not None else None

    def records(self, path: str) -> Iterator[pa.RecordBatch]:
        files, top = _opened(self.folder)
        rows: list[list] = []
        with files.open_input_stream(f"{top}/{path}", compression=None) as raw:
            for number, line in lines_of(raw, path):
                try:
                    found = json.loads(line)
                    if not isinstance(found, dict):
                        raise ValueError("not an object")
                    if self.since is not None and not (found.get(self.clock) is not None and found[self.clock] >= self.since):
                        continue
                    at = {"file": path, "line": number}
                    rows.append([_field(at[f.name] if f.name in at and f.name not in found else found.get(f.name), f.type) for f in self.arrow])
                except (ValueError, TypeError) as error:
                    raise BrokenLine(f"{path}, line {number}: {error}") from error
                if len(rows) == ROWS:
                    yield self.batch(rows, path)
                    rows = []
        if rows:
            yield self.batch(rows, path)

    def batch(self, rows: list[list], path: str) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if len(self.arrow) else []
        try:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.arrow, strict=True)], schema=self.arrow)
        except (pa.ArrowInvalid, pa.ArrowTypeError) as error:
            raise BrokenLine(f"{path}: a field does not have its column's type: {error}") from error


class LogReader(_Reading, DataSourceReader):
    def partitions(self) -> list[LogFile]:
        return [LogFile(p) for p in listed(self.folder) if self.since is None or end_of(p) > self.since]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Of a log without files Spark reads one partition that is none of ours."""
        return self.records(partition.path) if isinstance(partition, LogFile) else iter(())


class LogStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"until": self.since or 0}

    def latestOffset(self) -> dict:
        """The end of the last stretch of time that a later one follows."""
        ends = sorted({end_of(p) for p in listed(self.folder)} - {NEVER})
        return {"until": max(ends[-2] if len(ends) > 1 else 0, self.since or 0)}

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        return [LogFile(p) for p in listed(self.folder) if start["until"] < end_of(p) <= end["until"]]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        return self.records(partition.path)


class LandedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(schema, self.options)

    def streamReader(self, schema: StructType) -> LogStream:
        return LogStream(schema, self.options)


def read_log(spark: SparkSession, folder: str, schema: str = SCHEMA, since: int | None = None, clock: str = "t_ingest") -> DataFrame:
    """The records of a log, from a time on where ``since`` is given."""
    spark.dataSource.register(LandedLog)
    reading = spark.read.format(FORMAT).schema(schema).option("clock", clock)
    return (reading if since is None else reading.option("since", str(since))).load(folder)


def stream_log(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """The records of a log as its stretches of time end."""
    spark.dataSource.register(LandedLog)
    return spark.readStream.format(FORMAT).schema(schema).load(folder)
