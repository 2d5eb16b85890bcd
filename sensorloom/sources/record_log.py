"""Record logs: a folder of appended records per partition, read as a stream by partition and offset.

    <path>/<partition>/<offset of its first record, 20 digits>.jsonl

A file's first line says how many records it has and when the last was appended; each other line is a record. Files are
never changed. The folder has to be one that driver and executors share.
"""

from __future__ import annotations

import base64
import json
import os
import time
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sensorloom import schemas

# Partitions of a log at most; an arrival number has that many values for a microsecond.
PARTITIONS = 1024


def log_arrival(moment: Column, partition: Column) -> Column:
    """An arrival number for records of logs. It is unique within a log: append times grow strictly in each partition."""
    return F.unix_micros(moment) * PARTITIONS + partition


def _text(value: bytes | None) -> str | None:
    return None if value is None else base64.b64encode(value).decode()


def _bytes(text: str | None) -> bytes | None:
    return None if text is None else base64.b64decode(text)


def _segments(folder: str) -> list[int]:
    """First offsets of a partition's files."""
    return sorted(int(name[:20]) for name in os.listdir(folder) if name.endswith(".jsonl") and name[:20].isdigit())


def _path(folder: str, first: int) -> str:
    return os.path.join(folder, f"{first:020d}.jsonl")


def _head(folder: str, first: int) -> dict:
    with open(_path(folder, first), encoding="ascii") as file:
        return json.loads(file.readline())


def _end(folder: str) -> tuple[int, int]:
    """(next offset, microseconds of the last append) of a partition."""
    firsts = _segments(folder) if os.path.isdir(folder) else []
    if not firsts:
        return 0, 0
    head = _head(folder, firsts[-1])
    return firsts[-1] + head["records"], head["last"]


def append_records(path: str, partition: int, records: Iterable[tuple], moment: datetime | None = None) -> int:
    """Append records (key, value, headers) to a partition of a log, all or none, and return the offset of the first.

    Several writers may append at once: a file's name is its first offset, and who comes second takes the next one.
    `moment` stands for the present time.
    """
    if not 0 <= partition < PARTITIONS:
        raise ValueError(f"a log has partitions 0 to {PARTITIONS - 1}")
    folder, held = os.path.join(path, str(partition)), list(records)
    os.makedirs(folder, exist_ok=True)
    if not held:
        return _end(folder)[0]
    draft = os.path.join(folder, f".{uuid.uuid4().hex}")
    while True:
        first, last = _end(folder)
        present = int(moment.replace(tzinfo=moment.tzinfo or timezone.utc).timestamp() * 1_000_000) if moment else time.time_ns() // 1000
        at = max(present, last + 1)
        with open(draft, "w", encoding="ascii") as file:
            file.write(json.dumps({"records": len(held), "last": at + len(held) - 1}) + "\n")
            for n, (key, value, headers) in enumerate(held):
                file.write(json.dumps([at + n, _text(key), _text(value), [[k, _text(v)] for k, v in headers or []]]) + "\n")
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(draft, _path(folder, first))  # fails if another writer has this offset
        except FileExistsError:
            continue
        finally:
            os.unlink(draft)
        return first


class Span(InputPartition):
    """Records [low, high) of one file."""

    def __init__(self, partition: int, first: int, low: int, high: int):
        self.partition, self.first, self.low, self.high = partition, first, low, high


class _Log:
    def __init__(self, options: dict):
        self.path = options["path"]

    def _partitions(self) -> list[int]:
        return sorted(int(name) for name in os.listdir(self.path) if name.isdigit()) if os.path.isdir(self.path) else []

    def _ends(self) -> dict[str, int]:
        return {str(p): _end(os.path.join(self.path, str(p)))[0] for p in self._partitions()}

    def _spans(self, start: dict[str, int], end: dict[str, int]) -> list[Span]:
        out = []
        for name, high in end.items():
            low = start.get(name, 0)
            firsts = _segments(os.path.join(self.path, name))
            for first, after in zip(firsts, [*firsts[1:], high]):
                if max(low, first) < min(high, after):
                    out.append(Span(int(name), first, max(low, first), min(high, after)))
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        folder = os.path.join(self.path, str(partition.partition))
        with open(_path(folder, partition.first), encoding="ascii") as file:
            file.readline()
            for offset, line in enumerate(file, partition.first):
                if offset >= partition.high:
                    return
                if offset >= partition.low:
                    at, key, value, headers = json.loads(line)
                    moment = datetime.fromtimestamp(at // 1_000_000, timezone.utc).replace(microsecond=at % 1_000_000)
                    yield _bytes(key), _bytes(value), [(k, _bytes(v)) for k, v in headers], moment, partition.partition, offset


class LogStream(_Log, DataSourceStreamReader):
    """Offsets are the next record of each partition; partitions may come while the stream runs."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self._spans(start, end)

    def commit(self, end: dict) -> None:
        pass


class LogTable(_Log, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self._spans({}, self._ends())


class RecordLog(DataSource):
    """The format `record_log` with the option `path`."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self):
        return schemas.RECORD

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)

    def reader(self, schema) -> LogTable:
        return LogTable(self.options)


def log_records(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """The records of a log, as a stream that goes on from its checkpoint, or all so far."""
    spark.dataSource.register(RecordLog)
    return (spark.readStream if stream else spark.read).format("record_log").option("path", path).load()
