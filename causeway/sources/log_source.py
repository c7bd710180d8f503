"""Spark data source ``eventlog``: event logs as rows of schema.EVENTS, in batch and as a stream.

Options: ``path`` (a file or a glob), ``run_id`` (default: each file's name), ``magic`` (the four
characters with which the producer's logs begin; not looked at if not given), and ``mode``:

* ``FAILFAST`` (default): a bad header or frame is an error;
* ``PREFIX``: rows up to the first bad frame, though the header must be good;
* ``FOLLOW``: like PREFIX, and a missing file or an incomplete header gives no rows.

A batch reads each file as one partition, frame by frame. A stream is the FOLLOW mode for one
growing file: its offset is the number of bytes and frames read so far.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from causeway.schema import EVENTS
from causeway.sources.log_format import HEADER_BYTES, BadLog, Truncated, check_header, frames

NAME = "eventlog"
MODES = ("FAILFAST", "PREFIX", "FOLLOW")


class LogFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _row(run_id: str, seq: int, event: dict) -> tuple:
    full = {"run_id": run_id, "seq": seq, **event}
    return tuple(full.get(name) for name in EVENTS.fieldNames())


def _magic(options: dict) -> bytes | None:
    return options["magic"].encode() if options.get("magic") else None


def read_rows(path: str, run_id: str, mode: str, magic: bytes | None = None) -> Iterator[tuple]:
    """The rows of one file."""
    lossy = mode != "FAILFAST"
    if mode == "FOLLOW" and not os.path.exists(path):
        return
    with open(path, "rb") as stream:
        try:
            check_header(stream.read(HEADER_BYTES), magic)
        except Truncated:
            if mode == "FOLLOW":
                return
            raise
        try:
            for seq, (_, event) in enumerate(frames(stream)):
                yield _row(run_id, seq, event)
        except BadLog:
            if not lossy:
                raise


def truncated(path: str) -> bool:
    """Whether PREFIX would leave something out."""
    with open(path, "rb") as stream:
        check_header(stream.read(HEADER_BYTES))
        try:
            for _ in frames(stream):
                pass
        except BadLog:
            return True
    return False


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.mode = options.get("mode", MODES[0]).upper()
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")

    def partitions(self) -> list[LogFile]:
        found = sorted(glob.glob(self.options["path"]))
        if not found and self.mode != "FOLLOW":
            raise FileNotFoundError(self.options["path"])
        return [LogFile(p) for p in found]

    def read(self, partition: LogFile | None) -> Iterator[tuple]:
        if partition is None:  # no file
            return
        yield from read_rows(partition.path, self.options.get("run_id") or os.path.basename(partition.path), self.mode, _magic(self.options))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.run_id = options.get("run_id") or os.path.basename(self.path)
        self.magic = _magic(options)

    def initialOffset(self) -> dict:
        return {"bytes": 0, "frames": 0}

    def _from(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        rows, at, seq = [], start["bytes"], start["frames"]
        if os.path.exists(self.path):
            with open(self.path, "rb") as stream:
                try:
                    if at == 0:
                        check_header(stream.read(HEADER_BYTES), self.magic)
                        at = HEADER_BYTES
                    stream.seek(at)
                    for after, event in frames(stream, at):
                        if end is not None and after > end["bytes"]:
                            break
                        rows.append(_row(self.run_id, seq, event))
                        at, seq = after, seq + 1
                except Truncated:
                    pass
        return rows, {"bytes": at, "frames": seq}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._from(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._from(start, end)[0])


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return EVENTS

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)
