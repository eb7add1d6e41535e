"""COPY in binary form: a Python data source that reads and writes PGCOPY files.

A file has a signature, flags, an extension area and then rows: a count of
fields, each with its length (-1 for null) and bytes, big-endian; -1 as a count
ends it.  One task reads one file.  ``path`` must be a folder or file that every
executor can open.
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format.
SIGNATURE = b"PGCOPY\n\xff\r\n\x00"
EPOCH = dt.date(2000, 1, 1)

_FORMATS = {"smallint": ">h", "int": ">i", "bigint": ">q", "float": ">f", "double": ">d"}


def decode(kind: str, data: bytes) -> object:
    if kind in _FORMATS:
        return struct.unpack(_FORMATS[kind], data)[0]
    if kind == "boolean":
        return data == b"\x01"
    if kind == "date":
        return EPOCH + dt.timedelta(days=struct.unpack(">i", data)[0])
    if kind in ("timestamp", "timestamp_ntz"):
        return dt.datetime(2000, 1, 1) + dt.timedelta(microseconds=struct.unpack(">q", data)[0])
    if kind == "string":
        return data.decode()
    if kind == "binary":
        return data
    raise ValueError(f"COPY binary does not support type {kind}")


def encode(kind: str, value: object) -> bytes:
    if kind in _FORMATS:
        return struct.pack(_FORMATS[kind], value)
    if kind == "boolean":
        return b"\x01" if value else b"\x00"
    if kind == "date":
        return struct.pack(">i", (value - EPOCH).days)
    if kind in ("timestamp", "timestamp_ntz"):
        return struct.pack(">q", (value.replace(tzinfo=None) - dt.datetime(2000, 1, 1)) // dt.timedelta(microseconds=1))
    if kind == "string":
        return value.encode()
    if kind == "binary":
        return bytes(value)
    raise ValueError(f"COPY binary does not support type {kind}")


def rows_of(path: str, kinds: list[str]) -> Iterator[tuple]:
    with open(path, "rb") as f:
        if f.read(len(SIGNATURE)) != SIGNATURE:
            raise ValueError("COPY file signature not recognized")
        _, extra = struct.unpack(">iI", f.read(8))
        f.seek(extra, 1)
        while (n := struct.unpack(">h", f.read(2))[0]) >= 0:
            if n != len(kinds):
                raise ValueError(f"row field count is {n}, expected {len(kinds)}")
            row = []
            for kind in kinds:
                size = struct.unpack(">i", f.read(4))[0]
                row.append(None if size < 0 else decode(kind, f.read(size)))
            yield tuple(row)


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.kinds = [f.dataType.simpleString() for f in schema.fields]
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*.pgcopy"))) if os.path.isdir(self.path) else [self.path]
        return [File(f) for f in files]

    def read(self, partition: File) -> Iterator[tuple]:
        yield from rows_of(partition.path, self.kinds)


class _Writer(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.kinds = [f.dataType.simpleString() for f in schema.fields]
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        path = os.path.join(self.path, f"{uuid.uuid4().hex}.tmp")
        with open(path, "wb") as f:
            f.write(SIGNATURE + struct.pack(">iI", 0, 0))
            for row in rows:
                f.write(struct.pack(">h", len(self.kinds)))
                for kind, value in zip(self.kinds, row, strict=True):
                    data = b"" if value is None else encode(kind, value)
                    f.write(struct.pack(">i", -1 if value is None else len(data)) + data)
            f.write(struct.pack(">h", -1))
        return Written(path)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.path, m.path.removesuffix(".tmp") + ".pgcopy")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.unlink(m.path)


class CopyBinary(DataSource):
    """``spark.read.format("pgcopy").schema(...).load(path)`` and ``df.write.format("pgcopy").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "pgcopy"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("COPY binary appends; use a new folder")
        return _Writer(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CopyBinary)
