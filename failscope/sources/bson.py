"""BSON run documents as a Python Data Source: `spark.read.format("bson").load(path)`.

One partition a file; files are read in chunks, document by document, so a task holds one document.
Each row has the document as JSON text (`doc`), its file and its ordinal. Keys that are absent stay
absent in the JSON, so that an absent key and a null can be told apart later.
"""

from __future__ import annotations

import glob
import json
import os
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc string, source_file string, ordinal bigint"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Cursor:
    """A position in a document's bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("document ends inside a value")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def number(self, form: str):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def name(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out

    def text(self) -> str:
        return self.take(self.number("i"))[:-1].decode("utf-8", "replace")


def _array(c: Cursor) -> list:
    """Elements by numeric key, other keys last."""
    items = document(c).items()
    return [v for _, v in sorted(items, key=lambda kv: (not kv[0].isdigit(), int(kv[0]) if kv[0].isdigit() else 0))]


def _binary(c: Cursor) -> dict:
    size, kind = c.number("i"), c.number("B")
    c.take(size)
    return {"$binary": kind, "size": size}


def _moment(c: Cursor) -> str:
    return (_EPOCH + timedelta(milliseconds=c.number("q"))).isoformat()


#: element type -> reader of its value; what isn't here is an error
READERS = {
    0x01: lambda c: c.number("d"), 0x02: Cursor.text, 0x03: lambda c: document(c), 0x04: _array, 0x05: _binary, 0x07: lambda c: c.take(12).hex(),
    0x08: lambda c: c.number("B") == 1, 0x09: _moment, 0x0A: lambda c: None, 0x0B: lambda c: {"$regex": c.name(), "options": c.name()},
    0x10: lambda c: c.number("i"), 0x11: lambda c: {"i": c.number("I"), "$timestamp": c.number("I")}, 0x12: lambda c: c.number("q"), 0x13: lambda c: c.take(16).hex(),
}


def document(c: Cursor) -> dict:
    end = c.at + c.number("i")
    out = {}
    while (kind := c.number("B")) != 0:
        if kind not in READERS:
            raise ValueError(f"unknown element type 0x{kind:02x}")
        key = c.name()
        out[key] = READERS[kind](c)
    if c.at != end:
        raise ValueError("document length doesn't hold")
    return out


def documents(path: str) -> Iterator[dict]:
    """The documents of a file, one after the other."""
    with open(path, "rb") as f:
        while head := f.read(4):
            if len(head) < 4:
                raise ValueError(f"{path}: ends inside a length")
            (n,) = struct.unpack("<i", head)
            body = f.read(n - 4)
            if len(body) < n - 4:
                raise ValueError(f"{path}: ends inside a document")
            yield document(Cursor(head + body))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        for i, doc in enumerate(documents(partition.value)):
            yield json.dumps(doc, ensure_ascii=False, default=str), os.path.basename(partition.value), i


class BsonSource(DataSource):
    """format("bson"): option path is a file, a folder or a glob; option missing=ignore tolerates absent files."""

    @classmethod
    def name(cls) -> str:
        return "bson"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths: list[str] = []
        for p in self.options["path"].split(","):
            found = sorted(glob.glob(os.path.join(p, "*.bson") if os.path.isdir(p) else p))
            if not found and self.options.get("missing", "fail") != "ignore":
                raise FileNotFoundError(p)
            paths += found
        return _Reader(paths)


def read_bson(spark: SparkSession, *paths: str, missing: str = "fail") -> DataFrame:
    spark.dataSource.register(BsonSource)
    return spark.read.format("bson").option("missing", missing).load(",".join(paths))


def encode(value, name: str | None = None) -> bytes:
    """BSON of Python values (documents, lists, texts, numbers, booleans, null), for tests and exports."""
    if isinstance(value, bool):
        kind, body = 0x08, bytes([value])
    elif value is None:
        kind, body = 0x0A, b""
    elif isinstance(value, int):
        kind, body = 0x12, struct.pack("<q", value)
    elif isinstance(value, float):
        kind, body = 0x01, struct.pack("<d", value)
    elif isinstance(value, str):
        raw = value.encode() + b"\0"
        kind, body = 0x02, struct.pack("<i", len(raw)) + raw
    elif isinstance(value, (dict, list)):
        items = value.items() if isinstance(value, dict) else ((str(i), x) for i, x in enumerate(value))
        inner = b"".join(encode(x, k) for k, x in items)
        kind, body = 0x03 if isinstance(value, dict) else 0x04, struct.pack("<i", len(inner) + 5) + inner + b"\0"
    else:
        raise TypeError(type(value))
    return body if name is None else bytes([kind]) + name.encode() + b"\0" + body
