"""Avro container files as a Python data source, for sessions without Spark's own Avro package.

Files are split at block boundaries; each partition decodes its blocks and makes only the columns asked for."""

from __future__ import annotations

import io
import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: its first bytes, and the Spark types of its primitive ones.
MAGIC = b"Obj\x01"
PRIMITIVES = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}


def open_file(path: str) -> Any:
    """A file for reading at random, on any store that Arrow reads."""
    import pyarrow.fs as fs

    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    store, inner = fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return store.open_input_file(inner)


def create_file(path: str) -> Any:
    """A file for writing from start to end, on any store that Arrow writes to."""
    import pyarrow.fs as fs

    if "://" not in path and not path.startswith("file:"):
        return open(path, "wb")
    store, inner = fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return store.open_output_stream(inner)


def files_of(path: str) -> list[str]:
    import pyarrow.fs as fs

    from .files import natural

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" not in path:
        if os.path.isdir(path):
            return sorted((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".avro")), key=natural)
        return [path]
    store, inner = fs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        scheme = path.split("://")[0]
        return sorted((f"{scheme}://{f.path}" for f in store.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".avro")), key=natural)
    return [path]


class Input:
    """Decoder of the binary encoding."""

    def __init__(self, stream: Any):
        self.stream = stream

    def take(self, n: int) -> bytes:
        out = self.stream.read(n)
        if len(out) < n:
            raise EOFError
        return out

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if not b & 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def value(self, s: Any) -> Any:
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, list):
            return self.value(kind[self.long()])
        if isinstance(kind, dict):
            return self.value(kind)
        if kind == "null":
            return None
        if kind == "boolean":
            return self.take(1) == b"\x01"
        if kind in ("int", "long"):
            return self.long()
        if kind == "float":
            return struct.unpack("<f", self.take(4))[0]
        if kind == "double":
            return struct.unpack("<d", self.take(8))[0]
        if kind == "bytes":
            return self.take(self.long())
        if kind == "string":
            return self.take(self.long()).decode()
        if kind == "fixed":
            return self.take(s["size"])
        if kind == "enum":
            return s["symbols"][self.long()]
        if kind == "record":
            return {f["name"]: self.value(f["type"]) for f in s["fields"]}
        if kind in ("array", "map"):
            out: list = []
            while n := self.long():
                if n < 0:
                    self.long()
                    n = -n
                for _ in range(n):
                    out.append(self.value(s["items"]) if kind == "array" else (self.take(self.long()).decode(), self.value(s["values"])))
            return out if kind == "array" else dict(out)
        raise ValueError(f"unknown type {kind!r}")


def resolved(s: Any, named: dict[str, Any] | None = None) -> Any:
    """The schema with references to named types filled in."""
    named = {} if named is None else named
    if isinstance(s, str):
        return named.get(s, s)
    if isinstance(s, list):
        return [resolved(x, named) for x in s]
    s = dict(s)
    if s["type"] in ("record", "enum", "fixed"):
        named[s["name"]] = s
    if s["type"] == "record":
        s["fields"] = [f | {"type": resolved(f["type"], named)} for f in s["fields"]]
    elif s["type"] == "array":
        s["items"] = resolved(s["items"], named)
    elif s["type"] == "map":
        s["values"] = resolved(s["values"], named)
    elif isinstance(s["type"], dict | list):
        return resolved(s["type"], named)
    return s


def spark_type(s: Any) -> T.DataType:
    kind = s["type"] if isinstance(s, dict) else s
    if isinstance(kind, list):
        rest = [x for x in kind if x != "null"]
        if len(rest) != 1:
            raise ValueError("unions of several types are not read")
        return spark_type(rest[0])
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in s["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(s["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(s["values"]))
    if kind == "enum":
        return T.StringType()
    if kind == "fixed":
        return T.BinaryType()
    return PRIMITIVES[kind]


def header(stream: Any) -> tuple[dict, str, bytes, int]:
    """Schema, codec, sync marker, and where the blocks begin."""
    if stream.read(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta = Input(stream).value({"type": "map", "values": "bytes"})
    sync = stream.read(16)
    return resolved(json.loads(meta["avro.schema"])), meta.get("avro.codec", b"null").decode(), sync, stream.tell()


def blocks(path: str) -> Iterator[tuple[int, int, int]]:
    """Offset of the data, bytes and rows of each block, by jumping over them."""
    with open_file(path) as stream:
        header(stream)
        source = Input(stream)
        while True:
            try:
                rows, size = source.long(), source.long()
            except EOFError:
                return
            at = stream.tell()
            yield at, size, rows
            stream.seek(at + size + 16)


class _Part(InputPartition):
    def __init__(self, path: str, parts: list[tuple[int, int, int]]):
        self.path, self.parts = path, parts


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, part_size: int):
        self.path, self.schema, self.part_size = path, schema, part_size

    def partitions(self) -> list[_Part]:
        out: list[_Part] = []
        for path in files_of(self.path):
            held, size = [], 0
            for b in blocks(path):
                if held and size + b[1] > self.part_size:
                    out.append(_Part(path, held))
                    held, size = [], 0
                held.append(b)
                size += b[1]
            if held:
                out.append(_Part(path, held))
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]

        def plain(v: Any) -> Any:
            if isinstance(v, dict):
                return {k: plain(x) for k, x in v.items()}
            return [plain(x) for x in v] if isinstance(v, list) else v

        if partition is None:  # files without blocks
            return
        with open_file(partition.path) as stream:
            schema, codec, _, _ = header(stream)
            for at, size, rows in partition.parts:
                stream.seek(at)
                data = stream.read(size)
                if codec == "deflate":
                    data = zlib.decompress(data, -15)
                elif codec != "null":
                    raise ValueError(f"codec {codec!r} is not read")
                source = Input(io.BytesIO(data))
                for _ in range(rows):
                    row = source.value(schema)
                    yield tuple(plain(row.get(n)) for n in names)


class AvroDataSource(DataSource):
    """Options: path, and part_size, the bytes of blocks that a partition gets at most (at least one block)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_avro"

    def schema(self) -> T.StructType:
        first = files_of(self.options["path"])
        if not first:
            raise ValueError(f"no .avro files in {self.options['path']}")
        with open_file(first[0]) as stream:
            return spark_type(header(stream)[0])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema, int(self.options.get("part_size", 128_000_000)))


def write_containers(df: DataFrame, path: str, schema: dict, codec: str = "null") -> None:
    """The rows as flat records in a folder, one container per partition, written where it is made."""
    from .files import Files

    target = Files(df.sparkSession, path)
    target.make()
    root = target.fs.makeQualified(target.root).toString()

    def write(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0

        def rows() -> Iterator[dict]:
            nonlocal n
            for b in batches:
                n += len(b)
                yield from b.to_pylist()

        write_container(f"{root}/{part}.avro", schema, rows(), codec)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    if not df.select(*(f["name"] for f in schema["fields"])).mapInArrow(write, "n long").groupBy().count().first()[0]:
        write_container(f"{root}/0.avro", schema, [], codec)


def write_container(path: str, schema: dict, rows: Iterable[dict], codec: str = "null", block_rows: int = 1000) -> None:
    """A container file of flat records, block by block."""

    def number(n: int) -> bytes:
        n = (n << 1) ^ (n >> 63)
        out = bytearray()
        while n & ~127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out + bytes([n]))

    def encode(s: Any, v: Any) -> bytes:
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, list):
            i = kind.index("null") if v is None else next(i for i, x in enumerate(kind) if x != "null")
            return number(i) + encode(kind[i], v)
        if kind == "array":
            return (number(len(v)) + b"".join(encode(s["items"], x) for x in v) if v else b"") + b"\x00"
        if kind == "null":
            return b""
        if kind in ("string", "bytes"):
            raw = v.encode() if kind == "string" else v
            return number(len(raw)) + raw
        return {"boolean": lambda: b"\x01" if v else b"\x00", "int": lambda: number(v), "long": lambda: number(v), "float": lambda: struct.pack("<f", v), "double": lambda: struct.pack("<d", v)}[kind]()

    sync = b"tessera-avro-syn"
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    with create_file(path) as out:
        out.write(MAGIC + number(len(meta)) + b"".join(number(len(k)) + k.encode() + number(len(v)) + v for k, v in meta.items()) + b"\x00" + sync)
        every = iter(rows)
        while part := list(itertools.islice(every, block_rows)):
            data = b"".join(encode(f["type"], r[f["name"]]) for r in part for f in schema["fields"])
            if codec == "deflate":
                squeeze = zlib.compressobj(wbits=-15)
                data = squeeze.compress(data) + squeeze.flush()
            out.write(number(len(part)) + number(len(data)) + data + sync)
