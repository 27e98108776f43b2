"""Arrow files on disk, streams or with a footer: record batches are indexed, then read by tasks of about equal bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of record batches that a task reads.
TASK_BYTES = 64 << 20
_MAGIC = b"ARROW1"
#: Message kinds of the streaming format: fixed values.
_DICTIONARY, _BATCH = 2, 3
INDEX = "path string, place int, at long, size long, head binary"


def _open(path: str) -> pa.NativeFile:
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def _message(metadata: bytes) -> tuple[int, int]:
    """(kind, bytes of the body) of a message's metadata, a flatbuffer table whose second and fourth fields these are."""
    (table,) = struct.unpack_from("<I", metadata, 0)
    vtable = table - struct.unpack_from("<i", metadata, table)[0]
    size = struct.unpack_from("<H", metadata, vtable)[0]
    field = lambda i: struct.unpack_from("<H", metadata, vtable + 4 + 2 * i)[0] if 4 + 2 * i < size else 0
    kind = metadata[table + field(1)] if field(1) else 0
    return kind, struct.unpack_from("<q", metadata, table + field(3))[0] if field(3) else 0


def messages(source: pa.NativeFile) -> Iterator[tuple[int, int, int]]:
    """(kind, offset, bytes) of a stream's messages; bodies are skipped, not read."""
    at, end = 0, source.size()
    while at + 8 <= end:
        mark, size = struct.unpack("<Ii", source.read_at(8, at))
        head = 8
        if mark != 0xFFFFFFFF:  # streams of old writers have no mark
            size, head = mark, 4
        if size == 0:
            return
        kind, body = _message(source.read_at(size, at + head))
        yield kind, at, head + size + body
        at += head + size + body


def index(paths: DataFrame) -> DataFrame:
    """A row for each record batch of paths (path): its place, for a stream its offset, bytes and what stands before all
    batches (schema and dictionaries); for a file with a footer just its number. One task reads a file's headers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _open(path) as source:
                    if source.size() >= 6 and source.read_at(6, 0) == _MAGIC:
                        rows = [(path, i, None, None, None) for i in range(pa.ipc.open_file(source).num_record_batches)]
                    else:
                        head = b""
                        for n, (kind, at, size) in enumerate(messages(source)):
                            if kind == _BATCH:
                                rows.append((path, len(rows), at, size, head))
                            elif n == 0 or kind == _DICTIONARY:
                                head += source.read_at(size, at)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    names, kinds = ["path", "place", "at", "size", "head"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return paths.select("path").mapInArrow(scan, INDEX)


def read_batches(spark: SparkSession, files: list[tuple[str, int]], schema: StructType, task_bytes: int = TASK_BYTES, place: bool = False) -> DataFrame:
    """Rows of Arrow files (path, bytes): the schema's columns alone are decoded, columns that a file lacks are null.

    Batches are dealt over as many tasks as their bytes ask for and passed on as Arrow. With place, the columns __path,
    __batch and __row tell where a row stands.
    """
    wanted = to_arrow_schema(schema)
    extra = [("__path", pa.string()), ("__batch", pa.int32()), ("__row", pa.int64())] if place else []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as source:
                    if row["at"] is None:
                        names = pa.ipc.open_file(source).schema.names
                        keep = pa.ipc.IpcReadOptions(included_fields=[i for i, n in enumerate(names) if n in wanted.names])
                        found = pa.ipc.open_file(source, options=keep).get_batch(row["place"])
                    else:
                        names = pa.ipc.open_stream(row["head"]).schema.names
                        keep = pa.ipc.IpcReadOptions(included_fields=[i for i, n in enumerate(names) if n in wanted.names])
                        found = pa.ipc.open_stream(row["head"] + source.read_at(row["size"], row["at"]), options=keep).read_next_batch()
                columns = [found.column(f.name).cast(f.type) if f.name in found.schema.names else pa.nulls(found.num_rows, f.type) for f in wanted]
                if place:
                    columns += [pa.array([row["path"]] * found.num_rows, pa.string()), pa.array([row["place"]] * found.num_rows, pa.int32()), pa.array(range(found.num_rows), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*wanted.names, *(n for n, _ in extra)])

    paths = spark.createDataFrame([(p,) for p, _ in files], "path string").repartition(max(1, len(files)))
    tasks = max(1, -(-sum(n for _, n in files) // task_bytes))
    found = index(paths).repartition(tasks, "path", "place")
    whole = StructType([*schema.fields, *(spark.createDataFrame([], "__path string, __batch int, __row long").schema.fields if place else [])])
    return found.mapInArrow(read, whole)
