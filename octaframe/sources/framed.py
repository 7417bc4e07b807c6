"""format("framed"): files of independent frames with an index, read in parallel by frame and by predicate.

Writing takes rows (key string, data binary) and makes one file a partition:
frames of a method, one for each row, and beside it a Parquet file as the index,
with the place, key, sizes and CRC-32 of every frame, in chunks.  A manifest
lists what was committed: for each chunk its frames and the least and greatest
value of each column.  Reading plans a partition for each chunk that the
predicates leave, from the manifest alone; a partition reads its own chunk of
the index, and of the frames only those that the predicates leave.  Paths may
be of any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from ..catalog import Method, find, methods
from ..errors import corrupt
from ..functions.codec import decode_bytes, encode_bytes

SCHEMA = "key string, file string, frame_no long, c_off long, c_len long, d_len long, crc32 long, data binary"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
INDEXED = ["key", "frame_no", "c_off", "c_len", "d_len", "crc32"]
MANIFEST = "_frames.json"
#: Frames of a chunk.
CHUNK = 4096
TESTS = {
    IsNotNull: lambda v, f: True,
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    StringStartsWith: lambda v, f: v.startswith(f.value),
}
#: Whether values between lo and hi can meet a test.
CAN = {
    IsNotNull: lambda lo, hi, f: True,
    EqualTo: lambda lo, hi, f: lo <= f.value <= hi,
    In: lambda lo, hi, f: any(v is not None and lo <= v <= hi for v in f.value),
    GreaterThan: lambda lo, hi, f: hi > f.value,
    GreaterThanOrEqual: lambda lo, hi, f: hi >= f.value,
    LessThan: lambda lo, hi, f: lo < f.value,
    LessThanOrEqual: lambda lo, hi, f: lo <= f.value,
    StringStartsWith: lambda lo, hi, f: hi >= f.value and lo[: len(f.value)] <= f.value,
}


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("file://" + path if path.startswith("/") else path)


class _Part(WriterCommitMessage):
    def __init__(self, name: str, chunks: list[dict]):
        self.name, self.chunks = name, chunks


class FramedWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], options: dict, overwrite: bool, method: Method):
        self.path, self.columns, self.overwrite, self.method = path, columns, overwrite, method
        self.chunk = int(options.get("chunk", CHUNK))

    def write(self, iterator) -> _Part:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        name, at, no, rows, chunks = f"part-{uuid.uuid4().hex}", 0, 0, [], []
        k, d = self.columns.index("key"), self.columns.index("data")
        kinds = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in INDEXED[1:])])

        def flush(index: pq.ParquetWriter) -> None:
            columns = list(zip(*rows, strict=True))
            index.write_table(pa.table([pa.array(c, t.type) for c, t in zip(columns, kinds, strict=True)], schema=kinds), row_group_size=len(rows))
            ends = {}
            for c, values in zip(INDEXED, columns, strict=True):
                known = [v for v in values if v is not None]
                ends[c] = [min(known), max(known)] if known else None
            chunks.append({"file": name, "chunk": len(chunks), "frames": len(rows), "method": self.method.name, "ends": ends})
            rows.clear()

        with (
            system.open_output_stream(f"{root}/{name}.frames", compression=None) as out,
            system.open_output_stream(f"{root}/{name}.index", compression=None) as to,
            pq.ParquetWriter(to, kinds) as index,
        ):
            for row in iterator:
                plain = None if row[d] is None else bytes(row[d])
                frame = b"" if plain is None else encode_bytes(plain, self.method)
                out.write(frame)
                rows.append((row[k], no, at, len(frame), None if plain is None else len(plain), None if plain is None else zlib.crc32(plain)))
                at, no = at + len(frame), no + 1
                if len(rows) == self.chunk:
                    flush(index)
            if rows:
                flush(index)
        return _Part(name, chunks)

    def commit(self, messages) -> None:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        chunks = [c for m in messages if m is not None for c in m.chunks]
        if not self.overwrite and system.get_file_info(f"{root}/{MANIFEST}").is_file:
            with system.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
                chunks += json.loads(f.read())
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(chunks, key=lambda c: (c["file"], c["chunk"]))).encode())

    def abort(self, messages) -> None:
        system, root = open_path(self.path)
        for m in messages:
            for end in ("frames", "index") if m is not None else ():
                if system.get_file_info(f"{root}/{m.name}.{end}").is_file:
                    system.delete_file(f"{root}/{m.name}.{end}")


class _Chunk(InputPartition):
    def __init__(self, name: str, chunk: int, method: Method | None):
        super().__init__((name, chunk))
        self.name, self.chunk, self.method = name, chunk, method


class FramedReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], known: dict[str, Method]):
        self.path, self.columns, self.known = path, columns, known
        self.tests: list = []

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in TESTS and name in INDEXED:
                self.tests.append((name, type(f), f))
            else:
                yield f

    def _can(self, ends: dict) -> bool:
        return all(ends[c] is not None and CAN[kind](*ends[c], test) for c, kind, test in self.tests)

    def partitions(self) -> list[InputPartition]:
        system, root = open_path(self.path)
        with system.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
            chunks = json.loads(f.read())
        return [_Chunk(c["file"], c["chunk"], self.known.get(c["method"]) or find(c["method"])) for c in chunks if self._can(c["ends"])] or [_Chunk("", 0, None)]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        if not partition.name:
            return
        system, root = open_path(self.path)
        with system.open_input_file(f"{root}/{partition.name}.index") as f:
            index = pq.ParquetFile(f).read_row_group(partition.chunk).to_pylist()
        with system.open_input_file(f"{root}/{partition.name}.frames") as f:
            for row in index:
                if any(row[c] is None or not TESTS[kind](row[c], test) for c, kind, test in self.tests):
                    continue
                row |= {"file": partition.name, "data": None}
                if "data" in self.columns and row["d_len"] is not None:
                    f.seek(row["c_off"])
                    row["data"] = decode_bytes(f.read(row["c_len"]), partition.method)
                    if zlib.crc32(row["data"]) != row["crc32"]:
                        raise corrupt(f"frame {row['frame_no']} of {partition.name}")
                yield tuple(row[c] for c in self.columns)


class FramedDataSource(DataSource):
    """Options: path; method and chunk, the frames of an index chunk (writing)."""

    known: dict[str, Method] = {}

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramedReader:
        return FramedReader(self.options["path"], schema.names, self.known)

    def writer(self, schema, overwrite: bool) -> FramedWriter:
        options = {k.lower(): v for k, v in self.options.items()}
        name = options.get("method", "zstd")
        return FramedWriter(self.options["path"], schema.names, options, overwrite, self.known.get(name) or find(name))


def register(spark: SparkSession) -> None:
    """Make the source known, with the methods that are registered now: Spark plans it in processes of its own."""

    class Framed(FramedDataSource):
        known = {m.name: m for m in methods()}

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Framed)
