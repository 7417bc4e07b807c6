"""format("seekable"): Zstandard files with a seek table, read by frame through their footers.

A file is planned by its size alone, in ranges of compressed bytes; the task of
a range reads the footer and the seek table and takes the frames that begin in
it.  Predicates on places and sizes, and the options ``offset`` and ``length``,
are held against the table, so that other frames are neither read nor decoded.
Files without a table are walked frame by frame by one task.

Writing takes rows (path string, data binary) and streams them: consecutive
rows of a path in a partition are one file, in frames of ``frameSize`` bytes.
Paths may be of any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..catalog import find
from ..codecs import zstds
from ..codecs.checksums import xxh64
from ..errors import corrupt
from .framed import TESTS, open_path

SCHEMA = "path string, frame_no long, c_off long, c_len long, d_off long, d_len long, checksum long, data binary"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
MANIFEST = "_seekable.json"
SPLIT_BYTES = 64 << 20


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class SeekableWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], options: dict, overwrite: bool):
        self.path, self.columns, self.overwrite = path, columns, overwrite
        self.size = int(options.get("framesize", 1 << 20))
        method = find("zstd")
        self.encode, self.options = method.encode, method.validated({"zstd.level": int(options.get("level", 3))})

    def write(self, iterator) -> _Written:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        key, value, files = self.columns.index("path"), self.columns.index("data"), []
        out, now, held, rows = None, None, bytearray(), []

        def frame(data: bytes) -> None:
            packed = self.encode(data, self.options)
            out.write(packed)
            rows.append((len(packed), len(data), xxh64(data) & 0xFFFFFFFF))

        def end() -> None:
            if out is not None:
                if held:
                    frame(bytes(held))
                out.write(zstds.seek_table(rows, True))
                out.close()

        for row in iterator:
            if out is None or row[key] != now:
                end()
                now, held, rows = row[key], bytearray(), []
                files.append((now, f"part-{uuid.uuid4().hex}.zst"))
                out = system.open_output_stream(f"{root}/{files[-1][1]}", compression=None)
            held += bytes(row[value] or b"")
            while len(held) >= self.size:
                frame(bytes(held[: self.size]))
                del held[: self.size]
        end()
        return _Written(files)

    def commit(self, messages) -> None:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        files = [list(f) for m in messages if m is not None for f in m.files]
        if not self.overwrite and system.get_file_info(f"{root}/{MANIFEST}").is_file:
            with system.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
                files += json.loads(f.read())
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(files, key=str)).encode())

    def abort(self, messages) -> None:
        system, root = open_path(self.path)
        for m in messages:
            for _, name in m.files if m is not None else ():
                if system.get_file_info(f"{root}/{name}").is_file:
                    system.delete_file(f"{root}/{name}")


class _Ranges(InputPartition):
    """Ranges (file, path to tell, first byte, last byte + 1) of compressed bytes."""

    def __init__(self, ranges: list[tuple[str, str | None, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


def read_table(f, size: int) -> list[tuple[int, int, int | None]] | None:
    """The seek table of an open file by two ranged reads; None if there is none."""
    if size < 17:
        return None
    f.seek(size - 9)
    tail = f.read(9)
    if int.from_bytes(tail[5:], "little") != zstds.FOOTER:
        return None
    total = int.from_bytes(tail[:4], "little") * (12 if tail[4] & 128 else 8) + 17
    if total > size:
        raise corrupt("seek table size")
    f.seek(size - total)
    return zstds.read_seek_table(f.read(total), size - total)


class SeekableReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], options: dict):
        self.path, self.columns = path, columns
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.first = int(options.get("offset", 0))
        self.last = self.first + int(options["length"]) if "length" in options else None
        self.tests: list = []
        method = find("zstd")
        self.decode, self.options = method.decode, method.validated({})

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in TESTS and name in COLUMNS and name != "data":
                self.tests.append((COLUMNS.index(name), type(f), f))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = open_path(self.path)
        if system.get_file_info(root).is_file:
            found = [(system.get_file_info(root), root)]
        elif system.get_file_info(f"{root}/{MANIFEST}").is_file:
            with system.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
                named = {f"{root}/{name}": path for path, name in json.loads(f.read())}
            have = {x.path: x for x in system.get_file_info(pafs.FileSelector(root))}
            if missing := [n for n in named if n not in have]:
                raise ValueError(f"files listed in the manifest are missing: {len(missing)}")
            found = [(have[n], path) for n, path in named.items()]
        else:
            found = [(x, x.path) for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith(".zst")]
        plan, held, bytes_ = [], [], 0
        for x, path in sorted(found, key=lambda y: y[0].path):
            if x.size > self.split:
                plan += [_Ranges([(x.path, path, at, min(x.size, at + self.split))]) for at in range(0, x.size, self.split)]
                continue
            if held and bytes_ + x.size > self.split:
                plan, held, bytes_ = [*plan, _Ranges(held)], [], 0
            held, bytes_ = [*held, (x.path, path, 0, x.size)], bytes_ + x.size
        return [*plan, *([_Ranges(held)] if held else [])] or [_Ranges([])]

    def _frames(self, f, first: int, last: int) -> Iterator[tuple]:
        """(number, place and size packed, place and size plain, checksum) of the frames that begin in the range."""
        size = f.size()
        table = read_table(f, size)
        if table is None:
            if first == 0:
                f.seek(0)
                plain = 0
                whole = f.read(size)
                for n, (_, at, held, _, _) in enumerate(e for e in zstds.walk(whole) if e[0] == "frame"):
                    content = zstds.frame_header(whole, at)["content_size"]
                    if content is None:
                        content = len(self.decode(whole[at : at + held], self.options))
                    yield n, at, held, plain, content, None
                    plain += content
            return
        at = plain = 0
        for n, (packed, content, checksum) in enumerate(table):
            if first <= at < last:
                yield n, at, packed, plain, content, checksum
            at, plain = at + packed, plain + content

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        system, _ = open_path(self.path)
        for name, path, first, last in partition.ranges:
            with system.open_input_file(name) as f:
                for n, at, packed, plain, content, checksum in self._frames(f, first, last):
                    row = [path, n, at, packed, plain, content, checksum, None]
                    if plain + content <= self.first or (self.last is not None and plain >= self.last):
                        continue
                    if any(row[i] is None or not TESTS[kind](row[i], test) for i, kind, test in self.tests):
                        continue
                    if "data" in self.columns:
                        f.seek(at)
                        row[7] = self.decode(f.read(packed), self.options)
                        if len(row[7]) != content or (checksum is not None and xxh64(row[7]) & 0xFFFFFFFF != checksum):
                            raise corrupt(f"frame {n} of {name}")
                    yield tuple(row[COLUMNS.index(c)] for c in self.columns)


class SeekableDataSource(DataSource):
    """Options: path; frameSize, level (writing); offset, length, splitBytes (reading)."""

    @classmethod
    def name(cls) -> str:
        return "seekable"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SeekableReader:
        return SeekableReader(self.options["path"], schema.names, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> SeekableWriter:
        return SeekableWriter(self.options["path"], schema.names, {k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeekableDataSource)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """A scan of the frames at path, to be filtered once (Spark keeps what it pushed down with the loaded source)."""
    register(spark)
    return spark.read.format("seekable").options(**{k: str(v) for k, v in options.items()}).load(path)


def range_read(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """path, data: the plain bytes from offset on of each file, at most length; files that end before have no row."""
    frames = load(spark, path, offset=offset, length=length)
    skip = F.greatest(F.lit(offset) - F.col("d_off"), F.lit(0))
    size = F.least(F.lit(offset + length) - F.col("d_off"), F.col("d_len")) - skip
    part = F.substring("data", (skip + 1).cast("int"), size.cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("frame_no", F.hex(part).alias("_h"))))
    return frames.groupBy("path").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["_h"]), "")).alias("data"))


INFO = "has_table boolean, frame_count long, size long, checksums boolean"


def info(c: Column | str) -> Column:
    """What the seek table of a value tells: whether there is one, its frames, the plain size, whether it has checksums."""
    def one(b) -> tuple:
        if b is None:
            return None, None, None, None
        table = zstds.read_seek_table(bytes(b))
        if table is None:
            return False, None, None, None
        return True, len(table), sum(r[1] for r in table), bool(table) and table[0][2] is not None

    @F.pandas_udf(INFO)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in s], columns=[x.split()[0] for x in INFO.split(", ")], dtype=object)

    c = (F.col(c) if isinstance(c, str) else c).cast("binary")
    return F.when(c.isNotNull(), run(c))


def read_bytes(c: Column | str, offset: int, length: int) -> Column:
    """Plain bytes from offset on, at most length, of a seekable value; only frames that overlap are decoded."""
    method = find("zstd")
    options = method.validated({})

    def one(b):
        if b is None:
            return None
        data = bytes(b)
        table = zstds.read_seek_table(data)
        if table is None:
            raise corrupt("no seek table")
        out, at, plain = bytearray(), 0, 0
        for packed, content, _ in table:
            if plain < offset + length and plain + content > offset:
                got = method.decode(data[at : at + packed], options)
                out += got[max(0, offset - plain) : offset + length - plain]
            at, plain = at + packed, plain + content
        return bytes(out)

    run = F.pandas_udf(lambda s: pd.Series([one(b) for b in s], dtype=object), "binary")
    return run((F.col(c) if isinstance(c, str) else c).cast("binary"))
