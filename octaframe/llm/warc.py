"""WARC archives as a Python data source, reading and writing.

Writing makes one file per partition, each record a gzip member of its own.
The member's extra field "sl" tells its compressed and plain length, so that a
reader can pass over a record without inflating it.  Files of attempts that
were not committed are left out: the committed ones are listed in a manifest.

Reading plans a partition for several small files or for a range of bytes of a
large one, parses headers first, applies record-type and header predicates to
them, and inflates a payload only if its record is wanted and the column is
asked for.  Ranges begin where the manifest says that a record does; files
without a manifest are read by one task each, since nothing else tells that for
sure.  Plain files are read in blocks and passed over by seeking; members without
"sl" are inflated through, in bounded pieces.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import broadcast_if_small, cut, new_path

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, headers map<string,string>, content_length long, payload binary"
#: Column of each header that predicates reach.
HEADER_OF = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
MANIFEST = "_manifest.json"
#: Fixed value: the profile of a revisit of an equal payload.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16
HEADER_LIMIT = 1 << 20
#: Files of less than this share a partition, larger ones are read in ranges of as much.
PARTITION_BYTES = 64 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path if path.startswith("/") else path.replace(":/", ":///", 1))


def _header_block(headers: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1"] + [f"{k}: {' '.join(v.split())}" for k, v in headers] + [f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _member(plain: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field gives the member's and the plain length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(plain) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class _Committed(WriterCommitMessage):
    def __init__(self, name: str, records: int, places: list[int]):
        self.name, self.records, self.places = name, records, places


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool, options: dict):
        self.path, self.columns, self.overwrite = path, columns, overwrite
        self.split = int(options.get("splitbytes", PARTITION_BYTES))

    def write(self, iterator) -> _Committed:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        name, n, at, places = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, [0]
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in iterator:
                r = dict(zip(self.columns, row, strict=True))
                payload = bytes(r.get("payload") or b"")
                headers = [("WARC-Type", r.get("record_type") or "resource"), ("WARC-Record-ID", r.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>")]
                headers.append(("WARC-Date", r.get("warc_date") or "1970-01-01T00:00:00Z"))
                if headers[0][1] == "revisit":
                    headers.append(("WARC-Profile", REVISIT))
                for column, key in (("target_uri", "WARC-Target-URI"), ("refers_to", "WARC-Refers-To"), ("payload_digest", "WARC-Payload-Digest")):
                    if r.get(column):
                        headers.append((key, r[column]))
                headers += [(k, v) for k, v in sorted((r.get("headers") or {}).items()) if v is not None]
                member = _member(_header_block(headers, len(payload)) + payload + b"\r\n\r\n")
                if at - places[-1] >= self.split:
                    places.append(at)
                out.write(member)
                n, at = n + 1, at + len(member)
        return _Committed(name, n, places)

    def commit(self, messages) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names = [[m.name, m.places] for m in messages if m is not None and m.records]
        if not self.overwrite and system.get_file_info(f"{root}/{MANIFEST}").is_file:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                names += json.loads(f.read())
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(names)).encode())
        for m in messages:
            if m is not None and not m.records:
                system.delete_file(f"{root}/{m.name}")

    def abort(self, messages) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m is not None and system.get_file_info(f"{root}/{m.name}").is_file:
                system.delete_file(f"{root}/{m.name}")


class _Files(InputPartition):
    """Ranges (file, first byte, last byte + 1; None for its end) whose records a task reads."""

    def __init__(self, ranges: list[tuple[str, int, int | None]]):
        super().__init__(ranges)
        self.ranges = ranges


class _Plain:
    """Bytes of an uncompressed file: read in blocks, and skip by seeking."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.buffer, self.start = f, size, 0, b"", 0

    def read(self, n: int) -> bytes:
        if len(self.buffer) < n:
            self.buffer += self.f.read(max(PIECE, n - len(self.buffer)))
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += len(out)
        return out

    def unread(self, data: bytes) -> None:
        self.buffer, self.at = data + self.buffer, self.at - len(data)

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.read(n)
            return
        self.at = min(self.size, self.at + n)
        self.buffer = b""
        self.f.seek(self.at)

    def next_record(self) -> bool:
        while b := self.read(1):  # blank lines between records
            if b not in b"\r\n":
                self.unread(b)
                self.start = self.at
                return True
        return False

    def end_record(self, left: int) -> None:
        self.skip(left)


class _Gzip:
    """Plain bytes of a file of gzip members; a member with "sl" can be left without inflating the rest."""

    def __init__(self, f, size: int, start: int = 0):
        self.f, self.size = f, size
        self.start, self.length, self.buffer, self.z = start, None, b"", None

    def unread(self, data: bytes) -> None:
        self.buffer = data + self.buffer

    def _begin(self) -> None:
        self.f.seek(self.start)
        head = self.f.read(12)
        self.length = None
        if len(head) == 12 and head[3] & 4:
            extra, at = self.f.read(struct.unpack("<H", head[10:])[0]), 0
            while at + 4 <= len(extra):
                n = struct.unpack("<H", extra[at + 2 : at + 4])[0]
                if extra[at : at + 2] == b"sl" and n == 8:
                    self.length = struct.unpack("<I", extra[at + 4 : at + 8])[0] or None
                at += 4 + n
        self.f.seek(self.start)
        self.z, self.buffer, self.raw, self.fed = zlib.decompressobj(31), b"", b"", 0

    def next_record(self) -> bool:
        if self.z is None:
            if self.start >= self.size:
                return False
            self._begin()
        while not self.buffer:
            if not self._more():
                self._close()
                return self.next_record()
        if self.buffer[:1] in b"\r\n":
            self.buffer = self.buffer.lstrip(b"\r\n")
            return self.next_record()
        return True

    def _more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.f.read(PIECE)
            self.fed += len(self.raw)
            if not self.raw:
                raise ValueError("truncated gzip member in a WARC file")
        self.buffer += self.z.decompress(self.raw, PIECE)
        self.raw = self.z.unconsumed_tail
        return True

    def _close(self) -> None:
        self.start += self.fed - len(self.z.unused_data) - len(self.raw)
        self.z = None

    def read(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.buffer and not self._more():
                break
            got, self.buffer = self.buffer[: n - have], self.buffer[n - have :]
            parts.append(got)
            have += len(got)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0:
            got = len(self.read(min(n, PIECE)))
            if not got:
                return
            n -= got

    def end_record(self, left: int) -> None:
        if self.length is not None:  # the writer's members hold one record each
            self.start, self.z = self.start + self.length, None
        else:
            self.skip(left)


def _headers(src) -> tuple[dict[str, str], dict[str, str]]:
    """Named header fields, by lower-case name and as written."""
    block = b""
    while b"\r\n\r\n" not in block:
        piece = src.read(4096)
        if not piece or len(block) > HEADER_LIMIT:
            raise ValueError("WARC record without an end of headers")
        block += piece
    block, rest = block.split(b"\r\n\r\n", 1)
    if rest:
        src.unread(rest)
    lines, low, kept = block.decode("utf-8", "replace").split("\r\n"), {}, {}
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    key = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and key:
            low[key.lower()] = kept[key] = kept[key] + " " + line.strip()
        elif ":" in line:
            key, value = line.split(":", 1)
            low[key.strip().lower()] = kept[key := key.strip()] = value.strip()
    return low, kept


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], options: dict):
        self.path, self.columns = path, columns
        self.tests: list[tuple[str, str, object]] = []
        if options.get("recordtype"):
            self.tests.append(("in", "record_type", tuple(x.strip() for x in options["recordtype"].split(","))))

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo):
                self.tests.append(("in", column, (f.value,)))
            elif column in HEADER_OF and isinstance(f, In):
                self.tests.append(("in", column, tuple(f.value)))
            elif column in HEADER_OF and isinstance(f, StringStartsWith):
                self.tests.append(("starts", column, f.value))
            elif column in HEADER_OF and isinstance(f, IsNotNull):
                self.tests.append(("there", column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        info, places = system.get_file_info(root), {}
        if info.is_file:
            found = [info]
        elif system.get_file_info(f"{root}/{MANIFEST}").is_file:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                places = {f"{root}/{n}": at for n, at in json.loads(f.read())}
            found = [x for x in system.get_file_info(pafs.FileSelector(root)) if x.path in places]
            if len(found) != len(places):
                raise ValueError("archives listed in the manifest are missing")
        else:
            found = [x for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]
        plan, held, size = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            begins = places.get(x.path, [0])
            if len(begins) > 1:
                plan += [_Files([(x.path, at, end)]) for at, end in zip(begins, [*begins[1:], None], strict=True)]
                continue
            if held and size + x.size > PARTITION_BYTES:
                plan, held, size = [*plan, _Files(held)], [], 0
            held, size = [*held, (x.path, 0, None)], size + x.size
        return [*plan, *([_Files(held)] if held else [])] or [_Files([])]

    def _wanted(self, low: dict[str, str]) -> bool:
        for kind, column, value in self.tests:
            have = low.get(HEADER_OF[column])
            if have is None or (kind == "in" and have not in value) or (kind == "starts" and not have.startswith(value)):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _open(self.path)
        payload = "payload" in self.columns
        for name, start, last in partition.ranges:
            with system.open_input_file(name) as f:
                size = f.size()
                f.seek(start)
                gzip = f.read(2) == b"\x1f\x8b"
                f.seek(start)
                src = _Gzip(f, size, start) if gzip else _Plain(f, size)
                while (last is None or src.start < last) and src.next_record():
                    low, kept = _headers(src)
                    length = int(low.get("content-length", "0"))
                    wanted = self._wanted(low)
                    body = src.read(length) if wanted and payload else None
                    if body is not None and len(body) < length:
                        raise ValueError("truncated WARC record")
                    src.end_record(0 if body is not None else length)
                    if wanted:
                        row = {c: low.get(h) for c, h in HEADER_OF.items()}
                        row |= {"headers": kept, "content_length": length, "payload": body}
                        yield tuple(row[c] for c in self.columns)


class WarcDataSource(DataSource):
    """format("warc"): options path, recordType (a list with commas) to read certain types alone, splitBytes (writing) of the ranges that large files are read in."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        return self.options["path"]

    def reader(self, schema: StructType) -> WarcReader:
        unknown = set(schema.names) - {x.split()[0] for x in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns in a WARC file: {sorted(unknown)}")
        return WarcReader(self._path(), schema.names, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self._path(), schema.names, overwrite, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(spark: SparkSession, path: str) -> DataFrame:
    """A scan of the archives at path, to be filtered once.

    Spark keeps what it pushed down with the loaded source, not with the branch
    of the plan, so each differently filtered branch needs a call of its own.
    """
    register(spark)
    return spark.read.format("warc").load(path)


LEAST_SHARED = 100


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for each row of pages to WARC files at path.

    Of records with equal payloads of at least LEAST_SHARED bytes, that with the
    smallest id is a response and the others are revisits without payload that
    refer to it; smaller ones are all responses.  A null payload is empty.  Rows
    with a null id never serve as the response of others; rows that repeat the
    smallest id are responses too.  An empty table makes an empty archive.
    """
    register(pages.sparkSession)
    body = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), body.alias("_body"), F.sha2(body, 256).alias("_sha")
    )
    rows = rows.withColumn("_n", F.octet_length("_body").cast("long"))
    large = rows.where(f"_n >= {LEAST_SHARED}").groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_k"))
    shared = cut(large.where("_k > 1 and _first is not null").select(F.col("_sha").alias("_sh"), "_first"), "warc-shared")
    rows = rows.join(broadcast_if_small(shared), (F.col("_sha") == F.col("_sh")) & (F.col("_n") >= LEAST_SHARED), "left")
    again = F.coalesce((F.col("_first") != F.col("_id")) | (F.col("_first").isNotNull() & F.col("_id").isNull()), F.lit(False))
    urn = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">")))
    out = rows.select(
        F.coalesce(urn(F.col("_id")), F.lit("<urn:page:>")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("_url").alias("target_uri"),
        F.when(again, urn(F.col("_first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("_sha")).alias("payload_digest"),
        F.create_map(F.lit("X-Payload-Length"), F.col("_n").cast("string")).alias("headers"),
        F.when(~again, F.col("_body")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Length and digest of responses come from the payload that was read, those of
    revisits from their headers.  Null and empty payloads are responses of no
    bytes.  Repeated rows are a record each; of equal payloads those of the
    smallest id are the response, all others revisit it.  A row with a null id
    comes back with a null id.  Payloads of any length are written whole.  Other
    columns of pages are not looked at, whatever their names.  An empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    archive(pages, path)
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)>", 1).try_cast("long")
    full = records(spark, path).where("record_type = 'response'").select(
        number("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
        "target_uri",
    )
    lean = records(spark, path).where("record_type = 'revisit'").select(
        number("record_id").alias("page_id"),
        F.col("headers")["X-Payload-Length"].cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "target_uri",
    )
    return full.union(lean)


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first IS NOT NULL AND f.first IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND f.first IS DISTINCT FROM d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
