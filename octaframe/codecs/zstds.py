"""Zstandard over the zstandard package, or else the Arrow library's codec, with frame walking and the seekable format."""

from __future__ import annotations

import struct

from ..errors import INVALID_ARG, LIMIT, UNSUPPORTED, CodecError, corrupt
from . import native
from .checksums import xxh64

try:
    import zstandard
except ImportError:  # pragma: no cover
    zstandard = None

MAGIC, SKIPPABLE, TABLE, FOOTER = 0xFD2FB528, 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


def _library():
    if zstandard is None:
        raise CodecError(UNSUPPORTED, "the zstandard package is not installed")
    return zstandard


def window_log(level: int) -> int:
    return next((w for most, w in ((3, 17), (6, 19), (10, 21), (16, 23)) if level <= most), 25)


def _frame(data: bytes, o: dict) -> bytes:
    """One frame.  The Arrow library's codec knows levels alone."""
    if zstandard is None and native.has("zstd") and not (o["zstd.dictionary"] or o["zstd.checksum"] or o["zstd.window_log"] or o["zstd.long"]):
        return native.packed(data, "zstd", o["zstd.level"] or 3)
    return _compressor(o, True).compress(data)


def _compressor(o: dict, size: bool):
    z = _library()
    d = o["zstd.dictionary"]
    extra = {"dict_data": z.ZstdCompressionDict(d)} if d else {}
    params = {"write_checksum": o["zstd.checksum"], "write_content_size": size, "write_dict_id": bool(d)}
    if o["zstd.window_log"] or o["zstd.long"]:
        p = {"enable_ldm": o["zstd.long"], **params}
        if o["zstd.window_log"]:
            p["window_log"] = max(10, o["zstd.window_log"])
        if o["zstd.long"]:
            p |= {"ldm_min_match": o["zstd.ldm_min_match"], "ldm_hash_log": o["zstd.ldm_hash_log"], "ldm_hash_rate_log": o["zstd.ldm_hash_rate_log"]}
        return z.ZstdCompressor(compression_params=z.ZstdCompressionParameters.from_level(o["zstd.level"], **p), **extra)
    return z.ZstdCompressor(level=o["zstd.level"], **params, **extra)


def encode(data: bytes, o: dict) -> bytes:
    if o["zstd.content_size"] is not None and o["zstd.content_size"] != len(data):
        raise CodecError(INVALID_ARG, "zstd.content_size differs from the input")
    if not o["zstd.seekable"]:
        return _frame(data, o)
    if o["threads.count"] > 1:
        raise CodecError(INVALID_ARG, "seekable output has one thread")
    step = o["zstd.seekable_frame_size"]
    frames = [(data[at : at + step], _frame(data[at : at + step], o)) for at in range(0, len(data), step)]
    sums = o["zstd.seekable_checksum"]
    rows = [(len(c), len(p), xxh64(p) & 0xFFFFFFFF if sums else None) for p, c in frames]
    return b"".join(c for _, c in frames) + seek_table(rows, sums)


def seek_table(rows: list[tuple[int, int, int | None]], checksums: bool) -> bytes:
    """The skippable frame with (compressed size, plain size, checksum) of each frame."""
    body = b"".join(struct.pack("<III", c, d, s) if checksums else struct.pack("<II", c, d) for c, d, s in rows)
    body += struct.pack("<IBI", len(rows), checksums << 7, FOOTER)
    return struct.pack("<II", TABLE, len(body)) + body


def read_seek_table(data: bytes, before: int | None = None) -> list[tuple[int, int, int | None]] | None:
    """Rows of the seek table at the end of data; None if there is none.  before: bytes of frames in front of data, if not in it."""
    if len(data) < 17 or struct.unpack_from("<I", data, len(data) - 4)[0] != FOOTER:
        return None
    n, flags = struct.unpack_from("<IB", data, len(data) - 9)
    if flags & 0x7C:
        raise corrupt("reserved bits of the seek table")
    width = 12 if flags & 128 else 8
    total = n * width + 17
    start = len(data) - total
    if start < 0 or struct.unpack_from("<II", data, start) != (TABLE, total - 8):
        raise corrupt("seek table size")
    rows = [struct.unpack_from("<III" if width == 12 else "<II", data, start + 8 + i * width) for i in range(n)]
    if sum(r[0] for r in rows) != (start if before is None else before):
        raise corrupt("sizes in the seek table")
    return [(r[0], r[1], r[2] if width == 12 else None) for r in rows]


def frame_header(data: bytes, at: int = 0) -> dict:
    if len(data) < at + 5 or struct.unpack_from("<I", data, at)[0] != MAGIC:
        raise corrupt("not a Zstandard frame")
    d, p = data[at + 4], at + 5
    single, dict_size, size_code = d >> 5 & 1, (0, 1, 2, 4)[d & 3], d >> 6
    if d & 8:
        raise corrupt("reserved bit of the frame header")
    size_len = (single, 2, 4, 8)[size_code] if size_code == 0 else (0, 2, 4, 8)[size_code]
    if len(data) < p + (not single) + dict_size + size_len:
        raise corrupt("frame header is truncated")
    window = None
    if not single:
        exponent, mantissa = data[p] >> 3, data[p] & 7
        window, p = (1 << 10 + exponent) + ((1 << 10 + exponent) >> 3) * mantissa, p + 1
    dict_id, p = int.from_bytes(data[p : p + dict_size], "little") if dict_size else None, p + dict_size
    size = int.from_bytes(data[p : p + size_len], "little") + (256 if size_len == 2 else 0) if size_len else None
    return {"window_size": size if single else window, "content_size": size, "dictionary_id": dict_id, "checksum": bool(d & 4), "header_size": p + size_len - at}


def walk(data: bytes):
    """Events (kind, offset, size, payload offset, payload size); nothing is decoded."""
    at = 0
    while at < len(data):
        if len(data) < at + 4:
            raise corrupt("frame is truncated")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if len(data) < at + 8 or len(data) < at + 8 + struct.unpack_from("<I", data, at + 4)[0]:
                raise corrupt("skippable frame is truncated")
            n = struct.unpack_from("<I", data, at + 4)[0]
            yield "skippable", at, 8 + n, at + 8, n
            at += 8 + n
            continue
        head, start = frame_header(data, at), at
        yield "header", at, head["header_size"], at, head["header_size"]
        at += head["header_size"]
        last = 0
        while not last:
            if len(data) < at + 3:
                raise corrupt("frame is truncated")
            word = int.from_bytes(data[at : at + 3], "little")
            last, kind, n = word & 1, word >> 1 & 3, word >> 3
            if kind == 3:
                raise corrupt("reserved block type")
            held = 1 if kind == 1 else n
            if len(data) < at + 3 + held:
                raise corrupt("block is truncated")
            yield ("raw", "rle", "block")[kind], at, 3 + held, at + 3, held
            at += 3 + held
        at += 4 * head["checksum"]
        if at > len(data):
            raise corrupt("frame is truncated")
        yield "frame", start, at - start, start, at - start


def decode(data: bytes, o: dict) -> bytes:
    most, d = o["limits.max_output_bytes"], o["zstd.dictionary"]
    frames = [(at, n) for kind, at, n, _, _ in walk(data) if kind == "frame"]
    if not data:
        raise corrupt("empty input")
    out = bytearray()
    for at, n in frames if o["zstd.concat"] else frames[:1]:
        head = frame_header(data, at)
        if o["zstd.dictionary_id"] is not None and head["dictionary_id"] not in (None, o["zstd.dictionary_id"]):
            raise CodecError(INVALID_ARG, f"the frame names dictionary {head['dictionary_id']}")
        if o["limits.max_window_bytes"] and (head["window_size"] or 0) > max(o["limits.max_window_bytes"], 1024) and head["content_size"] != head["window_size"]:
            raise CodecError(LIMIT, f"a window of {head['window_size']} bytes")
        if zstandard is None and native.has("zstd") and not d:
            out += native.stream(data[at : at + n], "zstd", max(1, most - len(out)) if most else 0)
            if most and len(out) > most:
                raise CodecError(LIMIT, f"more than {most} bytes of output")
            continue
        z = _library()
        r = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(d) if d else None, max_window_size=1 << 31).stream_reader(data[at : at + n])
        try:
            while piece := r.read(1 << 20):
                out += piece
                if most and len(out) > most:
                    raise CodecError(LIMIT, f"more than {most} bytes of output")
        except z.ZstdError as e:
            raise corrupt(str(e)) from e
    return bytes(out)
