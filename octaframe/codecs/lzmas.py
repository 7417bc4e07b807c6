"""LZMA, LZMA2 and xz over the standard library, with an xz container of our own for block sizes and newer filters."""

from __future__ import annotations

import hashlib
import lzma
import struct
import zlib

from ..errors import INVALID_ARG, LIMIT, UNSUPPORTED, CodecError, corrupt
from . import filters
from .checksums import crc64

# Filter ids and check ids of the xz format.
FILTER_IDS = {"delta": 3, "x86": 4, "powerpc": 5, "ia64": 6, "arm": 7, "armthumb": 8, "sparc": 9, "arm64": 10, "riscv": 11}
CHECKS = {"none": 0, "crc32": 1, "crc64": 4, "sha256": 10}
UNSTATED = (1 << 64) - 1
CHECK_SIZE = {0: 0, 1: 4, 4: 8, 10: 32}


def _drained(z: lzma.LZMADecompressor, data: bytes, out: bytearray, most: int) -> None:
    piece = data
    while not z.eof:
        try:
            out += z.decompress(piece, most - len(out) + 1 if most else -1)
        except (lzma.LZMAError, EOFError) as e:
            raise corrupt(str(e)) from e
        piece = b""
        if most and len(out) > most:
            raise CodecError(LIMIT, f"more than {most} bytes of output")
        if not z.eof and z.needs_input:
            raise corrupt("stream is truncated")


def _chain(kind: int, o: dict, p: str) -> dict:
    f = {"id": kind, "preset": o[f"{p}.preset"], "lc": o[f"{p}.lc"], "lp": o[f"{p}.lp"], "pb": o[f"{p}.pb"]}
    if o[f"{p}.dict_size"]:
        f["dict_size"] = o[f"{p}.dict_size"]
    if f["lc"] + f["lp"] > 4:
        raise CodecError(INVALID_ARG, "lc + lp is above 4")
    return f


def lzma_encode(data: bytes, o: dict) -> bytes:
    """With lzma.uncompressed_size the header states it; the library writes its end marker all the same."""
    f, size = _chain(lzma.FILTER_LZMA1, o, "lzma"), o["lzma.uncompressed_size"]
    if size not in (UNSTATED, len(data)):
        raise CodecError(INVALID_ARG, "lzma.uncompressed_size differs from the input")
    out = lzma.compress(data, lzma.FORMAT_RAW if o["lzma.raw"] else lzma.FORMAT_ALONE, filters=[f])
    return out if o["lzma.raw"] or size == UNSTATED else out[:5] + struct.pack("<Q", size) + out[13:]


def lzma_decode(data: bytes, o: dict) -> bytes:
    out, most = bytearray(), o["limits.max_output_bytes"]
    if o["lzma.raw"]:
        z = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[_chain(lzma.FILTER_LZMA1, o, "lzma")])
        if o["lzma.uncompressed_size"] != UNSTATED:
            return _stated(z, data, o["lzma.uncompressed_size"], most)
    else:
        _window(o, struct.unpack_from("<I", data, 1)[0] if len(data) >= 13 else 0)
        z = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
    _drained(z, data, out, most)
    return bytes(out)


def _stated(z: lzma.LZMADecompressor, data: bytes, size: int, most: int) -> bytes:
    """The first ``size`` bytes of a stream that need not have an end marker."""
    if most and size > most:
        raise CodecError(LIMIT, f"more than {most} bytes of output")
    out, piece = bytearray(), data
    while len(out) < size and not z.eof:
        try:
            out += z.decompress(piece, size - len(out))
        except (lzma.LZMAError, EOFError) as e:
            raise corrupt(str(e)) from e
        piece = b""
        if len(out) < size and not z.eof and z.needs_input:
            break
    if len(out) < size:
        raise corrupt("stream is truncated")
    return bytes(out)


def _window(o: dict, size: int) -> None:
    if o["limits.max_window_bytes"] and size > o["limits.max_window_bytes"]:
        raise CodecError(LIMIT, f"a dictionary of {size} bytes")


def lzma2_encode(data: bytes, o: dict) -> bytes:
    return lzma.compress(data, lzma.FORMAT_RAW, filters=[_chain(lzma.FILTER_LZMA2, o, "lzma2")])


def lzma2_decode(data: bytes, o: dict) -> bytes:
    out = bytearray()
    _drained(lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[_chain(lzma.FILTER_LZMA2, o, "lzma2")]), data, out, o["limits.max_output_bytes"])
    return bytes(out)


def parse_filters(text: str) -> list[tuple[str, int]]:
    """"delta:4,x86" as [("delta", 4), ("x86", 0)]; the number is the distance or the start offset."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        name, _, arg = part.partition(":")
        if name not in FILTER_IDS or (arg and not arg.isdigit()):
            raise CodecError(INVALID_ARG, f"no filter {part!r}")
        n = int(arg) if arg else int(name == "delta")
        if name == "delta" and not 1 <= n <= 256:
            raise CodecError(INVALID_ARG, "delta distances are 1 to 256")
        out.append((name, n))
    if len(out) > 3:
        raise CodecError(INVALID_ARG, "at most three filters before LZMA2")
    return out


def _vli(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_vli(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 56:
            raise corrupt("number in an xz header")
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 128:
            return n, at


def _check(kind: int, data: bytes) -> bytes:
    if kind == 1:
        return struct.pack("<I", zlib.crc32(data))
    if kind == 4:
        return struct.pack("<Q", crc64(data))
    return hashlib.sha256(data).digest() if kind == 10 else b""


def _dict_code(size: int) -> int:
    return next((b for b in range(40) if (2 | b & 1) << (b // 2 + 11) >= size), 40)


def _block(data: bytes, chain: list[tuple[str, int]], o: dict, check: int) -> tuple[bytes, int]:
    plain = data
    for name, n in chain:
        data = filters.delta(data, n, True) if name == "delta" else filters.bcj(data, name, n, True)
    f = _chain(lzma.FILTER_LZMA2, o, "xz")
    size = f.setdefault("dict_size", min(1 << 26, max(4096, 1 << (18 + min(f["preset"], 8)))))
    body = lzma.compress(data, lzma.FORMAT_RAW, filters=[f])
    flags = b""
    for name, n in chain:
        props = bytes([n - 1]) if name == "delta" else struct.pack("<I", n) if n else b""
        flags += _vli(FILTER_IDS[name]) + _vli(len(props)) + props
    head = bytes([len(chain)]) + flags + bytes([0x21, 1, _dict_code(size)])
    head += bytes(-(len(head) + 1) % 4)
    head = bytes([(len(head) + 1 + 4) // 4 - 1]) + head
    head += struct.pack("<I", zlib.crc32(head))
    total = len(head) + len(body) + CHECK_SIZE[check]
    return head + body + bytes(-len(body) % 4) + _check(check, plain), total


def xz_encode(data: bytes, o: dict) -> bytes:
    chain, check, size = parse_filters(o["xz.filters"]), CHECKS[o["xz.check"]], o["xz.block_size"] or len(data)
    known = all(x not in ("arm64", "riscv") for x, _ in chain)
    if known and (not o["xz.block_size"] or o["xz.block_size"] >= len(data)):
        ids = [{"id": FILTER_IDS[x], "dist": n} if x == "delta" else {"id": FILTER_IDS[x], "start_offset": n} for x, n in chain]
        return lzma.compress(data, lzma.FORMAT_XZ, CHECKS[o["xz.check"]], filters=[*ids, _chain(lzma.FILTER_LZMA2, o, "xz")])
    flags = bytes([0, check])
    out, records = bytearray(b"\xfd7zXZ\0" + flags + struct.pack("<I", zlib.crc32(flags))), []
    for at in range(0, len(data), max(size, 1)):
        piece = data[at : at + size]
        block, total = _block(piece, chain, o, check)
        out += block
        records.append((total, len(piece)))
    index = b"\0" + _vli(len(records)) + b"".join(_vli(a) + _vli(b) for a, b in records)
    index += bytes(-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + flags
    return bytes(out + index + struct.pack("<I", zlib.crc32(tail)) + tail + b"YZ")


def _uses_new_filters(data: bytes) -> bool:
    """Whether the first block names a filter that the library lacks."""
    if len(data) < 14 or data[:6] != b"\xfd7zXZ\0" or not data[12]:
        return False
    at, out = 14 + 0, False
    if data[13] & 0x40:
        _, at = _read_vli(data, at)
    if data[13] & 0x80:
        _, at = _read_vli(data, at)
    for _ in range((data[13] & 3) + 1):
        kind, at = _read_vli(data, at)
        n, at = _read_vli(data, at)
        at += n
        out |= kind in (10, 11)
    return out


def _stream(data: bytes, out: bytearray, o: dict) -> bytes:
    """Decode a stream whose chains have filters of our own; what follows it."""
    check, at, names = data[7], 12, {v: k for k, v in FILTER_IDS.items()}
    if check not in CHECK_SIZE or struct.unpack_from("<I", data, 8)[0] != zlib.crc32(data[6:8]):
        raise corrupt("xz stream header")
    blocks = 0
    while data[at]:
        start, size = at, (data[at] + 1) * 4
        head = data[at : at + size]
        if len(head) < size or struct.unpack_from("<I", head, size - 4)[0] != zlib.crc32(head[:-4]):
            raise corrupt("xz block header")
        p, chain, props = 2, [], b""
        for bit in (0x40, 0x80):
            if head[1] & bit:
                _, p = _read_vli(head, p)
        for _ in range((head[1] & 3) + 1):
            kind, p = _read_vli(head, p)
            n, p = _read_vli(head, p)
            props, p = head[p : p + n], p + n
            if kind in names:
                chain.append((names[kind], props[0] + 1 if kind == 3 else struct.unpack("<I", props)[0] if props else 0))
            elif kind != 0x21:
                raise CodecError(UNSUPPORTED, f"xz filter {kind}")
        window = 0xFFFFFFFF if props[0] >= 40 else (2 | props[0] & 1) << (props[0] // 2 + 11)
        _window(o, window)
        z, plain = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": window}]), bytearray()
        body = data[start + size :]
        _drained(z, body, plain, o["limits.max_output_bytes"])
        used = len(body) - len(z.unused_data)
        piece = bytes(plain)
        for name, n in reversed(chain):
            piece = filters.delta(piece, n, False) if name == "delta" else filters.bcj(piece, name, n, False)
        at = start + size + used + (-used % 4)
        if data[at : at + CHECK_SIZE[check]] != _check(check, piece):
            raise corrupt("xz check")
        at += CHECK_SIZE[check]
        out += piece
        blocks += 1
        if at >= len(data):
            raise corrupt("stream is truncated")
    first = at
    n, at = _read_vli(data, at + 1)
    for _ in range(2 * n):
        _, at = _read_vli(data, at)
    at += -(at - first) % 4
    if n != blocks or len(data) < at + 16 or struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[first:at]) or data[at + 14 : at + 16] != b"YZ":
        raise corrupt("xz index")
    return data[at + 16 :]


def xz_decode(data: bytes, o: dict) -> bytes:
    """All concatenated streams; only zero padding of a multiple of four may follow one."""
    out, most = bytearray(), o["limits.max_output_bytes"]
    while True:
        if _uses_new_filters(data):
            rest = _stream(data, out, o)
        else:
            z = lzma.LZMADecompressor(lzma.FORMAT_XZ)
            _drained(z, data, out, most)
            rest = z.unused_data
        data = rest.lstrip(b"\0")
        if (len(rest) - len(data)) % 4:
            raise corrupt("stream padding")
        if not data:
            return bytes(out)
