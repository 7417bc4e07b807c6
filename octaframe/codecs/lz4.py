"""LZ4 frames and blocks.  Blocks without history and frames without dictionary use the Arrow library's codec where it is there."""

from __future__ import annotations

import struct

from ..errors import INVALID_ARG, LIMIT, CodecError, corrupt
from . import native
from .bits import copy_match, greedy
from .checksums import xxh32

MAGIC, SKIPPABLE = 0x184D2204, 0x184D2A50
SIZES = {4: 1 << 16, 5: 1 << 18, 6: 1 << 20, 7: 1 << 22}


def _length(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def block_encode(data: bytes, history: bytes = b"") -> bytes:
    """One block; matches start 12 bytes before the end at most and leave 5 literals."""
    if not history and native.has("lz4_raw"):
        return native.packed(data, "lz4_raw")
    out, start = bytearray(), len(history)
    whole = history + data
    for lo, hi, distance, n in greedy(whole, start, 65535, 4, 1 << 30, 12):
        lit = hi - lo
        m = n - 4 if distance else 0
        out.append(min(lit, 15) << 4 | min(m, 15))
        if lit >= 15:
            out += _length(lit - 15)
        out += whole[lo:hi]
        if distance:
            out += struct.pack("<H", distance)
            if m >= 15:
                out += _length(m - 15)
    return bytes(out)


def block_decode(block: bytes, out: bytearray, most: int) -> None:
    """Append what a block holds to out, whose end is its history."""
    at, end, base = 0, len(block), len(out)
    while at < end:
        token = block[at]
        at += 1
        lit, n = token >> 4, token & 15
        if lit == 15:
            while True:
                if at >= end:
                    raise corrupt("literal length")
                lit += block[at]
                at += 1
                if block[at - 1] != 255:
                    break
        if at + lit > end:
            raise corrupt("literals end early")
        out += block[at : at + lit]
        at += lit
        if at == end:
            break
        if at + 2 > end:
            raise corrupt("distance")
        distance = block[at] | block[at + 1] << 8
        at += 2
        if n == 15:
            while True:
                if at >= end:
                    raise corrupt("match length")
                n += block[at]
                at += 1
                if block[at - 1] != 255:
                    break
        if not distance:
            raise corrupt("distance 0")
        copy_match(out, distance, n + 4)
        if len(out) - base > most:
            raise corrupt("block is larger than its frame allows")


def encode(data: bytes, o: dict) -> bytes:
    size, code = next(((s, c) for c, s in SIZES.items() if s >= o["lz4.block_size"]), (1 << 22, 7))
    dictionary = (o["lz4.dictionary"] or b"")[-65535:]
    stated = o["lz4.content_size"]
    if stated is not None and stated != len(data):
        raise CodecError(INVALID_ARG, "lz4.content_size differs from the input")
    alone, sums = o["lz4.independent_blocks"], o["lz4.block_checksum"]
    flags = 0x40 | alone << 5 | sums << 4 | (stated is not None) << 3 | o["lz4.content_checksum"] << 2 | (o["lz4.dictionary_id"] is not None)
    head = bytes([flags, code << 4])
    head += struct.pack("<Q", stated) if stated is not None else b""
    head += struct.pack("<I", o["lz4.dictionary_id"]) if o["lz4.dictionary_id"] is not None else b""
    out = bytearray(struct.pack("<I", MAGIC) + head + bytes([xxh32(head) >> 8 & 255]))
    for at in range(0, len(data), size):
        piece = data[at : at + size]
        history = dictionary if alone or not at else (dictionary + data[max(0, at - 65535) : at])[-65535:]
        packed = block_encode(piece, history)
        if len(packed) >= len(piece):
            out += struct.pack("<I", len(piece) | 0x80000000)
            packed = piece
        else:
            out += struct.pack("<I", len(packed))
        out += packed
        out += struct.pack("<I", xxh32(packed)) if sums else b""
    out += struct.pack("<I", 0)
    return bytes(out + (struct.pack("<I", xxh32(data)) if o["lz4.content_checksum"] else b""))


def frame_info(data: bytes, at: int = 0) -> dict:
    """Facts of the frame header at ``at``; header_size tells where blocks start."""
    if len(data) < at + 7:
        raise corrupt("LZ4 header is truncated")
    flags, bd = data[at + 4], data[at + 5]
    if flags >> 6 != 1 or flags & 2 or bd & 0x8F or bd >> 4 not in SIZES:
        raise corrupt("LZ4 frame descriptor")
    n = 2 + 8 * (flags >> 3 & 1) + 4 * (flags & 1)
    if len(data) < at + 4 + n + 1:
        raise corrupt("LZ4 header is truncated")
    desc = data[at + 4 : at + 4 + n]
    if xxh32(desc) >> 8 & 255 != data[at + 4 + n]:
        raise corrupt("LZ4 header checksum")
    return {
        "independent": bool(flags >> 5 & 1),
        "block_checksum": bool(flags >> 4 & 1),
        "content_checksum": bool(flags >> 2 & 1),
        "block_size": SIZES[bd >> 4],
        "content_size": struct.unpack_from("<Q", desc, 2)[0] if flags >> 3 & 1 else None,
        "dictionary_id": struct.unpack_from("<I", desc, n - 4)[0] if flags & 1 else None,
        "header_size": 4 + n + 1,
    }


def walk(data: bytes, first: bool = False):
    """Events (kind, offset, size, payload offset, payload size) of frames, blocks and skippable frames; nothing is decoded.

    first: end after the first frame.
    """
    at = 0
    while at + 4 <= len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if len(data) < at + 8:
                raise corrupt("skippable frame is truncated")
            n = struct.unpack_from("<I", data, at + 4)[0]
            if len(data) < at + 8 + n:
                raise corrupt("skippable frame is truncated")
            yield "skippable", at, 8 + n, at + 8, n
            at += 8 + n
            continue
        if magic != MAGIC:
            raise corrupt("not an LZ4 frame")
        info, start = frame_info(data, at), at
        yield "header", at, info["header_size"], at, info["header_size"]
        at += info["header_size"]
        while True:
            if len(data) < at + 4:
                raise corrupt("LZ4 frame is truncated")
            word = struct.unpack_from("<I", data, at)[0]
            if not word:
                at += 4 + 4 * info["content_checksum"]
                break
            n = word & 0x7FFFFFFF
            total = 4 + n + 4 * info["block_checksum"]
            if len(data) < at + total:
                raise corrupt("LZ4 block is truncated")
            yield "raw" if word >> 31 else "block", at, total, at + 4, n
            at += total
        if at > len(data):
            raise corrupt("LZ4 frame is truncated")
        yield "frame", start, at - start, start, at - start
        if first:
            return


def _native_frames(data: bytes, o: dict) -> bytes:
    """Frames without dictionary, found by a walk and decoded by the library, which checks their sums and sizes."""
    out, most, frames, at = bytearray(), o["limits.max_output_bytes"], 0, 0
    if not data:
        raise corrupt("LZ4 frame is truncated")
    for kind, start, size, _, _ in walk(data, not o["lz4.concat"]):
        if kind == "header":
            info = frame_info(data, start)
            if o["limits.max_block_bytes"] and info["block_size"] > o["limits.max_block_bytes"]:
                raise CodecError(LIMIT, "block size")
        if kind == "frame":
            out += native.stream(data[start : start + size], "lz4", most - len(out) if most else 0)
            if most and len(out) > most:
                raise CodecError(LIMIT, f"more than {most} bytes of output")
            frames += 1
        at = start + size
    if o["lz4.concat"] and at < len(data):
        raise corrupt("bytes after the last frame")
    if not frames and at < len(data):
        raise corrupt("LZ4 frame is truncated")
    return bytes(out)


def decode(data: bytes, o: dict) -> bytes:
    if not o["lz4.dictionary"] and native.has("lz4"):
        return _native_frames(data, o)
    out, at, most, frames = bytearray(), 0, o["limits.max_output_bytes"], 0
    dictionary = (o["lz4.dictionary"] or b"")[-65536:]
    while at < len(data) or not frames:
        if len(data) < at + 4:
            raise corrupt("LZ4 frame is truncated")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if len(data) < at + 8 or len(data) < at + 8 + struct.unpack_from("<I", data, at + 4)[0]:
                raise corrupt("skippable frame is truncated")
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at >= len(data) and not frames:
                return bytes(out)
            continue
        if magic != MAGIC:
            raise corrupt("not an LZ4 frame")
        info = frame_info(data, at)
        if o["limits.max_block_bytes"] and info["block_size"] > o["limits.max_block_bytes"]:
            raise CodecError(LIMIT, "block size")
        at += info["header_size"]
        plain = bytearray(dictionary)
        while True:
            if len(data) < at + 4:
                raise corrupt("LZ4 frame is truncated")
            word = struct.unpack_from("<I", data, at)[0]
            at += 4
            if not word:
                break
            n = word & 0x7FFFFFFF
            block = data[at : at + n]
            if len(block) < n or n > info["block_size"]:
                raise corrupt("LZ4 block")
            at += n
            if info["block_checksum"]:
                if len(data) < at + 4 or struct.unpack_from("<I", data, at)[0] != xxh32(block):
                    raise corrupt("LZ4 block checksum")
                at += 4
            if word >> 31:
                plain += block
            elif info["independent"]:
                own = bytearray(dictionary)
                block_decode(block, own, info["block_size"])
                plain += own[len(dictionary) :]
            else:
                block_decode(block, plain, info["block_size"])
            if most and len(out) + len(plain) - len(dictionary) > most:
                raise CodecError(LIMIT, f"more than {most} bytes of output")
        part = bytes(plain[len(dictionary) :])
        if info["content_checksum"]:
            if len(data) < at + 4 or struct.unpack_from("<I", data, at)[0] != xxh32(part):
                raise corrupt("LZ4 content checksum")
            at += 4
        if info["content_size"] not in (None, len(part)):
            raise corrupt("LZ4 content size")
        out += part
        frames += 1
        if not o["lz4.concat"]:
            break
    return bytes(out)


def skippable(payload: bytes, variant: int = 0) -> bytes:
    if not 0 <= variant <= 15:
        raise CodecError(INVALID_ARG, "variants are 0 to 15")
    return struct.pack("<II", SKIPPABLE + variant, len(payload)) + payload
