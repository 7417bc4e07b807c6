"""Brotli: the Arrow library's codec, and stored meta-blocks of our own for level 0 or where it is missing.

Compressed streams state the library's window of 22 bits; brotli.lgwin holds
for stored streams.
"""

from __future__ import annotations

from ..errors import LIMIT, UNSUPPORTED, CodecError, corrupt
from . import native
from .bits import LsbReader, LsbWriter

CHUNK = 65536


def _window(w: LsbWriter, bits: int) -> None:
    if bits == 16:
        w.bits(0, 1)
    elif bits == 17:
        w.bits(1, 7)
    elif bits > 17:
        w.bits(1 | (bits - 17) << 1, 4)
    else:
        w.bits(1 | (bits - 8) << 4, 7)


def encode(data: bytes, o: dict) -> bytes:
    if o["brotli.level"] and native.has("brotli"):
        return native.packed(data, "brotli", o["brotli.level"])
    w = LsbWriter()
    _window(w, o["brotli.lgwin"])
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK]
        w.bits(0, 3)  # not the last, four nibbles of length
        w.bits(len(piece) - 1, 16)
        w.bits(1, 1)
        w.bits(0, -w.n % 8)
        w.out += piece
    w.bits(3, 2)
    return w.done()


def window_bits(src: LsbReader) -> int:
    if not src.bits(1):
        return 16
    n = src.bits(3)
    if n:
        return 17 + n
    n = src.bits(3)
    if n == 1:
        raise corrupt("window of a later format")
    return 8 + n if n else 17


def decode(data: bytes, o: dict) -> bytes:
    src, out, most = LsbReader(data), bytearray(), o["limits.max_output_bytes"]
    window = 1 << window_bits(src)
    if o["limits.max_window_bytes"] and window > o["limits.max_window_bytes"]:
        raise CodecError(LIMIT, "window size")
    if native.has("brotli"):
        return native.stream(data, "brotli", most)
    while True:
        last = src.bits(1)
        if last and src.bits(1):
            return bytes(out)
        nibbles = src.bits(2)
        if nibbles == 3:
            if src.bits(1):
                raise corrupt("reserved bit")
            n = src.bits(2)
            skip = src.bits(8 * n) + 1 if n else 0
            src.align()
            src.raw(skip)
            if last:
                return bytes(out)
            continue
        n = src.bits(4 * (nibbles + 4)) + 1
        if last or not src.bits(1):
            raise CodecError(UNSUPPORTED, "a compressed meta-block")
        src.align()
        out += src.raw(n)
        if most and len(out) > most:
            raise CodecError(LIMIT, f"more than {most} bytes of output")
