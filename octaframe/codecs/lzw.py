"""LZW in the GIF and TIFF profiles."""

from __future__ import annotations

from ..errors import INVALID_ARG, LIMIT, CodecError, corrupt
from .bits import LsbReader, LsbWriter, MsbReader, MsbWriter


def _profile(o: dict) -> tuple[bool, int, int]:
    tiff, width = o["lzw.format"] == "tiff", o["lzw.lit_width"] if o["lzw.lit_width"] is not None else 8
    if not 2 <= width <= 8 or (tiff and width != 8):
        raise CodecError(INVALID_ARG, "lzw.lit_width")
    return tiff, width, o["lzw.max_code_bits"]


def encode(data: bytes, o: dict) -> bytes:
    tiff, lit, top = _profile(o)
    if data and max(data) >> lit:
        raise CodecError(INVALID_ARG, f"a byte of more than {lit} bits")
    w = MsbWriter() if tiff else LsbWriter()
    clear, early = 1 << lit, int(tiff)
    names: dict[tuple[int, int], int] = {}
    code, width, following = None, lit + 1, clear + 2
    w.bits(clear, width)
    for b in data:
        if code is None:
            code = b
            continue
        known = names.get((code, b))
        if known is not None:
            code = known
            continue
        w.bits(code, width)
        names[code, b] = following
        following += 1
        # The decoder's table is one entry behind.
        if following - 1 + early >= 1 << width and width < top:
            width += 1
        if following >= (1 << top) - early:
            w.bits(clear, width)
            names.clear()
            width, following = lit + 1, clear + 2
        code = b
    if code is not None:
        w.bits(code, width)
        following += 1
        if following - 1 + early >= 1 << width and width < top:
            width += 1
    w.bits(clear + 1, width)
    return w.done()


def decode(data: bytes, o: dict) -> bytes:
    tiff, lit, top = _profile(o)
    src = MsbReader(data) if tiff else LsbReader(data)
    clear, early, most = 1 << lit, int(tiff), o["limits.max_output_bytes"]
    out = bytearray()
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last = list(base), lit + 1, None
    while True:
        code = src.bits(width)
        if code == clear:
            table, width, last = list(base), lit + 1, None
            continue
        if code == clear + 1:
            return bytes(out)
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last is not None:
            entry = last + last[:1]
        else:
            raise corrupt("code beyond the table")
        out += entry
        if most and len(out) > most:
            raise CodecError(LIMIT, f"more than {most} bytes of output")
        if last is not None and len(table) < 1 << top:
            table.append(last + entry[:1])
        if len(table) + early >= 1 << width and width < top:
            width += 1
        last = entry
