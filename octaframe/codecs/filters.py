"""Reversible filters: delta and branch conversion.

Branch conversion of the six older architectures runs inside the standard
library: data compressed with [filter, LZMA2] and read with [LZMA2] alone is
the filtered data, and the other way round.
"""

from __future__ import annotations

import lzma

import numpy as np

from ..errors import UNSUPPORTED, CodecError

ARCHS = {"x86": 4, "powerpc": 5, "ia64": 6, "arm": 7, "armthumb": 8, "sparc": 9, "arm64": 10, "riscv": 11}
_LZMA2 = {"id": lzma.FILTER_LZMA2, "preset": 0}


def delta(data: bytes, distance: int, encode: bool) -> bytes:
    x = np.frombuffer(data, dtype=np.uint8)
    if encode:
        out = x.copy()
        out[distance:] -= x[:-distance] if len(x) > distance else x[:0]
        return out.tobytes()
    rows = -(-len(x) // distance)
    grid = np.zeros(rows * distance, dtype=np.uint8)
    grid[: len(x)] = x
    return np.cumsum(grid.reshape(rows, distance), axis=0, dtype=np.uint8).tobytes()[: len(x)]


def _arm64(data: bytes, start: int, encode: bool) -> bytes:
    """BL and ADRP targets, relative to absolute or back; instructions do not depend on each other."""
    n = len(data) // 4
    code = np.frombuffer(data, dtype="<u4", count=n).astype(np.uint64)
    pc = (np.arange(n, dtype=np.uint64) * np.uint64(4) + np.uint64(start)) & np.uint64(0xFFFFFFFF)
    u = np.uint64
    shift = lambda src, by: (src + by if encode else src - by) & u(0xFFFFFFFF)
    out = code.copy()
    call = code >> u(26) == u(0x25)
    out[call] = u(0x94000000) | (shift(code, pc >> u(2)) & u(0x03FFFFFF))[call]
    page = code & u(0x9F000000) == u(0x90000000)
    src = ((code >> u(29)) & u(3)) | ((code >> u(3)) & u(0x1FFFFC))
    page &= (src + u(0x20000)) & u(0x1C0000) == u(0)
    dest = shift(src, pc >> u(12))
    new = (code & u(0x9000001F)) | (dest & u(3)) << u(29) | (dest & u(0x3FFFC)) << u(3)
    new |= np.where(dest & u(0x20000), u(0xE00000), u(0))
    out[page] = new[page]
    return out.astype("<u4").tobytes() + data[4 * n :]


def bcj(data: bytes, arch: str, start: int, encode: bool) -> bytes:
    if arch == "arm64":
        return _arm64(data, start, encode)
    if arch == "riscv":
        raise CodecError(UNSUPPORTED, "branch conversion of riscv")
    both = [{"id": ARCHS[arch], "start_offset": start}, _LZMA2]
    first, second = (both, [_LZMA2]) if encode else ([_LZMA2], both)
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=first), lzma.FORMAT_RAW, filters=second)


def delta_encode(data: bytes, o: dict) -> bytes:
    return delta(data, o["delta.distance"], True)


def delta_decode(data: bytes, o: dict) -> bytes:
    return delta(data, o["delta.distance"], False)


def bcj_encode(data: bytes, o: dict) -> bytes:
    return bcj(data, o["bcj.arch"], o["bcj.start_offset"], True)


def bcj_decode(data: bytes, o: dict) -> bytes:
    return bcj(data, o["bcj.arch"], o["bcj.start_offset"], False)
