"""Checksums as pure functions of bytes; results are unsigned."""

from __future__ import annotations

import struct
import zlib

from ..errors import UNSUPPORTED, CodecError

_POLY64 = 0xC96C5795D7870F42
_P32 = (2654435761, 2246822519, 3266489917, 668265263, 374761393)
_P64 = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def crc32(data: bytes, value: int = 0) -> int:
    return zlib.crc32(data, value)


def adler32(data: bytes, value: int = 1) -> int:
    return zlib.adler32(data, value)


def adler32_combine(a: int, b: int, len_b: int) -> int:
    """Adler-32 of a concatenation from the sums of its parts."""
    base = 65521
    r = len_b % base
    s1 = ((a & 0xFFFF) + (b & 0xFFFF) - 1) % base
    s2 = ((a >> 16) + (b >> 16) + r * (a & 0xFFFF) - r) % base
    return s2 << 16 | s1


def _table(poly: int) -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (poly if i & 1 else 0)
        out.append(i)
    return out


_T64 = _table(_POLY64)


def crc64(data: bytes, value: int = 0) -> int:
    """CRC-64 as xz uses it."""
    table, crc = _T64, value ^ 0xFFFFFFFFFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFFFFFFFFFF


def bzip2_crc(data: bytes) -> int:
    """CRC-32 with the most significant bit first."""
    flipped = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
    return int(f"{zlib.crc32(data.translate(flipped)):032b}"[::-1], 2)


try:
    import xxhash as _xx
except ImportError:  # pragma: no cover
    _xx = None


def xxh32(data: bytes, seed: int = 0) -> int:
    return _xx.xxh32_intdigest(data, seed) if _xx else _xxh(data, seed, 32)


def xxh64(data: bytes, seed: int = 0) -> int:
    return _xx.xxh64_intdigest(data, seed) if _xx else _xxh(data, seed, 64)


def _xxh(data: bytes, seed: int, width: int) -> int:
    """XXH32 and XXH64 by their published definition, where the library is missing."""
    mask = (1 << width) - 1
    rot = lambda x, r: ((x << r) | (x >> (width - r))) & mask
    wide = width == 64
    p1, p2, p3, p4, p5 = _P64 if wide else _P32
    step, fmt, r1 = (8, "<4Q", 31) if wide else (4, "<4I", 13)
    round_ = lambda acc, lane: rot((acc + lane * p2) & mask, r1) * p1 & mask
    n, at = len(data), 0
    if n >= 4 * step:
        v = [(seed + p1 + p2) & mask, (seed + p2) & mask, seed, (seed - p1) & mask]
        while at + 4 * step <= n:
            v = [round_(a, x) for a, x in zip(v, struct.unpack_from(fmt, data, at), strict=True)]
            at += 4 * step
        h = sum(rot(x, r) for x, r in zip(v, (1, 7, 12, 18), strict=True)) & mask
        if wide:
            for x in v:
                h = ((h ^ round_(0, x)) * p1 + p4) & mask
    else:
        h = (seed + p5) & mask
    h = (h + n) & mask
    if wide:
        while at + 8 <= n:
            h = (rot(h ^ round_(0, struct.unpack_from("<Q", data, at)[0]), 27) * p1 + p4) & mask
            at += 8
        if at + 4 <= n:
            h = (rot(h ^ (struct.unpack_from("<I", data, at)[0] * p1 & mask), 23) * p2 + p3) & mask
            at += 4
    else:
        while at + 4 <= n:
            h = rot((h + struct.unpack_from("<I", data, at)[0] * p3) & mask, 17) * p4 & mask
            at += 4
    for b in data[at:]:
        h = rot(h ^ (b * p5 & mask), 11) * p1 & mask if wide else rot((h + b * p5) & mask, 11) * p1 & mask
    for shift, p in ((33, p2), (29, p3), (32, 1)) if wide else ((15, p2), (13, p3), (16, 1)):
        h = (h ^ (h >> shift)) * p & mask
    return h


class State:
    """A sum over bytes that arrive in pieces: reset, update, digest."""

    def __init__(self, kind: str, seed: int = 0):
        if kind not in ("xxh32", "xxh64", "crc32", "adler32"):
            raise CodecError(UNSUPPORTED, f"no running sum {kind}")
        self.kind, self.seed = kind, seed
        self.reset()

    def reset(self) -> None:
        library = {"xxh32": "xxh32", "xxh64": "xxh64"}.get(self.kind)
        if library and _xx:
            self._state = getattr(_xx, library)(seed=self.seed)
        else:  # without the library the bytes wait for digest()
            self._state = bytearray() if library else {"crc32": 0, "adler32": 1}[self.kind]

    def update(self, data: bytes) -> None:
        if self.kind == "crc32":
            self._state = crc32(data, self._state)
        elif self.kind == "adler32":
            self._state = adler32(data, self._state)
        elif _xx:
            self._state.update(data)
        else:
            self._state += data

    def digest(self) -> int:
        """The sum so far; more may follow."""
        if self.kind in ("crc32", "adler32"):
            return self._state
        return self._state.intdigest() if _xx else _xxh(bytes(self._state), self.seed, int(self.kind[3:]))
