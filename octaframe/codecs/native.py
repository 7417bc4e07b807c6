"""Codecs that the Arrow library brings along, used where the installed build has them."""

from __future__ import annotations

from functools import cache

from ..errors import LIMIT, CodecError, corrupt

try:
    import pyarrow as pa
except ImportError:  # pragma: no cover
    pa = None


@cache
def has(name: str) -> bool:
    return pa is not None and pa.Codec.is_available(name)


def packed(data: bytes, name: str, level: int | None = None) -> bytes:
    return pa.Codec(name, compression_level=level).compress(data, asbytes=True)


def stream(data: bytes, name: str, most: int) -> bytes:
    """All of a compressed stream, at most ``most`` bytes (0: no limit)."""
    out = bytearray()
    try:
        src = pa.CompressedInputStream(pa.BufferReader(data), name)
        while piece := src.read(1 << 20):
            out += piece
            if most and len(out) > most:
                raise CodecError(LIMIT, f"more than {most} bytes of output")
    except OSError as e:
        raise corrupt(str(e)) from e
    return bytes(out)
