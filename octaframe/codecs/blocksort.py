"""bzip2 over the standard library."""

from __future__ import annotations

import bz2

from ..errors import LIMIT, CodecError, corrupt


def encode(data: bytes, o: dict) -> bytes:
    return bz2.compress(data, o["bzip2.level"])


def decode(data: bytes, o: dict) -> bytes:
    """All concatenated streams; bytes after the last are an error."""
    out, most = bytearray(), o["limits.max_output_bytes"]
    while True:
        z, piece = bz2.BZ2Decompressor(), data
        while not z.eof:
            try:
                out += z.decompress(piece, most - len(out) + 1 if most else -1)
            except OSError as e:
                raise corrupt(str(e)) from e
            piece = b""
            if most and len(out) > most:
                raise CodecError(LIMIT, f"more than {most} bytes of output")
            if not z.eof and z.needs_input:
                raise corrupt("bzip2 stream is truncated")
        data = z.unused_data
        if not data:
            return bytes(out)
