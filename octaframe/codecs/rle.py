"""Run-length coding in the PackBits and TGA profiles."""

from __future__ import annotations

import re

import numpy as np

from ..errors import LIMIT, CodecError, corrupt

_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def encode(data: bytes, o: dict) -> bytes:
    """Runs of two or more become run tokens, the rest literals; both hold 128 bytes at most."""
    tga, out, at = o["rle.format"] == "tga", bytearray(), 0

    def literals(piece: bytes) -> None:
        for i in range(0, len(piece), 128):
            part = piece[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        start, end = m.span()
        # A single byte that is left over from a run of 128 k + 1 is the first of the next literals.
        literals(data[at:start])
        while end - start >= 2:
            n = min(128, end - start)
            out.append(0x80 | n - 1 if tga else 257 - n)
            out.append(data[start])
            start += n
        at = start
    literals(data[at:])
    return bytes(out)


def decode(data: bytes, o: dict) -> bytes:
    tga, out, at, most = o["rle.format"] == "tga", bytearray(), 0, o["limits.max_output_bytes"]
    while at < len(data):
        token = data[at]
        at += 1
        if token == 128 and not tga:
            continue
        if token >= 128:
            if at >= len(data):
                raise corrupt("run without a byte")
            out += data[at : at + 1] * ((token & 127) + 1 if tga else 257 - token)
            at += 1
        else:
            part = data[at : at + token + 1]
            if len(part) <= token:
                raise corrupt("literals end early")
            out += part
            at += token + 1
        if most and len(out) > most:
            raise CodecError(LIMIT, f"more than {most} bytes of output")
    return bytes(out)


def size(data: bytes) -> int:
    """Bytes that the encoder makes of data in either profile, from the lengths of its runs alone."""
    x = np.frombuffer(data, dtype=np.uint8)
    same = np.r_[False, x[1:] == x[:-1], False]
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2] + 1
    runs = ends - starts
    # A single byte that is left over from a run of 128 k + 1 is the first of the next literals.
    literals = np.r_[starts, len(x)] - np.r_[0, ends - (runs % 128 == 1)]
    return int((literals + (literals + 127) // 128).sum() + 2 * ((runs + 126) // 128).sum())


def rle1_encode(data: bytes) -> bytes:
    """The run stage of bzip2: four to 255 equal bytes become four and a count of the rest."""
    out = bytearray()
    for m in re.finditer(rb"(.)\1*", data, re.S):
        b, n = m[1], m.end() - m.start()
        full, rest = divmod(n, 255)
        out += (b * 4 + b"\xfb") * full + (b * rest if rest < 4 else b * 4 + bytes([rest - 4]))
    return bytes(out)


def rle1_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        b = data[at : at + 1]
        n = 1
        while n < 4 and data[at + n : at + n + 1] == b:
            n += 1
        at += n
        out += b * n
        if n == 4:
            if at >= len(data):
                raise corrupt("run without its count")
            out += b * data[at]
            at += 1
    return bytes(out)
