"""DEFLATE, zlib and gzip over the standard library, and Deflate64."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections import Counter

from ..errors import INVALID_ARG, LIMIT, CodecError, corrupt
from .bits import LsbReader, LsbWriter, PrefixCode, canonical, copy_match, greedy, limited_lengths, reverse_bits

STRATEGIES = {"default": zlib.Z_DEFAULT_STRATEGY, "lazy": zlib.Z_DEFAULT_STRATEGY, "huffman_only": zlib.Z_HUFFMAN_ONLY, "rle": zlib.Z_RLE, "fixed": zlib.Z_FIXED}


def drain(z, data: bytes, most: int) -> bytes:
    """All output of a decompressor object, at most ``most`` bytes (0: no limit)."""
    out = bytearray()
    while True:
        try:
            out += z.decompress(data, most - len(out) + 1 if most else 1 << 22)
        except Exception as e:
            raise corrupt(str(e)) from e
        if most and len(out) > most:
            raise CodecError(LIMIT, f"more than {most} bytes of output")
        data = z.unconsumed_tail
        if z.eof or not data:
            if not z.eof and not data:
                try:
                    out += z.flush() if not most else z.flush(most - len(out) + 1)
                except Exception as e:
                    raise corrupt(str(e)) from e
                if most and len(out) > most:
                    raise CodecError(LIMIT, f"more than {most} bytes of output")
            if not z.eof:
                raise corrupt("stream is truncated")
            return bytes(out)


def _compress(data: bytes, o: dict, wbits: int, zdict: bytes | None) -> bytes:
    strategy = STRATEGIES[o["deflate.strategy"]]
    if o["deflate.window_bits"] == 8:  # the library has no window of 256; without matches none is needed
        strategy = zlib.Z_HUFFMAN_ONLY
    args = (o["deflate.level"], zlib.DEFLATED, wbits, 8, strategy)
    z = zlib.compressobj(*args, zdict) if zdict else zlib.compressobj(*args)
    return z.compress(data) + z.flush()


def deflate_encode(data: bytes, o: dict) -> bytes:
    return _compress(data, o, -max(9, o["deflate.window_bits"]), o["deflate.dictionary"])


def deflate_decode(data: bytes, o: dict) -> bytes:
    d = o["deflate.dictionary"]
    return drain(zlib.decompressobj(-15, d) if d else zlib.decompressobj(-15), data, o["limits.max_output_bytes"])


def zlib_encode(data: bytes, o: dict) -> bytes:
    return _compress(data, o, max(9, o["deflate.window_bits"]), o["zlib.dictionary"])


def zlib_decode(data: bytes, o: dict) -> bytes:
    d = o["zlib.dictionary"]
    if len(data) >= 2 and data[1] & 32 and not d:
        raise CodecError(INVALID_ARG, "the stream needs a dictionary")
    return drain(zlib.decompressobj(15, d) if d else zlib.decompressobj(15), data, o["limits.max_output_bytes"])


def gzip_header(o: dict) -> bytes:
    latin = lambda k: (o[k] or "").encode("latin-1", "strict")
    try:
        name, comment = latin("gzip.name"), latin("gzip.comment")
    except UnicodeEncodeError as e:
        raise CodecError(INVALID_ARG, "gzip names are Latin-1") from e
    if b"\0" in name + comment:
        raise CodecError(INVALID_ARG, "gzip names hold no zero byte")
    extra = o["gzip.extra"] or b""
    flags = o["gzip.text"] | o["gzip.header_crc"] << 1 | bool(extra) << 2 | bool(name) << 3 | bool(comment) << 4
    flags |= o["gzip.header_flags"] or 0
    level = o["deflate.level"]
    xfl = o["gzip.xfl"] if o["gzip.xfl"] is not None else 2 if level == 9 else 4 if level <= 1 else 0
    head = struct.pack("<4BIBB", 0x1F, 0x8B, 8, flags, o["gzip.mtime"], xfl, o["gzip.os"])
    if extra:
        head += struct.pack("<H", len(extra)) + extra
    head += name + b"\0" if name else b""
    head += comment + b"\0" if comment else b""
    return head + struct.pack("<H", zlib.crc32(head) & 0xFFFF) if o["gzip.header_crc"] else head


def gzip_encode(data: bytes, o: dict) -> bytes:
    body = _compress(data, o, -max(9, o["deflate.window_bits"]), None)
    return gzip_header(o) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def gzip_fields(data: bytes, at: int = 0) -> dict:
    """Header facts and where the body starts."""
    if len(data) - at < 10:
        raise corrupt("gzip header is truncated")
    m1, m2, method, flags, mtime, xfl, os_ = struct.unpack_from("<4BIBB", data, at)
    if (m1, m2, method) != (0x1F, 0x8B, 8) or flags & 0xE0:
        raise corrupt("not a gzip header")
    p, out = at + 10, {"mtime": mtime, "xfl": xfl, "os": os_, "flags": flags, "extra": None, "name": None, "comment": None}
    if flags & 4:
        if len(data) < p + 2:
            raise corrupt("gzip header is truncated")
        n = struct.unpack_from("<H", data, p)[0]
        out["extra"], p = data[p + 2 : p + 2 + n], p + 2 + n
    for bit, key in ((8, "name"), (16, "comment")):
        if flags & bit:
            end = data.find(b"\0", p)
            if end < 0:
                raise corrupt("gzip header is truncated")
            out[key], p = data[p:end].decode("latin-1"), end + 1
    if flags & 2:
        if len(data) < p + 2 or struct.unpack_from("<H", data, p)[0] != zlib.crc32(data[at:p]) & 0xFFFF:
            raise corrupt("gzip header checksum")
        p += 2
    if p > len(data):
        raise corrupt("gzip header is truncated")
    return out | {"body": p}


def gzip_decode(data: bytes, o: dict) -> bytes:
    out, at, most = bytearray(), 0, o["limits.max_output_bytes"]
    while True:
        head = gzip_fields(data, at)
        for key in ("name", "comment", "extra"):
            if head[key] is not None and len(head[key]) > o[f"gzip.max_{key}_bytes"]:
                raise CodecError(LIMIT, f"gzip {key} is too long")
        z = zlib.decompressobj(-15)
        part = drain(z, data[head["body"] :], most - len(out) if most else 0)
        rest = z.unused_data
        if len(rest) < 8:
            raise corrupt("gzip trailer is truncated")
        if struct.unpack("<II", rest[:8]) != (zlib.crc32(part), len(part) & 0xFFFFFFFF):
            raise corrupt("gzip checksum or size")
        out += part
        at = len(data) - len(rest) + 8
        if not o["gzip.concat"] or at >= len(data):
            return bytes(out)


# Deflate64: DEFLATE with a window of 64 KiB, lengths to 65538 and two more distance codes.
_LEN_EXTRA = [0] * 8 + [n for n in range(1, 6) for _ in range(4)]
# Fixed values of the format: the order of the code lengths' own code, the extra bits of lengths and distances, the fixed codes.
_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def _bases(first: int, extra: list[int]) -> list[int]:
    out = [first]
    for e in extra[:-1]:
        out.append(out[-1] + (1 << e))
    return out


_LENGTHS = [*zip(_bases(3, _LEN_EXTRA), _LEN_EXTRA, strict=True), (3, 16)]
_DIST_EXTRA = [0, 0, *(n for n in range(15) for _ in range(2))]
_DISTANCES = list(zip(_bases(1, _DIST_EXTRA), _DIST_EXTRA, strict=True))
_FIXED = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8


def deflate64_decode(data: bytes, o: dict) -> bytes:
    src, out, most = LsbReader(data), bytearray(), o["limits.max_output_bytes"]
    last = 0
    while not last:
        last, kind = src.bits(1), src.bits(2)
        if kind == 0:
            src.align()
            n, inverse = src.bits(16), src.bits(16)
            if n ^ inverse != 0xFFFF:
                raise corrupt("stored block length")
            out += src.raw(n)
        elif kind == 3:
            raise corrupt("reserved block type")
        else:
            literals, distances = (PrefixCode(_FIXED), PrefixCode([5] * 32)) if kind == 1 else _dynamic(src)
            while True:
                s = literals.read(src)
                if s < 256:
                    out.append(s)
                elif s == 256:
                    break
                else:
                    if s > 285:
                        raise corrupt("length code")
                    base, extra = _LENGTHS[s - 257]
                    n = base + src.bits(extra)
                    base, extra = _DISTANCES[distances.read(src)]
                    copy_match(out, base + src.bits(extra), n)
                if most and len(out) > most:
                    raise CodecError(LIMIT, f"more than {most} bytes of output")
        if most and len(out) > most:
            raise CodecError(LIMIT, f"more than {most} bytes of output")
    return bytes(out)


def _dynamic(src: LsbReader) -> tuple[PrefixCode, PrefixCode]:
    nl, nd, nc = src.bits(5) + 257, src.bits(5) + 1, src.bits(4) + 4
    meta = [0] * 19
    for i in range(nc):
        meta[_ORDER[i]] = src.bits(3)
    code, lengths = PrefixCode(meta), []
    while len(lengths) < nl + nd:
        s = code.read(src)
        if s < 16:
            lengths.append(s)
        elif s == 16:
            if not lengths:
                raise corrupt("repeat without a length")
            lengths += [lengths[-1]] * (3 + src.bits(2))
        else:
            lengths += [0] * (3 + src.bits(3) if s == 17 else 11 + src.bits(7))
    if len(lengths) > nl + nd:
        raise corrupt("too many code lengths")
    return PrefixCode(lengths[:nl]), PrefixCode(lengths[nl:])


def _stored(data: bytes) -> bytes:
    out = bytearray()
    for at in range(0, max(len(data), 1), 65535):
        piece = data[at : at + 65535]
        out += struct.pack("<BHH", at + 65535 >= len(data), len(piece), len(piece) ^ 0xFFFF) + piece
    return bytes(out)


#: Tokens of a block, about: codes are fitted to each block.
_BLOCK_TOKENS = 20_000
_STARTS = [b for b, _ in _DISTANCES]
_LENGTH_STARTS = [b for b, _ in _LENGTHS[:28]]


def _symbols(data: bytes, lo: int, hi: int, distance: int, n: int):
    """(literal or length symbol, extra, its bits, distance symbol, extra, its bits) of a run of literals and a match."""
    for b in data[lo:hi]:
        yield b, 0, 0, None, 0, 0
    if distance:
        k = 28 if n > 257 else bisect_right(_LENGTH_STARTS, n) - 1
        base, extra = _LENGTHS[k]
        d = bisect_right(_STARTS, distance) - 1
        yield 257 + k, n - base, extra, d, distance - _STARTS[d], _DISTANCES[d][1]


def _fitted(counts: Counter, symbols: int, most: int) -> list[int]:
    """Code lengths (0: unused) for the symbols that occur; two at least, since a code of one is not complete."""
    used = sorted(set(counts) | set([s for s in (0, 1) if s not in counts][: max(0, 2 - len(counts))]))
    out = [0] * symbols
    for s, n in zip(used, limited_lengths([max(1, counts[s]) for s in used], most), strict=True):
        out[s] = n
    return out


def _run_coded(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Lengths as (symbol, extra, its bits): runs of zeros by 17 and 18, repeats of the last length by 16."""
    out, at = [], 0
    while at < len(lengths):
        n, run = lengths[at], 1
        while at + run < len(lengths) and lengths[at + run] == n:
            run += 1
        at += run
        if n:
            out.append((n, 0, 0))
            run -= 1
        while run >= 3:
            if n:
                k = min(run, 6)
                out.append((16, k - 3, 2))
            else:
                k = min(run, 138)
                out.append((18, k - 11, 7) if k > 10 else (17, k - 3, 3))
            run -= k
        out += [(n, 0, 0)] * run
    return out


def _written(lengths: list[int]) -> dict[int, tuple[int, int]]:
    return {s: (reverse_bits(c, n), n) for s, (c, n) in canonical(lengths).items()}


def _block(w: LsbWriter, tokens: list[tuple], plain: bytes, last: bool) -> None:
    """A block in the form that takes the fewest bits: stored, with fixed codes, or with codes of its own."""
    main, far = Counter(t[0] for t in tokens), Counter(t[3] for t in tokens if t[3] is not None)
    main[256] += 1
    extra = sum(t[2] + t[5] for t in tokens)
    lengths, distances = _fitted(main, 286, 15), _fitted(far, 32, 15)
    nl = max(257, max(s for s, n in enumerate(lengths) if n) + 1)
    nd = max(s for s, n in enumerate(distances) if n) + 1
    coded = _run_coded(lengths[:nl] + distances[:nd])
    meta = _fitted(Counter(c[0] for c in coded), 19, 7)
    nc = max(4, max(i for i, s in enumerate(_ORDER) if meta[s]) + 1)
    own = 14 + 3 * nc + sum(meta[s] + bits for s, _, bits in coded) + sum(lengths[s] * n for s, n in main.items()) + sum(distances[s] * n for s, n in far.items())
    fixed = sum(_FIXED[s] * n for s, n in main.items()) + 5 * sum(far.values())
    stored = 8 * len(plain) + (7 + 32) * -(-len(plain) // 65535)
    if stored < min(own, fixed) + extra:
        pieces = [plain[at : at + 65535] for at in range(0, len(plain), 65535)]
        for k, piece in enumerate(pieces):
            w.bits(last and k == len(pieces) - 1, 3)
            w.bits(0, -w.n % 8)
            w.bits(len(piece) | (len(piece) ^ 0xFFFF) << 16, 32)
            w.raw(piece)
        return
    w.bits(last | (2 if own < fixed else 1) << 1, 3)
    if own < fixed:
        w.bits(nl - 257 | (nd - 1) << 5 | (nc - 4) << 10, 14)
        for s in _ORDER[:nc]:
            w.bits(meta[s], 3)
        codes = _written(meta)
        for s, x, bits in coded:
            w.bits(*codes[s])
            w.bits(x, bits)
    else:
        lengths, distances = _FIXED, [5] * 32
    first, second = _written(lengths), _written(distances)
    for s, x, xn, d, y, yn in tokens:
        c, n = first[s]
        w.bits(c | x << n, n + xn)
        if d is not None:
            c, n = second[d]
            w.bits(c | y << n, n + yn)
    w.bits(*first[256])


def deflate64_encode(data: bytes, o: dict) -> bytes:
    """Blocks of about _BLOCK_TOKENS tokens, each in its shortest form; level 0 stores."""
    if o["deflate64.level"] == 0 or not data:
        return _stored(data)
    w, tokens, start, end = LsbWriter(), [], 0, 0
    for lo, hi, distance, n in greedy(data, 0, 65536, 4, 65538):
        for at in range(lo, max(hi, lo + 1), _BLOCK_TOKENS):
            if len(tokens) >= _BLOCK_TOKENS:
                _block(w, tokens, data[start:end], False)
                tokens, start = [], end
            stop = min(hi, at + _BLOCK_TOKENS)
            ends = stop == hi
            tokens += _symbols(data, at, stop, distance if ends else 0, n)
            end = stop + (n if ends else 0)
    _block(w, tokens, data[start:end], True)
    return min(w.done(), _stored(data), key=len)
