"""The early ZIP methods shrink, reduce and implode, from their published description."""

from __future__ import annotations

from collections import Counter, defaultdict

from ..errors import INVALID_ARG, LIMIT, CodecError, corrupt
from .bits import LsbReader, LsbWriter, PrefixCode, canonical, copy_match, greedy, limited_lengths, reverse_bits


def _full(out: bytearray, most: int) -> None:
    if most and len(out) > most:
        raise CodecError(LIMIT, f"more than {most} bytes of output")


# --- shrink: LZW with codes of 9 to 13 bits; code 256 announces a wider code or a partial clear


def shrink_encode(data: bytes, o: dict) -> bytes:
    w, names, following, width, code = LsbWriter(), {}, 257, 9, None
    for b in data:
        if code is None:
            code = b
            continue
        known = names.get((code, b))
        if known is not None:
            code = known
            continue
        while code >> width:
            w.bits(256, width)
            w.bits(1, width)
            width += 1
        w.bits(code, width)
        if following < 1 << 13:
            names[code, b] = following
            following += 1
        code = b
    if code is not None:
        while code >> width:
            w.bits(256, width)
            w.bits(1, width)
            width += 1
        w.bits(code, width)
    return w.done()


def shrink_decode(data: bytes, o: dict) -> bytes:
    src, out, most, width = LsbReader(data), bytearray(), o["limits.max_output_bytes"], 9
    parent: dict[int, int] = {}
    final: dict[int, int] = {}
    following, last, first = 257, None, 0

    def spelled(code: int) -> bytes:
        text, steps = bytearray(), 0
        while code > 256:
            if code not in parent or steps > 1 << 13:
                raise corrupt("code of no string")
            text.append(final[code])
            code, steps = parent[code], steps + 1
        text.append(code)
        return bytes(text[::-1])

    while src.n + 8 * (len(data) - src.at) >= width:
        code = src.bits(width)
        if code == 256:
            what = src.bits(width)
            if what == 1:
                width += 1
                if width > 13:
                    raise corrupt("code of more than 13 bits")
            elif what == 2:
                used = set(parent.values())
                for c in [c for c in parent if c not in used]:
                    del parent[c], final[c]
                following = 257
            else:
                raise corrupt("control code")
            continue
        if last is None:
            if code > 255:
                raise corrupt("first code is no byte")
            out.append(code)
            last, first = code, code
            continue
        text = spelled(code) if code < 256 or code in parent else spelled(last) + bytes([first])
        first = text[0]
        while following in parent:
            following += 1
        if following < 1 << 13:
            parent[following], final[following] = last, first
        out += text
        last = code
        _full(out, most)
    return bytes(out)


# --- reduce: an LZ stage with byte tokens, then follower sets by the previous byte

_DLE = 144


def _reduce_tokens(data: bytes, factor: int) -> bytes:
    out, top = bytearray(), (1 << 8 - factor) - 1
    for lo, hi, distance, n in greedy(data, 0, 256 << factor, 4, top + 3 + 255):
        for b in data[lo:hi]:
            out += bytes((_DLE, 0)) if b == _DLE else bytes((b,))
        if distance:
            d, m = distance - 1, n - 3
            v = (d >> 8) << 8 - factor | min(m, top)
            out += bytes((_DLE, v)) + (bytes((m - top,)) if m >= top else b"") + bytes((d & 255,))
    return bytes(out)


def _index_bits(n: int) -> int:
    return max(1, (n - 1).bit_length())


def reduce_encode(data: bytes, o: dict) -> bytes:
    inner, counts = _reduce_tokens(data, o["reduce.factor"]), defaultdict(Counter)
    for p, b in zip(b"\0" + inner, inner, strict=False):
        counts[p][b] += 1
    followers = [[b for b, c in sorted(counts[p].items(), key=lambda x: (-x[1], x[0])) if c >= 3][:32] for p in range(256)]
    w = LsbWriter()
    for p in range(255, -1, -1):
        w.bits(len(followers[p]), 6)
        for b in followers[p]:
            w.bits(b, 8)
    at = [{b: i for i, b in enumerate(f)} for f in followers]
    last = 0
    for b in inner:
        f = followers[last]
        if not f:
            w.bits(b, 8)
        elif b in at[last]:
            w.bits(0, 1)
            w.bits(at[last][b], _index_bits(len(f)))
        else:
            w.bits(1, 1)
            w.bits(b, 8)
        last = b
    return w.done()


def reduce_decode(data: bytes, o: dict) -> bytes:
    """Stops at reduce.uncompressed_size; without it, where whole tokens end."""
    src, out, most, factor = LsbReader(data), bytearray(), o["limits.max_output_bytes"], o["reduce.factor"]
    size = o["reduce.uncompressed_size"] or None
    if not data and not size:
        return b""
    followers: list[list[int]] = [[] for _ in range(256)]
    for p in range(255, -1, -1):
        n = src.bits(6)
        if n > 32:
            raise corrupt("follower set of more than 32")
        followers[p] = [src.bits(8) for _ in range(n)]
    top, last, state, v, length = (1 << 8 - factor) - 1, 0, 0, 0, 0
    while size is None or len(out) < size:
        f = followers[last]
        left = src.n + 8 * (len(data) - src.at)
        if size is None and left < (8 if not f else 1 + _index_bits(len(f))):
            break
        try:
            b = src.bits(8) if not f or src.bits(1) else f[src.bits(_index_bits(len(f)))]
        except IndexError as e:
            raise corrupt("no such follower") from e
        except CodecError:
            if size is None:
                break
            raise
        last = b
        if state == 0:
            if b == _DLE:
                state = 1
            else:
                out.append(b)
        elif state == 1:
            if b == 0:
                out.append(_DLE)
                state = 0
            else:
                v, length = b, b & top
                state = 2 if length == top else 3
        elif state == 2:
            length, state = length + b, 3
        else:
            distance = ((v >> 8 - factor) << 8) + b + 1
            missing = min(max(0, distance - len(out)), length + 3)
            out += bytes(missing)  # before the start there are zeros
            if length + 3 > missing:
                copy_match(out, distance, length + 3 - missing)
            state = 0
        _full(out, most)
    return bytes(out[:size] if size is not None else out)


# --- implode: sliding dictionary of 4 or 8 KiB and two or three prefix codes


def _write_tree(w: LsbWriter, lengths: list[int]) -> None:
    runs: list[list[int]] = []
    for n in lengths:
        if runs and runs[-1][0] == n and runs[-1][1] < 16:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
    w.bits(len(runs) - 1, 8)
    for n, k in runs:
        w.bits((k - 1) << 4 | n - 1, 8)


def _read_tree(src: LsbReader, symbols: int) -> PrefixCode:
    lengths: list[int] = []
    for _ in range(src.bits(8) + 1):
        b = src.bits(8)
        lengths += [(b & 15) + 1] * ((b >> 4) + 1)
    if len(lengths) != symbols:
        raise corrupt("code lengths of a tree")
    return PrefixCode(lengths, flip=True)


def _fitted(counts: Counter, symbols: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Lengths of 1 to 16 bits for all symbols, the frequent ones short, and the codes as they are written."""
    lengths = limited_lengths([counts[s] + 1 for s in range(symbols)], 16)
    return lengths, {s: (reverse_bits(c ^ ((1 << n) - 1), n), n) for s, (c, n) in canonical(lengths).items()}


def implode_encode(data: bytes, o: dict) -> bytes:
    w, tree = LsbWriter(), o["implode.literal_tree"]
    low = {4096: 6, 8192: 7}.get(o["implode.dictionary_size"])
    if low is None:
        raise CodecError(INVALID_ARG, "implode.dictionary_size is 4096 or 8192")
    least = 3 if tree else 2
    tokens = list(greedy(data, 0, 64 << low, least + 1, least + 63 + 255))
    matches = [(distance - 1, n - least) for _, _, distance, n in tokens if distance]
    literals: Counter = Counter()
    for lo, hi, _, _ in tokens:
        literals.update(data[lo:hi])
    lit_lengths, lit = _fitted(literals, 256)
    lengths, length = _fitted(Counter(min(m, 63) for _, m in matches), 64)
    places, place = _fitted(Counter(d >> low for d, _ in matches), 64)
    if tree:
        _write_tree(w, lit_lengths)
    _write_tree(w, lengths)
    _write_tree(w, places)
    for lo, hi, distance, n in tokens:
        for b in data[lo:hi]:
            w.bits(1, 1)
            w.bits(*(lit[b] if tree else (b, 8)))
        if distance:
            w.bits(0, 1)
            w.bits((distance - 1) & ((1 << low) - 1), low)
            w.bits(*place[(distance - 1) >> low])
            m = n - least
            w.bits(*length[min(m, 63)])
            if m >= 63:
                w.bits(m - 63, 8)
    return w.done()


def implode_decode(data: bytes, o: dict) -> bytes:
    """Stops at implode.uncompressed_size; without it, where less than a whole token is left."""
    src, out, most, tree = LsbReader(data), bytearray(), o["limits.max_output_bytes"], o["implode.literal_tree"]
    low = {4096: 6, 8192: 7}.get(o["implode.dictionary_size"])
    if low is None:
        raise CodecError(INVALID_ARG, "implode.dictionary_size is 4096 or 8192")
    size = o["implode.uncompressed_size"] or None
    literals = _read_tree(src, 256) if tree else None
    lengths, distances = _read_tree(src, 64), _read_tree(src, 64)
    least = 3 if tree else 2
    while size is None or len(out) < size:
        if size is None and src.n + 8 * (len(data) - src.at) < 8:
            break
        if src.bits(1):
            out.append(literals.read(src) if literals else src.bits(8))
        else:
            d = src.bits(low)
            d |= distances.read(src) << low
            n = lengths.read(src)
            n += src.bits(8) if n == 63 else 0
            n += least
            missing = min(max(0, d + 1 - len(out)), n)
            out += bytes(missing)
            if n > missing:
                copy_match(out, d + 1, n - missing)
        _full(out, most)
    return bytes(out[:size] if size is not None else out)
