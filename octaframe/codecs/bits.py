"""Bit readers and writers, canonical codes, and a greedy match finder shared by the codecs."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from ..errors import corrupt


class LsbReader:
    """Bits from the low end of each byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.acc, self.n = data, at, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            if self.at >= len(self.data):
                raise corrupt("input ends within a code")
            self.acc |= self.data[self.at] << self.n
            self.at += 1
            self.n += 8

    def bits(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        out = self.acc & ((1 << n) - 1)
        self.acc >>= n
        self.n -= n
        return out

    def align(self) -> None:
        self.bits(self.n & 7)

    def raw(self, n: int) -> bytes:
        """n bytes from a byte boundary."""
        head = bytes(self.bits(8) for _ in range(min(n, self.n // 8)))
        rest = self.data[self.at : self.at + n - len(head)]
        if len(head) + len(rest) < n:
            raise corrupt("input ends within stored bytes")
        self.at += len(rest)
        return head + rest


class LsbWriter:
    def __init__(self):
        self.out, self.acc, self.n = bytearray(), 0, 0

    def bits(self, value: int, n: int) -> None:
        self.acc |= value << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.acc & 255)
            self.acc >>= 8
            self.n -= 8

    def raw(self, data: bytes) -> None:
        """Bytes at a byte boundary."""
        self.out += data

    def done(self) -> bytes:
        if self.n:
            self.out.append(self.acc & 255)
            self.acc = self.n = 0
        return bytes(self.out)


class MsbReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def bits(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise corrupt("input ends within a code")
            self.acc = (self.acc << 8) | self.data[self.at]
            self.at += 1
            self.n += 8
        self.n -= n
        out = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return out


class MsbWriter:
    def __init__(self):
        self.out, self.acc, self.n = bytearray(), 0, 0

    def bits(self, value: int, n: int) -> None:
        self.acc = (self.acc << n) | value
        self.n += n
        while self.n >= 8:
            self.n -= 8
            self.out.append(self.acc >> self.n)
            self.acc &= (1 << self.n) - 1

    def done(self) -> bytes:
        if self.n:
            self.out.append((self.acc << (8 - self.n)) & 255)
            self.acc = self.n = 0
        return bytes(self.out)


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) of the canonical prefix code with these lengths (0: unused)."""
    out, code, last = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        if code >> n:
            raise corrupt("code lengths oversubscribe the code space")
        out[symbol] = (code, n)
        code, last = code + 1, n
    return out


def reverse_bits(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


def limited_lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of an optimal prefix code of at most ``most`` bits: Huffman's, or by package-merge if that is too long.  Counts are positive."""
    n = len(counts)
    if n > 1 << most:
        raise ValueError(f"{n} symbols do not fit {most} bits")
    if n == 1:
        return [1]
    heap = [(c, i) for i, c in enumerate(counts)]
    heapify(heap)
    above = [0] * (2 * n - 1)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heappop(heap), heappop(heap)
        above[i] = above[j] = node
        heappush(heap, (a + b, node))
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[above[i]] + 1
    if max(depth[:n]) <= most:
        return depth[:n]
    leaves = sorted((c, (i,)) for i, c in enumerate(counts))
    level = leaves
    for _ in range(most - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = sorted(leaves + pairs, key=lambda x: x[0])
    out = [0] * n
    for _, symbols in level[: 2 * n - 2]:
        for i in symbols:
            out[i] += 1
    return out


#: Bits that a prefix code looks up at once.
_AT_ONCE = 9


class PrefixCode:
    """Decodes canonical codes, first bit most significant; ``flip`` inverts the bits.

    Codes of up to _AT_ONCE bits are looked up at once by the bits ahead, longer
    ones are followed bit by bit.
    """

    def __init__(self, lengths: list[int], flip: bool = False):
        self.table = {(n, c): s for s, (c, n) in canonical(lengths).items()}
        self.longest = max(lengths, default=0)
        self.flip = int(flip)
        self.ahead = min(self.longest, _AT_ONCE)
        self.mask = (1 << self.ahead) - 1
        self.turn = self.mask if flip else 0
        self.quick: list[tuple[int, int] | None] = [None] * (self.mask + 1)
        for (n, c), symbol in self.table.items():
            if n <= self.ahead:
                self.quick[reverse_bits(c, n) :: 1 << n] = [(symbol, n)] * (1 << self.ahead - n)

    def read(self, src: LsbReader) -> int:
        while src.n < self.ahead and src.at < len(src.data):
            src.acc |= src.data[src.at] << src.n
            src.at += 1
            src.n += 8
        told = self.quick[src.acc & self.mask ^ self.turn]
        if told is not None and told[1] <= src.n:
            src.acc >>= told[1]
            src.n -= told[1]
            return told[0]
        code = 0
        for n in range(1, self.longest + 1):
            code = (code << 1) | (src.bits(1) ^ self.flip)
            symbol = self.table.get((n, code))
            if symbol is not None:
                return symbol
        raise corrupt("no such prefix code")


def copy_match(out: bytearray, distance: int, length: int) -> None:
    """Append length bytes from distance back; the copy may overlap what it makes."""
    if distance > len(out):
        raise corrupt("distance reaches before the start")
    at = len(out) - distance
    if distance >= length:
        out += out[at : at + length]
    else:
        piece = bytes(out[at:])
        out += (piece * (length // distance + 1))[:length]


def greedy(data: bytes, start: int, window: int, least: int, longest: int, tail: int = 0):
    """Yield (literal start, literal end, distance, length); distance 0 ends the sequence.

    data[:start] is history.  No match reaches into the last ``tail`` bytes.
    """
    seen: dict[bytes, int] = {data[i : i + least]: i for i in range(max(0, start - window), start - least + 1)}
    at = anchor = start
    end = len(data)
    while at + least <= end - tail:
        key = data[at : at + least]
        was = seen.get(key)
        seen[key] = at
        if was is None or at - was > window:
            at += 1
            continue
        n, most = least, min(longest, end - tail - at)
        while n + 16 <= most and data[was + n : was + n + 16] == data[at + n : at + n + 16]:
            n += 16
        while n < most and data[was + n] == data[at + n]:
            n += 1
        yield anchor, at, at - was, n
        for i in range(at + 1, min(at + n, end - least + 1), 1 if n < 64 else 7):
            seen[data[i : i + least]] = i
        at = anchor = at + n
    yield anchor, end, 0, 0
