"""Finite state entropy: normalised counts, the spread of symbols over states, and coding with them (as in RFC 8878)."""

from __future__ import annotations

from ..errors import INVALID_ARG, CodecError, corrupt


def normalised(counts: dict[int, int], log: int) -> dict[int, int]:
    """Counts scaled to a sum of 2^log, each at least 1; what rounding leaves goes to the most frequent symbol, the smallest of equals.

    Where that would leave it less than 1, the others give up one each, the
    largest first.
    """
    used = {s: n for s, n in counts.items() if n > 0}
    size, total = 1 << log, sum(used.values())
    if not used or len(used) > size:
        raise CodecError(INVALID_ARG, f"{len(used)} symbols for {size} states")
    out = {s: max(1, n * size // total) for s, n in used.items()}
    top = min(used, key=lambda s: (-used[s], s))
    out[top] += size - sum(out.values())
    while out[top] < 1:
        other = max((s for s in out if s != top), key=lambda s: (out[s], -s))
        out[other] -= 1
        out[top] += 1
    return out


def spread(norm: dict[int, int], log: int) -> list[int]:
    """The symbol of each state: symbols in their order take every (5/8 size + 3)-rd free state."""
    size = 1 << log
    step, at, out = (size >> 1) + (size >> 3) + 3, 0, [0] * size
    for s in sorted(norm):
        for _ in range(norm[s]):
            out[at] = s
            at = (at + step) & (size - 1)
    return out


def table(norm: dict[int, int], log: int) -> list[tuple[int, int, int]]:
    """(symbol, bits to read, base of the next state) of each state."""
    following, out = dict(norm), []
    for s in spread(norm, log):
        x = following[s]
        following[s] += 1
        bits = log - (x.bit_length() - 1)
        out.append((s, bits, (x << bits) - (1 << log)))
    return out


def encode(symbols: list[int], norm: dict[int, int], log: int) -> tuple[int, list[tuple[int, int]]]:
    """First state of the decoder, and the (value, bits) that it reads, in its order."""
    size = 1 << log
    states: dict[int, list[int]] = {s: [] for s in norm}
    for state, (s, _, _) in enumerate(table(norm, log)):
        states[s].append(state)
    state, out = None, []
    for s in reversed(symbols):
        if s not in norm:
            raise CodecError(INVALID_ARG, f"symbol {s} has no state")
        if state is None:
            state = states[s][0]
            continue
        whole, bits = state + size, 0
        while whole >> bits >= 2 * norm[s]:
            bits += 1
        out.append((whole & ((1 << bits) - 1), bits))
        state = states[s][(whole >> bits) - norm[s]]
    return state or 0, out[::-1]


def decode(first: int, read: list[tuple[int, int]], n: int, norm: dict[int, int], log: int) -> list[int]:
    steps, state, out, at = table(norm, log), first, [], 0
    while len(out) < n:
        s, bits, base = steps[state]
        out.append(s)
        if len(out) < n:
            if at >= len(read) or read[at][1] != bits:
                raise corrupt("bits of a state")
            state, at = base + read[at][0], at + 1
    return out
