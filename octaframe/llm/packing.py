"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each at a cost.  Pieces go, largest
first, into the open sequence with the least room that takes them.  Where none
does, the length is opened whose cost for what it will hold, given what is
still to come, is least.  At the end every sequence shrinks to the shortest
permitted length that takes its contents.  Documents are dealt out by a hash
into shards of bounded size, each packed on its own; copies of a row are dealt
out in lots, so that many of them do not fill one shard.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, word_count

CAPACITIES = (256, 512, 1024, 2048, 4096, 8192)
#: Documents of a shard: large enough for a good fit, small enough for one task; and copies of one that go together.
SHARD, LOT = 20_000, 500


def cost(capacity: int) -> float:
    """Of a sequence: its length, attention that grows with the square, and a fixed part."""
    return capacity * (1 + capacity / 32768) + 32


def pack(sizes: np.ndarray, capacities=CAPACITIES, price: Callable[[int], float] = cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin, and final capacity of the bin for each piece; pieces have 1 to max(capacities) units.

    Equal sizes are taken in the order given.
    """
    caps = sorted(capacities)
    prices = [price(c) for c in caps]
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    open_rooms = 0  # bit r is set if a bin has r units of room
    left = int(sizes.sum())
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            best = min((p / min(c, left), -c) for c, p in zip(caps, prices, strict=True) if c >= n)
            b, r = len(used), -best[1]
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left -= n
        r -= n
        if r:
            by_room[r].append(b)
            open_rooms |= 1 << r
    final = np.array(caps)[np.searchsorted(caps, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, final[bins]


PACKED = "piece long, start long, length long, bin_id long, capacity long, offset long"


def _packer(capacities: tuple[int, ...]):
    top = max(capacities)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_id", "ascending"), ("_n", "ascending")])
        t = t.take(pa.array(np.repeat(np.arange(t.num_rows), t["_k"].to_numpy())))
        size = t["_n"].to_numpy()
        count = np.maximum(-(-size // top), 1)
        row = np.repeat(np.arange(len(size)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(top, size[row] - piece * top)
        full = np.flatnonzero(length > 0)
        bins, offsets, caps = pack(length[full], capacities)
        shard = int(t["_shard"][0].as_py())
        out = {n: np.zeros(len(row), np.int64) for n in ("bin_id", "capacity", "offset")}
        out["bin_id"][full], out["capacity"][full], out["offset"][full] = (shard << 32) + bins, caps, offsets
        none = length == 0
        return pa.table(
            {
                "_id": t["_id"].take(pa.array(row)),
                "piece": pa.array(piece, pa.int64()),
                "start": pa.array(piece * top, pa.int64()),
                "length": pa.array(length, pa.int64()),
                **{n: pa.array(v, pa.int64(), mask=none) for n, v in out.items()},
            }
        )

    return run


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row for each piece of a document: its id, piece, start, length (words), bin_id, capacity, offset.

    Documents of more words than the largest capacity are cut into pieces of that
    size and a rest; no word is lost.  Texts that are null, empty or without
    words give one piece of length 0 in no sequence.  Repeated rows are packed
    each, as are rows with a null id.  Of equal sizes the smaller id goes first.
    Other columns are not looked at; where the id's name is that of a result, the
    result's name gets an underscore.  An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    sized = cut(docs.select(F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("_n")), "pack-sizes")
    shards = max(1, -(-sized.count() // SHARD))
    lots = sized.groupBy("_id", "_n").agg(F.count("*").alias("_all"))
    last = F.floor((F.col("_all") - 1) / LOT)
    lots = lots.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    lots = lots.withColumn("_k", F.least(F.lit(LOT).cast("long"), F.col("_all") - F.col("_lot") * LOT))
    dealt = lots.select("_id", "_n", "_k", F.pmod(F.xxhash64("_id", "_n", "_lot", F.lit(11)), F.lit(shards)).alias("_shard"))
    packed = dealt.groupBy("_shard").applyInArrow(_packer(tuple(capacities)), f"_id {kind}, {PACKED}")
    return packed.toDF(id_col, *(c + "_" if c == id_col else c for c in packed.columns[1:]))
