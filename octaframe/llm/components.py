"""Connected components of a link table: contraction within bounded pieces, then star rounds.

Links are dealt into pieces of at most about PIECE rows, each contracted to a
forest of stars by a task of its own.  One piece is the answer; several go
through alternating star rounds, which use aggregates that combine on the map
side and joins on stored tables, and gather no group of neighbours.  Tables
between rounds go to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60
#: Links that one task contracts; a star of more is dealt over several tasks.
PIECE = 500_000


def reached(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches by left-right links), of nodes that reach a smaller one."""
    nodes, inverse = np.unique(np.r_[left, right], return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece of links (a, b) as stars: b is linked to the smallest id a that it reaches."""
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if held:
        b, a = reached(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.where("b > a").join(cut(least, "cc-least"), F.col("a") == F.col("u"))
    return joined.select(F.col("b").alias("b"), F.col("m").alias("a"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    joined = edges.join(cut(least, "cc-least"), F.col("b") == F.col("u"))
    moved = joined.where("a <> m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.union(least.select(F.col("u").alias("b"), F.col("m").alias("a")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids -> (id, component), component the smallest id reachable.

    Self links, repeated links and either order are fine; ids in null links are
    ignored.  Ids without links do not appear.  The result is stored.
    """
    ordered = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "cc-links")
    pieces = max(1, -(-ordered.count() // PIECE))
    dealt = ordered.repartition(1) if pieces == 1 else ordered.repartition(pieces, "a", "b")
    now = cut(dealt.mapInArrow(_contract, "a long, b long"), "cc-edges")
    if pieces > 1:
        now = _rounds(now.distinct())
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots)


def _rounds(now: DataFrame) -> DataFrame:
    """Star rounds until nothing changes: each id b is linked to the root a of its component."""
    mark = F.bit_xor(F.xxhash64("a", "b"))
    before = None
    for _ in range(MAX_ROUNDS):
        seen = tuple(now.agg(F.count("*"), mark).first())
        if seen[0] == 0 or seen == before:
            return now
        before = seen
        large = cut(_large_star(now).select("a", "b").distinct(), "cc-large")
        now = cut(_small_star(large).select("a", "b").distinct(), "cc-edges")
    raise RuntimeError(f"components: no fixed point after {MAX_ROUNDS} rounds")
