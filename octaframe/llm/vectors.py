"""Operators on embedding vectors: epsilon grid order join and exact top-k search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import components

# --- epsilon grid order join -------------------------------------------------

#: Vectors on which the principal axes are fitted (they steer pruning, not results).
AXES_SAMPLE = 8192
#: Leading principal axes that the grid has.
GRID_DIMS = 4
#: Vectors in a stored sequence interval, and in the intervals at which recursion ends.
INTERVAL, LEAF = 1024, 64
#: Bytes of neighbouring intervals that travel together, about, and are joined with those of another such tile.
TILE_BYTES = 4 << 20
#: What double arithmetic may be off by, far above its error for unit vectors.
SLACK = 1e-9


def usable(v: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False))


def _axes(rows: DataFrame) -> np.ndarray:
    """Leading principal axes, as columns, of a hash sample of bounded size of the most common dimension."""
    by_dim = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if by_dim is None:
        return np.zeros((0, 0))
    share = min(1.0, AXES_SAMPLE / by_dim["count"])
    key = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    got = rows.where((F.size("vec") == by_dim["d"]) & (key < int(share * (1 << 20)) + 1)).select("vec").limit(2 * AXES_SAMPLE)
    x = _unit(np.array([r.vec for r in got.toLocalIterator()], dtype=np.float64).reshape(-1, by_dim["d"]))
    if not len(x):
        return np.eye(by_dim["d"])[:, :GRID_DIMS]
    _, vectors = np.linalg.eigh(np.cov(x.T, bias=True) if len(x) > 1 else np.eye(by_dim["d"]))
    return np.ascontiguousarray(vectors[:, ::-1][:, :GRID_DIMS])


def _unit(x: np.ndarray) -> np.ndarray:
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _placed(axes: np.ndarray, eps: float):
    """Add the dimension and the grid cells of unit vectors on the principal axes; other dimensions use their own first axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.zeros((b.num_rows, GRID_DIMS), dtype=np.int64)
            values = b.column(3)
            sizes = np.diff(values.offsets.to_numpy())
            flat = values.flatten().to_numpy()
            at = np.r_[0, np.cumsum(sizes)]
            for d in np.unique(sizes):
                pick = np.flatnonzero(sizes == d)
                x = _unit(flat[at[pick][:, None] + np.arange(d)])
                y = x @ axes if d == axes.shape[0] else x[:, :GRID_DIMS]
                cells[pick[:, None], np.arange(y.shape[1])] = np.floor(y / eps).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sizes, pa.int32()), *(pa.array(c) for c in cells.T)],
                names=["id", "label", "copies", "vec", "dim", *(f"c{i}" for i in range(GRID_DIMS))],
            )

    return run


INTERVALS = "iid long, tile long, label int, dim int, lo array<long>, hi array<long>, ids binary, copies binary, cells binary, vecs binary"


def _intervals(interval: int, tile_bytes: int):
    """Cut the sorted rows of a partition into intervals of one label and dimension, and these into tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tile, held = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            col = dict(zip(b.schema.names, b.columns, strict=True))
            label, dim, ids, copies = (col[c].to_numpy() for c in ("label", "dim", "id", "copies"))
            cells = np.stack([col[f"c{i}"].to_numpy() for i in range(GRID_DIMS)], axis=1)
            flat = col["vec"].flatten().to_numpy()
            at = np.r_[0, np.cumsum(dim)]
            starts = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (dim[1:] != dim[:-1])]) if len(ids) else []
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                for x in range(s, e, interval):
                    y = min(e, x + interval)
                    size = 8 * int(at[y] - at[x])
                    if held and held + size > tile_bytes:
                        tile, held = tile + 1, 0
                    held += size
                    key = xxhash.xxh3_64_intdigest(ids[x:y].tobytes() + flat[at[x] : at[y]].tobytes() + label[x : x + 1].tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key - (1 << 64) if key >> 63 else key], pa.int64()),
                            pa.array([part + tile], pa.int64()),
                            pa.array([label[x]], pa.int32()),
                            pa.array([dim[x]], pa.int32()),
                            pa.array([cells[x:y].min(axis=0).tolist()], pa.list_(pa.int64())),
                            pa.array([cells[x:y].max(axis=0).tolist()], pa.list_(pa.int64())),
                            pa.array([ids[x:y].tobytes()], pa.binary()),
                            pa.array([copies[x:y].tobytes()], pa.binary()),
                            pa.array([cells[x:y].tobytes()], pa.binary()),
                            pa.array([flat[at[x] : at[y]].tobytes()], pa.binary()),
                        ],
                        names=["iid", "tile", "label", "dim", "lo", "hi", "ids", "copies", "cells", "vecs"],
                    )

    return run


class _Side:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.copies = np.frombuffer(row["copies"], dtype=np.int64)
        self.cells = np.frombuffer(row["cells"], dtype=np.int64).reshape(len(self.ids), -1)
        self.x = _unit(np.frombuffer(row["vecs"], dtype=np.float64).reshape(len(self.ids), -1))


class _Join:
    """Recursive join of two sequence intervals."""

    def __init__(self, a: _Side, b: _Side, same: bool, least: float, end: int):
        self.a, self.b, self.same, self.least, self.end = a, b, same, least, end
        self.links_a, self.links_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        n = len(a.ids) + (0 if same else len(b.ids))
        self.parent = list(range(n))
        self.off = 0 if same else len(a.ids)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def run(self, a0: int, a1: int, b0: int, b1: int) -> None:
        ca, cb = self.a.cells[a0:a1], self.b.cells[b0:b1]
        # Cells two apart on any axis are more than epsilon apart.
        if (np.maximum(cb.min(axis=0) - ca.max(axis=0), ca.min(axis=0) - cb.max(axis=0)) > 1).any():
            return
        if a1 - a0 <= self.end and b1 - b0 <= self.end:
            self.leaf(a0, a1, b0, b1)
            return
        halves_a = [(a0, a1)] if a1 - a0 <= self.end else [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)]
        halves_b = [(b0, b1)] if b1 - b0 <= self.end else [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)]
        for x in halves_a:
            for y in halves_b:
                if not self.same or x[0] <= y[0]:
                    self.run(*x, *y)

    def leaf(self, a0: int, a1: int, b0: int, b1: int) -> None:
        close = self.a.x[a0:a1] @ self.b.x[b0:b1].T >= self.least
        if self.same and a0 == b0:
            close = np.triu(close, 1)
        if not close.any():
            return
        self.links_a[a0:a1] += close @ self.b.copies[b0:b1]
        self.links_b[b0:b1] += self.a.copies[a0:a1] @ close
        # A forest is enough: only columns in another tree than the row are looked at.
        tree = np.array([self.root(self.off + j) for j in range(b0, b1)])
        for i in np.flatnonzero(close.any(axis=1)):
            p = self.root(a0 + int(i))
            for j in np.flatnonzero(close[i] & (tree != p)):
                q = self.root(self.off + b0 + int(j))
                if p != q:
                    top = min(p, q)
                    self.parent[max(p, q)] = top
                    tree[(tree == p) | (tree == q)] = top
                    p = top
                    self.edges.append((int(self.a.ids[a0 + i]), int(self.b.ids[b0 + j])))


FOUND = "id long, links long, other long"


def _joined(least: float, end: int):
    """Rows (id, links, null) add links to a vector; rows (id, 0, other) are a forest of links."""

    def run(unit: pa.Table) -> pa.Table:
        """The intervals of one tile among themselves, or of two with each other."""
        rows = sorted(unit.to_pylist(), key=lambda r: (r["tile"], r["iid"]))
        sides = [_Side(r) for r in rows]
        one, out = rows[0]["ta"] == rows[0]["tb"], []
        for i, a in enumerate(rows):
            for j in range(i, len(rows)):
                b = rows[j]
                if (a["label"], a["dim"]) != (b["label"], b["dim"]) or (not one and a["tile"] == b["tile"]):
                    continue
                join = _Join(sides[i], sides[j], i == j, least, end)
                join.run(0, len(sides[i].ids), 0, len(sides[j].ids))
                ids, links = (sides[i].ids, join.links_a + join.links_b) if i == j else (np.r_[sides[i].ids, sides[j].ids], np.r_[join.links_a, join.links_b])
                some = np.flatnonzero(links)
                left, right = ([e[k] for e in join.edges] for k in (0, 1))
                out.append((np.r_[ids[some], np.array(left, np.int64)], np.r_[links[some], np.zeros(len(left), np.int64)], [None] * len(some) + right))
        if not out:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        ids, links = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "other": pa.array([o for x in out for o in x[2]], pa.int64())})

    return run


def epsilon_join(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Vectors of one label and one dimension are linked at a cosine of ``least``
    (above 0) or more.  Vectors that are null, empty, zero, or hold null or
    non-finite components, and those with a null label or id, have no links and
    are components of their own (with a null id: null, kept).  Equal vectors of
    a label are joined once and counted as often as they occur.  Repeated rows
    count as vectors of their own in n_links; different vectors under one id are
    one node.  A cosine of exactly ``least`` links, ties need no order.  Vectors of
    any length are taken whole, in tiles of bounded bytes.  Other columns are not
    looked at, whatever their names.  An empty table gives an empty result.
    """
    eps = float(np.sqrt(2 - 2 * least)) + SLACK
    plain = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    good = usable(F.col("vec")) & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = plain.where(F.coalesce(good, F.lit(False))).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    # The vector as text would be lossy and long; equal vectors have equal bytes once -0.0 is gone.
    unique = rows.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    unique = cut(unique, "ego-unique")
    cells = [f"c{i}" for i in range(GRID_DIMS)]
    schema = "id long, label int, copies long, vec array<double>, dim int, " + ", ".join(f"{c} long" for c in cells)
    placed = unique.select("id", "label", "copies", "vec").mapInArrow(_placed(_axes(unique), eps), schema)
    parts = max(1, min(10_000, -(-unique.count() // (8 * INTERVAL))))
    order = ["label", "dim", *cells, "id"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    intervals = cut(ordered.mapInArrow(_intervals(INTERVAL, TILE_BYTES), INTERVALS), "ego-intervals")
    boxes = cut(intervals.select("iid", "tile", "label", "dim", "lo", "hi"), "ego-boxes")
    # Intervals that may touch on the first axis meet in a common cell; then all axes are held against each other.
    reach = boxes.withColumn("cell", F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0] + 1)))
    far = boxes.select(
        F.col("iid").alias("iid2"), F.col("tile").alias("tile2"), F.col("label").alias("l2"), F.col("dim").alias("d2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")
    ).withColumn("cell2", F.explode(F.sequence(F.col("lo2")[0], F.col("hi2")[0] + 1)))
    touch = (F.col("label") == F.col("l2")) & (F.col("dim") == F.col("d2")) & (F.col("cell") == F.col("cell2")) & (F.col("iid") <= F.col("iid2"))
    for k in range(GRID_DIMS):
        touch &= (F.col("lo2")[k] - F.col("hi")[k] <= 1) & (F.col("lo")[k] - F.col("hi2")[k] <= 1)
    pairs = cut(reach.join(far, touch).select(F.col("iid").alias("ida"), F.col("iid2").alias("idb"), "tile", "tile2").distinct(), "ego-pairs")
    # An interval travels once to each unit, a pair of tiles, in which it may touch another.
    unit = [F.least("tile", "tile2").alias("ta"), F.greatest("tile", "tile2").alias("tb")]
    asked = pairs.select(*unit, F.col("ida").alias("asked")).union(pairs.select(*unit, F.col("idb"))).distinct()
    work = asked.join(intervals.select("iid", "tile", "label", "dim", "ids", "copies", "cells", "vecs"), F.col("asked") == F.col("iid")).drop("asked")
    found = cut(work.groupBy("ta", "tb").applyInArrow(_joined(least, LEAF), FOUND), "ego-found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))

    # Copies: each vector counts what its class is linked with, and the other members of the class.
    classes = unique.select("label", "vec", F.col("id").alias("rep"), "copies")
    classes = classes.join(links.withColumnRenamed("id", "lid"), F.col("rep") == F.col("lid"), "left")
    classes = classes.join(comp.withColumnRenamed("id", "cid"), F.col("rep") == F.col("cid"), "left")
    classes = cut(classes.select("label", "vec", "rep", "copies", "links", "component"), "ego-classes")
    good_rows = rows.withColumnRenamed("id", "vec_id").join(classes, ["label", "vec"]).select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    rest = plain.where(~F.coalesce(good, F.lit(False))).select(
        F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    out = good_rows.union(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


EPSILON_ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
c AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT c.x, p.y FROM c JOIN p ON c.y = p.x)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.x = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM c GROUP BY x) m ON m.x = e.vec_id
"""

# --- exhaustive top-k search -------------------------------------------------

#: Queries that are held at once; beyond, the candidates are read again for the next block.
QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 4096
QUERY_TILE = 64


def quantized(v: Column) -> Column:
    """floor(256 * x) of every component."""
    return F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


class _Postings:
    """An inverted index of a block of sparse rows: by term, the rows that have it and their weights."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        term = np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        full = np.flatnonzero(flat)
        order = full[np.argsort(term[full], kind="stable")]
        self.row, self.weight = row[order], flat[order]
        self.terms, starts = np.unique(term[order], return_index=True)
        self.bounds = np.r_[starts, len(order)]


def _top(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = rank < k
    return query[keep], ids[keep], scores[keep]


def _accumulated(matrix: np.ndarray, index: _Postings, n: int) -> np.ndarray:
    """Dense scores of sparse query rows: every term scatters its weighted postings."""
    scores = np.zeros((len(matrix), n), dtype=matrix.dtype)
    one = np.empty_like(scores)
    for t, s, e in zip(index.terms, index.bounds[:-1], index.bounds[1:], strict=True):
        if t >= matrix.shape[1]:
            break
        users = np.flatnonzero(matrix[:, t])
        if len(users) == len(scores) and e - s == n:
            scores += np.multiply(matrix[:, t, None], index.weight[None, s:e], out=one)
        elif len(users):
            scores[users[:, None], index.row[s:e]] += matrix[users, t, None] * index.weight[s:e]
    return scores


def _searcher(block, k: int, rows: int, tile: int):
    """Top k of a partition for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matrix = block.value
        best = (np.zeros(0, np.int64),) * 3
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                cand = b.column(0).to_numpy()
                sizes = np.diff(b.column(1).offsets.to_numpy())
                flat = b.column(1).flatten().to_numpy()
                top = max((int(np.abs(x).max(initial=0).astype(object)) for x in (matrix, flat)), default=0)
                most = top * top * max(matrix.shape[1], 1)
                exact = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 62 else object
                index = _Postings(sizes, flat.astype(exact))
                for q in range(0, len(own), tile):
                    mine = own[q : q + tile]
                    scores = _accumulated(matrix[q : q + tile].astype(exact), index, len(cand))
                    scores = np.clip(scores, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)
                    scores[cand[None, :] == mine[:, None]] = -(1 << 63)
                    least = np.partition(scores, max(len(cand) - k, 0), axis=1)[:, max(len(cand) - k, 0)] if len(cand) else 0
                    r, c = np.nonzero((scores >= np.reshape(least, (-1, 1))) & (scores > -(1 << 63)))
                    best = _top(*(np.concatenate(x) for x in zip(best, (r + q, cand[c], scores[r, c]), strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best], names=["qn", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The k rows of vectors with the highest integer inner product with each row of queries.

    Components are quantized to floor(256 * x).  A row with the query's own id is
    no candidate.  Returns query_id, rank (from 1), vec_id, score; ties go to the
    smaller vec_id; repeated rows are reported as often as they occur.  Vectors
    that are null, or hold null or non-finite components, and null ids take no
    part.  Missing components of shorter vectors count as 0.  Scores beyond the
    range of a long are clamped to it.  Vectors of any length are taken whole.
    Other columns are not looked at, whatever their names.  Empty tables give an
    empty result.  Queries are taken in blocks of about QUERY_BLOCK; of several
    blocks each is stored before the next one is read, so that the driver holds
    one at a time.
    """

    def rows(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        df = df.where(F.col(id_col).isNotNull() & (usable(v) | (F.size(v) == 0)))
        return df.select(F.col(id_col).cast("long").alias("id"), quantized(v).alias("v"))

    spark = vectors.sparkSession
    asked = cut(rows(queries), "topk-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    candidates = rows(vectors)
    parts = []
    for n in range(blocks):
        # At most about QUERY_BLOCK rows: the stated query set is taken in blocks.
        got = asked.where(F.col("block") == n).select("id", "v").toArrow()
        ids = got["id"].to_numpy()
        lists = got["v"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
        matrix = np.zeros((len(ids), int(sizes.max(initial=0))), dtype=np.int64)
        if len(ids):
            matrix[np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = (
                lists.flatten().to_numpy()
            )
        found = candidates.mapInArrow(_searcher(spark.sparkContext.broadcast((ids, matrix)), k, CANDIDATE_BLOCK, QUERY_TILE), "qn long, vec_id long, score long")
        best = Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        named = spark.createDataFrame(pa.table({"qn": pa.array(range(len(ids)), pa.int64()), "query_id": pa.array(ids, pa.int64())}))
        part = found.join(named, "qn").select("query_id", "rank", "vec_id", "score")
        parts.append(cut(part, "topk-block") if blocks > 1 else part)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


TOP_K_ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
