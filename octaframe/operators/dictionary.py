"""Dictionary training: d-mer counts over the corpus, then greedy choice of segments."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of values whose d-mers are counted and looked up together; a longer value stands alone.
CHUNK = 4 << 20
#: Best segments that one pass hands to the driver.  No cut: once they no longer hold the best one for sure, the next pass looks at all again.
AT_A_TIME = 64


def _stored(df: DataFrame, paths: list[str]) -> DataFrame:
    """df written to the shared folder and read again; its path is added to paths."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="octaframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    paths.append(f"{root.rstrip('/')}/octaframe/dictionary-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(paths[-1])
    return spark.read.schema(df.schema).parquet(paths[-1])


def _forget(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _codes(raw: bytes, d: int) -> np.ndarray:
    """The d bytes from each place of raw on as a number; zeros follow the end."""
    at = np.ndarray((len(raw),), "<i8", raw + b"\0" * 8, strides=(1,))
    return at.copy() if d == 8 else at & ((1 << 8 * d) - 1)


def _inside(sizes: np.ndarray, d: int) -> np.ndarray:
    """Whether the d bytes from each place on lie within one of the strings of these sizes, laid end to end."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    return np.arange(len(ends)) + d <= ends


def _chunked(batches):
    """Values numbered by chunk."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        numbers = []
        for n in pc.binary_length(batch.column("_v")).to_pylist():
            if size and size + n > CHUNK:
                chunk, size = chunk + 1, 0
            size += n
            numbers.append(chunk)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column("_v")], names=["_chunk", "_v"])


def _counting(d: int):
    """Chunk, d-mer, count; a chunk that is read in parts has several rows of a d-mer."""

    def run(batches):
        for batch in batches:
            chunks = batch.column("_chunk").to_numpy()
            for chunk in np.unique(chunks):
                values = batch.column("_v").filter(pa.array(chunks == chunk)).to_pylist()
                k, n = np.unique(_codes(b"".join(values), d)[_inside(np.array([len(v) for v in values]), d)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk)), pa.array(k), pa.array(n)], names=["_chunk", "_k", "_c"])

    return run


def _scoring(segment: int, d: int):
    """Segments of the values of a chunk: score, segment, and for each place in it the count of the d-mer there, 0 for those not repeated in the corpus or seen before in the segment."""
    schema = pa.schema([("score", pa.int64()), ("segment", pa.binary()), ("counts", pa.list_(pa.int64()))])

    def run(values: pa.Table, known: pa.Table) -> pa.Table:
        k, first = np.unique(known.column("_k").to_numpy(), return_index=True)
        n = known.column("_n").to_numpy()[first]
        parts = [part for v in values.column("_v").to_pylist() for at in range(0, len(v), segment) if len(part := v[at : at + segment]) >= d]
        if not parts or not len(k):
            return schema.empty_table()
        sizes = np.array([len(x) for x in parts])
        codes = _codes(b"".join(parts), d)
        at = np.minimum(np.searchsorted(k, codes), len(k) - 1)
        hit = np.flatnonzero((k[at] == codes) & _inside(sizes, d))
        _, once = np.unique((np.repeat(np.arange(len(parts)), sizes)[hit] << 32) | at[hit], return_index=True)
        counts = np.zeros(len(codes), np.int64)
        counts[hit[once]] = n[at[hit[once]]]
        ends = np.cumsum(sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(counts))
        found = pa.Table.from_arrays([pa.array(np.add.reduceat(counts, ends - sizes)), pa.array(parts, pa.binary()), lists], schema=schema)
        return found.filter(pc.greater(found.column("score"), 0))

    return run


def _best(covered: np.ndarray, least: int, d: int):
    """The AT_A_TIME best of a task's different segments by what they score without covered d-mers, of those that score least or more."""
    few = np.zeros(1 << 16, bool)
    mixed = lambda codes: ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    few[mixed(covered)] = True

    def run(batches):
        best = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, score = batch.column("segment").to_pylist(), batch.column("score").to_numpy()
            sizes = np.array([len(x) for x in parts])
            ends, codes = np.cumsum(sizes), _codes(b"".join(parts), d)
            counts = batch.column("counts").flatten().to_numpy()
            maybe = np.flatnonzero(few[mixed(codes)])
            left = counts.copy()
            left[maybe[np.isin(codes[maybe], covered)]] = 0
            now = np.add.reduceat(left, ends - sizes)
            worst = min(-x[0] for x in best.values()) if len(best) == AT_A_TIME else 0
            for i in np.flatnonzero(now >= max(least, worst)):
                best[parts[i]] = (-int(now[i]), -int(score[i]), parts[i], counts[ends[i] - sizes[i] : ends[i]])
            best = {x[2]: x for x in sorted(best.values(), key=lambda x: x[:3])[:AT_A_TIME]}
        rows = list(best.values())
        columns = [pa.array([-x[0] for x in rows], pa.int64()), pa.array([-x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary()), pa.array([x[3] for x in rows], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["now", "score", "segment", "counts"])

    return run


def train(df: DataFrame, value: str, capacity: int = 16_384, segment: int = 256, d: int = 8) -> bytes:
    """A raw dictionary of at most capacity bytes from the values of a column.

    d-mers are counted over all values; all that repeat score each segment of
    each value, by its different d-mers.  The best segment of all is taken, what
    it covers scores no more, and so on; ties go to the segment of the higher
    first score, then to the smaller one.  The best one comes last, nearest to
    the data.  Without repeated d-mers the dictionary is empty.

    Values are cut into segments at multiples of segment.  The segments are
    stored with the counts of their d-mers.  A pass over them finds the best few;
    as scores only fall, the driver may take those among them that still are not
    behind the last one found, and segments whose first score is under the best
    known one need not be read.
    """
    segment, d = min(4096, max(16, segment)), d if 6 <= d <= 8 else 8
    spark, paths = df.sparkSession, []
    try:
        values = df.select(F.col(value).cast("binary").alias("_v")).where(F.octet_length("_v") >= d)
        values = _stored(values.mapInArrow(_chunked, "_chunk long, _v binary"), paths)
        counted = values.mapInArrow(_counting(d), "_chunk long, _k long, _c long")
        known = counted.withColumn("_n", F.sum("_c").over(Window.partitionBy("_k"))).where("_n > 1").select("_chunk", "_k", "_n")
        scored = values.groupBy("_chunk").cogroup(known.groupBy("_chunk")).applyInArrow(_scoring(segment, d), "score long, segment binary, counts array<long>")
        scored = _stored(scored, paths)
        return _greedy(scored, capacity, d)
    finally:
        _forget(spark, paths)


def _greedy(scored: DataFrame, capacity: int, d: int) -> bytes:
    picks, size, covered, known = [], 0, set(), {}

    def rescored(x):
        places = zip(_codes(bytes(x.segment), d).tolist(), x.counts, strict=True)
        return (-sum(n for c, n in places if n and c not in covered), -x.score, bytes(x.segment))

    while size < capacity:
        least = max(1, max((-rescored(x)[0] for x in known.values()), default=1))
        run = _best(np.array(sorted(covered), np.int64), least, d)
        found = scored.where(F.col("score") >= least).mapInArrow(run, "now long, score long, segment binary, counts array<long>")
        rows = found.dropDuplicates(["segment"]).orderBy(F.desc("now"), F.desc("score"), "segment").limit(AT_A_TIME).collect()
        if not rows:
            break
        known = {bytes(r.segment): r for r in rows}
        # all that are not among the rows are behind the last one, or score less than least
        last = (-rows[-1].now, -rows[-1].score, bytes(rows[-1].segment)) if len(rows) == AT_A_TIME else (0.5 - least,)
        while known and size < capacity:
            best = min(rescored(x) for x in known.values())
            if best > last or not best[0]:
                break
            counts = known.pop(best[2]).counts
            picks.append(best[2][: capacity - size])
            size += len(picks[-1])
            covered.update(c for c, n in zip(_codes(best[2], d).tolist(), counts, strict=True) if n)
    return b"".join(reversed(picks))
