"""Byte statistics: histograms, entropy, runs, deltas, bigrams, d-mers, canonical codes, BWT and MTF.

Bytes of a value never become rows where counts will do: a vectorised kernel
counts within a batch, and Spark adds up the counts by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codecs import fse
from ..codecs.bits import limited_lengths


def _counted(df: DataFrame, keys: list[str], value: str, kernel, out: str, fields: str) -> DataFrame:
    """Sum ``kernel(list of byte values) -> frame of fields`` by keys; counts are added up within a batch first."""
    kinds = dict(df.dtypes)
    names = [x.split()[0] for x in fields.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                got = kernel([bytes(b) for b in part["_v"] if b is not None])
                for k, v in zip(keys, key if isinstance(key, tuple) else (key,), strict=True):
                    got[k] = [v] * len(got)
                yield got[[*keys, *names, out]]

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [fields, f"{out} long"])
    rows = df.select(*keys, F.col(value).cast("binary").alias("_v")).mapInPandas(run, schema)
    return rows.groupBy(*keys, *names).agg(F.sum(out).alias(out))


def byte_histogram(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, byte, count of the byte in all values."""

    def kernel(values: list[bytes]) -> pd.DataFrame:
        c = np.bincount(np.frombuffer(b"".join(values), dtype=np.uint8), minlength=256)
        return pd.DataFrame({"byte": np.flatnonzero(c), "n": c[c > 0]})

    return _counted(df, keys, value, kernel, "n", "byte int")


def entropy(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bytes, bits per byte of a histogram."""
    sums = histogram.groupBy(*keys).agg(F.sum("n").alias("bytes"), F.sum(F.col("n") * F.log2("n")).alias("_x"))
    return sums.select(*keys, "bytes", (F.log2("bytes") - F.col("_x") / F.col("bytes")).alias("entropy"))


def run_lengths(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, run length, number of maximal runs of equal bytes of that length within values."""

    def kernel(values: list[bytes]) -> pd.DataFrame:
        runs = [np.zeros(0, np.int64)]
        for v in values:
            x = np.frombuffer(v, dtype=np.uint8)
            if len(x):
                runs.append(np.diff(np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)]))
        n, c = np.unique(np.concatenate(runs), return_counts=True)
        return pd.DataFrame({"run_length": n, "n": c})

    return _counted(df, keys, value, kernel, "n", "run_length long")


def bigrams(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, prev, cur, count of adjacent bytes within values."""

    def kernel(values: list[bytes]) -> pd.DataFrame:
        total = np.zeros(65536, dtype=np.int64)
        for v in values:
            x = np.frombuffer(v, dtype=np.uint8).astype(np.int64)
            total += np.bincount(x[:-1] * 256 + x[1:], minlength=65536) if len(x) > 1 else 0
        at = np.flatnonzero(total)
        return pd.DataFrame({"prev": at >> 8, "cur": at & 255, "n": total[at]})

    return _counted(df, keys, value, kernel, "n", "prev int, cur int")


def followers(counts: DataFrame, most: int = 32, least: int = 3) -> DataFrame:
    """prev, rank, cur, n: the bytes that most often follow prev; ties to the lower byte."""
    order = Window.partitionBy("prev").orderBy(F.desc("n"), "cur")
    return counts.where(F.col("n") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def dmer_counts(df: DataFrame, value: str, d: int = 8) -> DataFrame:
    """dmer (binary), count of each sequence of d bytes within values."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(bytes(b), dtype=np.uint8), d) for b in pdf["_v"] if b is not None and len(b) >= d]
            if parts:
                rows = np.ascontiguousarray(np.concatenate(parts)).view(f"V{d}").ravel()
                keys, n = np.unique(rows.view(">u8") if d == 8 else rows, return_counts=True)
                raw = keys.tobytes()
                yield pd.DataFrame({"dmer": [raw[i : i + d] for i in range(0, len(raw), d)], "n": n})

    rows = df.select(F.col(value).cast("binary").alias("_v")).mapInPandas(run, "dmer binary, n long")
    return rows.groupBy("dmer").agg(F.sum("n").alias("n"))


def delta(values: Column, distance: int) -> Column:
    """Differences of an array of bytes, modulo 256; the first ``distance`` pass unchanged."""
    return F.transform(values, lambda x, i: F.when(i < distance, x).otherwise(F.pmod(x - F.get(values, (i - distance).cast("int")), F.lit(256))))


def bytes_of(c: Column | str) -> Column:
    """The bytes of a short value as an array of ints, by built-in functions."""
    b = (F.col(c) if isinstance(c, str) else c).cast("binary")
    each = F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int"))
    return F.when(F.octet_length(b) > 0, each).otherwise(F.array().cast("array<int>"))


def canonical_codes(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """lengths (keys, symbol, length) -> keys, symbol, length, code of the canonical prefix code.

    A code is the sum of the spans, 2^(longest - length), of the symbols before
    it in the order of length and symbol, scaled down to its own length.
    """
    order = Window.partitionBy(*keys).orderBy("length", "symbol")
    longest = F.max("length").over(Window.partitionBy(*keys))
    span = F.pow(F.lit(2.0), longest - F.col("length"))
    spans = lengths.withColumn("_l", longest).withColumn("_span", span)
    before = F.coalesce(F.sum("_span").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return spans.select(*keys, "symbol", "length", (before / F.pow(F.lit(2.0), F.col("_l") - F.col("length"))).cast("long").alias("code"))


def huffman_lengths(histogram: DataFrame, keys: list[str], most: int = 15) -> DataFrame:
    """keys, byte, n, length of the byte in an optimal prefix code for the group; groups have 256 rows at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("byte")
        return pdf.assign(length=limited_lengths(pdf["n"].tolist(), most))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in histogram.schema.fields)
    return histogram.groupBy(*keys).applyInPandas(run, fields + ", length int")


def repeated_positions(df: DataFrame, key: str, value: str, k: int = 8, window: int = 32768) -> DataFrame:
    """key, positions, repeated: places of k bytes, and those whose bytes occurred up to ``window`` bytes before: what a match finder can use."""

    def counts(v) -> tuple[int, int]:
        x = np.frombuffer(bytes(v), dtype=np.uint8) if v is not None else np.zeros(0, np.uint8)
        if len(x) < k:
            return 0, 0
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, k)).view(f"V{k}").ravel()
        _, same = np.unique(rows, return_inverse=True)
        order = np.argsort(same, kind="stable")
        near = (same[order][1:] == same[order][:-1]) & (np.diff(order) <= window)
        return len(rows), int(near.sum())

    @F.pandas_udf("positions long, repeated long")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(v) for v in s], columns=["positions", "repeated"])

    got = df.select(key, run(F.col(value).cast("binary")).alias("_r"))
    return got.select(key, "_r.positions", "_r.repeated")


def burrows_wheeler(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, the last column of the sorted rotations of short strings, and the row of the string itself (from 0)."""
    text = F.col(value)
    turns = df.select(key, text.alias("_t"), F.posexplode(F.sequence(F.lit(0), F.length(text) - 1)).alias("_i", "_x"))
    turned = F.concat(F.expr("substring(_t, _i + 1)"), F.expr("substring(_t, 1, _i)"))
    order = Window.partitionBy(key).orderBy("_r", "_i")
    ranked = turns.withColumn("_r", turned).withColumn("_n", F.row_number().over(order) - 1)
    last = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.expr("right(_r, 1)").alias("c")))), lambda x: x["c"])
    return ranked.groupBy(key).agg(F.array_join(last, "").alias("bwt"), F.min(F.when(F.col("_i") == 0, F.col("_n"))).alias("origin"))


def move_to_front(c: Column | str) -> Column:
    """Ranks of the bytes of a short value in a list that each byte moves to the front of."""
    start = F.struct(F.sequence(F.lit(0), F.lit(255)).alias("list"), F.array().cast("array<int>").alias("out"))

    def step(acc, b):
        at = (F.array_position(acc["list"], b) - 1).cast("int")
        return F.struct(F.concat(F.array(b), F.array_remove(acc["list"], b)).alias("list"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(bytes_of(c), start, step, lambda acc: acc["out"])


def fse_counts(histogram: DataFrame, keys: list[str], log: int) -> DataFrame:
    """keys, byte, n, norm: counts scaled to a sum of 2^log, as finite state entropy asks; see codecs.fse.normalised."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        norm = fse.normalised(dict(zip(pdf["byte"].tolist(), pdf["n"].tolist(), strict=True)), log)
        return pdf.assign(norm=pdf["byte"].map(norm))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in histogram.schema.fields)
    return histogram.groupBy(*keys).applyInPandas(run, fields + ", norm long")


def _bits(counts: np.ndarray) -> np.ndarray:
    """Bits that an ideal code takes for rows of counts."""
    total = counts.sum(axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(counts > 0, counts * np.log2(total / np.where(counts > 0, counts, 1)), 0.0).sum(axis=-1)


def merged_contexts(counts: np.ndarray, most: int, price: float) -> list[int]:
    """Cluster of each context (a row of counts): the pair whose merge costs least is merged, again and again.

    Merges go on while there are more than ``most`` clusters, or while one saves
    more than it costs, ``price`` bits being those of a further code.  Of equal
    merges the first pair counts.  Clusters are named by their first context.
    """
    rows = {i: counts[i].astype(np.float64) for i in range(len(counts))}
    of = list(range(len(counts)))
    while len(rows) > 1:
        names = sorted(rows)
        stack = np.stack([rows[i] for i in names])
        own = _bits(stack)
        cost = np.full((len(names), len(names)), np.inf)
        for k in range(len(names) - 1):
            cost[k, k + 1 :] = _bits(stack[k + 1 :] + stack[k]) - own[k + 1 :] - own[k]
        k = int(np.argmin(cost))
        i, j = names[k // len(names)], names[k % len(names)]
        if len(names) <= most and cost.flat[k] >= price:
            break
        rows[i] = rows[i] + rows.pop(j)
        of = [i if c == j else c for c in of]
    return of


def context_clusters(pairs: DataFrame, keys: list[str], most: int = 16, price: float = 1000.0) -> DataFrame:
    """keys, prev, cluster: the bytes that may precede another one, in clusters that share a code; pairs (keys, prev, cur, n), at most 256 contexts a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        contexts = sorted(pdf["prev"].unique().tolist())
        counts = np.zeros((len(contexts), 256))
        counts[np.searchsorted(contexts, pdf["prev"]), pdf["cur"]] = pdf["n"]
        got = merged_contexts(counts, most, price)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "prev": contexts, "cluster": [contexts[c] for c in got]})

    types = dict(pairs.dtypes)
    return pairs.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "prev int", "cluster int"]))


def block_splits(data: bytes, grain: int = 1024, price: float = 600.0) -> list[int]:
    """Where blocks with codes of their own begin: neighbouring blocks are merged while that costs less than ``price`` bits, the cheapest first."""
    x = np.frombuffer(data, dtype=np.uint8)
    starts = list(range(0, len(x), grain))
    counts = [np.bincount(x[a : a + grain], minlength=256).astype(np.float64) for a in starts]
    while len(starts) > 1:
        stack = np.stack(counts)
        cost = _bits(stack[1:] + stack[:-1]) - _bits(stack[1:]) - _bits(stack[:-1])
        k = int(np.argmin(cost))
        if cost[k] >= price:
            break
        counts[k] = counts[k] + counts.pop(k + 1)
        starts.pop(k + 1)
    return starts


def blocks_of(c: Column | str, grain: int = 1024, price: float = 600.0) -> Column:
    """Starts of the blocks that block_splits makes of each value."""
    run = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else block_splits(bytes(b), grain, price)), "array<int>")
    return run((F.col(c) if isinstance(c, str) else c).cast("binary"))


def block_form(c: Column | str) -> Column:
    """How the first block of a DEFLATE stream is coded (stored, fixed, dynamic), by built-in functions: what an encoder chose or fell back to."""
    b = (F.col(c) if isinstance(c, str) else c).cast("binary")
    kind = F.shiftright(F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int"), 1) % 4
    return F.when(F.octet_length(b) > 0, F.element_at(F.array(*map(F.lit, ("stored", "fixed", "dynamic", "reserved"))), kind + 1))
