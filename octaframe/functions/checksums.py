"""Checksums as Columns.  crc32, sha256, xxh64 with seed 42 and Adler-32 are built-in expressions; the rest are Arrow UDFs."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codecs import checksums as kernels

BASE = 65521


def _binary(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("binary")


def crc32(c: Column | str) -> Column:
    return F.crc32(_binary(c))


def sha256(c: Column | str) -> Column:
    return F.sha2(_binary(c), 256)


def xxh64_seed42(c: Column | str) -> Column:
    """Spark's own hash of a binary is XXH64 with seed 42; a null stays null here."""
    return F.when(_binary(c).isNotNull(), F.xxhash64(_binary(c)))


def _kernel(name: str, kind: str, signed: bool = False):
    fn = getattr(kernels, name)

    def make(c: Column | str, **options) -> Column:
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            def one(b):
                if b is None:
                    return None
                v = fn(bytes(b), **options)
                return v - (1 << 64) if signed and v >> 63 else v

            return pd.Series([one(b) for b in s], dtype="Int64")

        return run(_binary(c))

    return make


adler32 = _kernel("adler32", "long")
xxh32 = _kernel("xxh32", "long")
#: 64-bit sums as signed longs, like Spark's own xxhash64.
xxh64 = _kernel("xxh64", "long", signed=True)
crc64 = _kernel("crc64", "long", signed=True)
bzip2_crc = _kernel("bzip2_crc", "long")


def crc32_update(running: Column | str, c: Column | str) -> Column:
    """CRC-32 of what had the sum ``running`` (0 for nothing) and then c; a null c adds nothing."""
    return _updated(kernels.crc32, running, c)


def adler32_update(running: Column | str, c: Column | str) -> Column:
    """Adler-32 of what had the sum ``running`` (1 for nothing) and then c; a null c adds nothing."""
    return _updated(kernels.adler32, running, c)


def _updated(fn, running: Column | str, c: Column | str) -> Column:
    @F.pandas_udf("long")
    def run(old: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else int(v) if b is None else fn(bytes(b), int(v)) for v, b in zip(old, s, strict=True)], dtype="Int64")

    return run((F.col(running) if isinstance(running, str) else running).cast("long"), _binary(c))


def digest_parts(parts: DataFrame, keys: list[str], order: list[str], data: str, kind: str = "xxh64", seed: int = 0) -> DataFrame:
    """keys, digest, length: the sum of the concatenation of each key's parts in order, by reset, updates and finalize of one state.

    kind: xxh32, xxh64 (as a signed long), crc32 or adler32.  Parts are taken
    batch by batch, so that a key's data is never held at once, but by one task.
    """
    rows = parts.select(*keys, *(c for c in order if c not in keys), F.col(data).cast("binary").alias("_data"))
    types = dict(rows.dtypes)

    kernels.State(kind, seed)  # refuses a kind that it does not know
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def by_key(batches):
        """Runs of equal keys in the sorted rows of a partition."""
        state = now = None
        length = 0

        def row():
            value = state.digest()
            value = value - (1 << 64) if kind == "xxh64" and value >> 63 else value
            return pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in now), pa.array([value], pa.int64()), pa.array([length], pa.int64())], names=[*keys, "digest", "length"])

        for b in batches:
            at = b.schema.get_field_index("_data")
            for i in range(b.num_rows):
                key = tuple(b.column(k)[i] for k in keys)
                if now is None or tuple(k.as_py() for k in key) != tuple(k.as_py() for k in now):
                    if now is not None:
                        yield row()
                    state, now, length = kernels.State(kind, seed), key, 0
                x = b.column(at)[i].as_py()
                if x is not None:
                    state.update(x)
                    length += len(x)
        if now is not None:
            yield row()

    return ordered.mapInArrow(by_key, ", ".join(f"{k} {types[k]}" for k in keys) + ", digest long, length long")


def _combined(parts: DataFrame, keys: list[str], order: list[str], adler: Column, length: Column) -> DataFrame:
    """keys, _a, _n: Adler-32 and length of the concatenation of the parts of each key.

    With A = 1 + s and B = n + t, a part adds s to A, and t + s * rest to B,
    where rest are the bytes after it, a running sum.
    """
    after = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.coalesce(F.sum("_n").over(after), F.lit(0)) % BASE
    rows = parts.select(*keys, *(c for c in order if c not in keys), adler.alias("_a"), length.alias("_n"))
    s = F.pmod(F.col("_a") % 65536 - 1, F.lit(BASE))
    t = F.pmod(F.floor(F.col("_a") / 65536) - F.col("_n"), F.lit(BASE))
    rows = rows.withColumn("_rest", rest).select(*keys, "_n", s.alias("_s"), F.pmod(t + s * F.col("_rest"), F.lit(BASE)).alias("_t"))
    sums = rows.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.sum("_t").alias("_t"))
    low, high = (1 + F.col("_s")) % BASE, (F.col("_n") + F.col("_t")) % BASE
    return sums.select(*keys, (high * 65536 + low).cast("long").alias("_a"), F.col("_n").cast("long").alias("_n"))


def combine_adler32(parts: DataFrame, keys: list[str], order: str, adler: str, length: str) -> DataFrame:
    """Adler-32 of the concatenation, in ``order``, of the parts of each key: keys, adler32, length.

    The sums are associative: parts are combined within ranges of (keys, order),
    of which a large key has many, and then the few partial sums of each key.
    """
    ranges = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.select(*keys, F.col(order).alias("_o"), F.col(adler).alias("_x"), F.col(length).cast("long").alias("_l"))
    rows = rows.repartitionByRange(ranges, *keys, "_o").withColumn("_part", F.spark_partition_id())
    partial = _combined(rows, [*keys, "_part"], ["_o"], F.col("_x"), F.col("_l"))
    whole = _combined(partial, keys, ["_part"], F.col("_a"), F.col("_n"))
    return whole.select(*keys, F.col("_a").alias("adler32"), F.col("_n").alias("length"))
