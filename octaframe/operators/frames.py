"""Framed values: frame indexes, seekable files, range reads, walks over frames and blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..catalog import find
from ..codecs import lz4, zstds
from ..functions.codec import decode_bytes, encode


def slices(df: DataFrame, key: str, value: str, frame_size: int) -> DataFrame:
    """key, frame_no, d_off, d_len, data: every value cut into frames of frame_size bytes; empty values have none."""
    b = F.col(value).cast("binary")
    frames = F.ceil(F.octet_length(b) / frame_size).cast("int")
    rows = df.where(F.octet_length(b) > 0).select(key, b.alias("_b"), F.explode(F.sequence(F.lit(0), frames - 1)).alias("frame_no"))
    off = F.col("frame_no").cast("long") * frame_size
    part = F.substring("_b", (off + 1).cast("int"), F.lit(frame_size))
    return rows.select(key, "frame_no", off.alias("d_off"), F.octet_length(part).cast("long").alias("d_len"), part.alias("data"))


def frame_table(df: DataFrame, key: str, value: str, frame_size: int, method: str = "zstd", **options) -> DataFrame:
    """Independent frames of every value with their place: key, frame_no, d_off, d_len, c_off, c_len, frame.

    Frames do not depend on each other, so that neither partitioning nor lost
    executors change a byte of them.
    """
    frames = slices(df, key, value, frame_size).withColumn("frame", encode("data", method, **options)).drop("data")
    frames = frames.withColumn("c_len", F.octet_length("frame").cast("long"))
    before = Window.partitionBy(key).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("c_off", F.coalesce(F.sum("c_len").over(before), F.lit(0)))


def range_read(frames: DataFrame, key: str, offset: int, length: int, method: str = "zstd") -> DataFrame:
    """key, data: bytes offset to offset + length of each value; only the frames that overlap are decoded.

    Reads past the end are short; a value that ends before offset has no row.
    """
    hit = frames.where((F.col("d_off") < offset + length) & (F.col("d_off") + F.col("d_len") > offset))
    first = F.greatest(F.lit(offset) - F.col("d_off"), F.lit(0))
    last = F.least(F.lit(offset + length) - F.col("d_off"), F.col("d_len"))

    codec = find(method)

    @F.pandas_udf("binary")
    def part(frame: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([decode_bytes(f, codec)[i:j] for f, i, j in zip(frame, a, b, strict=True)], dtype=object)

    parts = hit.select(key, "frame_no", part("frame", first, last).alias("_d"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "_d"))), lambda x: F.hex(x["_d"]))
    return parts.groupBy(key).agg(F.unhex(F.array_join(ordered, "")).alias("data"))


def seek_table(frames: DataFrame, key: str) -> DataFrame:
    """key, seek table of the frames of each value as the skippable frame that ends a seekable file."""
    rows = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("frame_no", "c_len", "d_len"))).alias("_rows"))

    @F.pandas_udf("binary")
    def pack(r: pd.Series) -> pd.Series:
        return r.map(lambda rows: zstds.seek_table([(x["c_len"], x["d_len"], None) for x in rows], False))

    return rows.select(key, pack("_rows").alias("seek_table"))


def skippable_frame(payload: Column, variant: int = 0) -> Column:
    """A skippable frame around payload, by built-in functions."""
    n = F.lpad(F.hex(F.octet_length(payload)), 8, "0")
    little = F.concat(*(F.substring(n, k, 2) for k in (7, 5, 3, 1)))
    return F.concat(F.lit(bytes([0x50 + variant, 0x2A, 0x4D, 0x18])), F.unhex(little), payload)


WALKED = "kind string, offset long, size long, payload_offset long, payload_size long"


@udtf(returnType=WALKED)
class ZstdWalk:
    """Frames, headers and blocks of a Zstandard value; nothing is decoded."""

    def eval(self, data: bytes):
        if data is not None:
            yield from zstds.walk(bytes(data))


@udtf(returnType=WALKED)
class Lz4Walk:
    """Frames, headers and blocks of an LZ4 value; nothing is decoded."""

    def eval(self, data: bytes):
        if data is not None:
            yield from lz4.walk(bytes(data))


def register_walks(spark) -> None:
    """SQL table functions zstd_walk and lz4_walk."""
    spark.udtf.register("zstd_walk", ZstdWalk)
    spark.udtf.register("lz4_walk", Lz4Walk)
