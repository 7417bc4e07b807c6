"""Files of a compressed format as a source: one row for each file, decoded by what its content tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decode_by, decode_detected, detect

#: Method by the ending of a file's name, for formats that no magic number tells.
ENDINGS = {"gz": "gzip", "zst": "zstd", "xz": "xz", "bz2": "bzip2", "lz4": "lz4", "lzma": "lzma", "br": "brotli", "zz": "zlib"}


def read(spark: SparkSession, path: str, glob: str | None = None, options: dict | None = None) -> DataFrame:
    """path, method, packed_size, data of each file; method is null, and data as it is, where nothing tells the format.

    Spark's own binaryFile source lists and reads the files, and prunes by path
    and size.  options: those of each method.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (scan.option("pathGlobFilter", glob) if glob else scan).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    told = F.element_at(F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair)), ending)
    seen = detect("content")
    files = files.select("path", F.coalesce(seen, told).alias("method"), F.col("length").alias("packed_size"), "content", seen.isNotNull().alias("_seen"))
    data = F.when(F.col("_seen"), decode_detected("content", options)).otherwise(F.coalesce(decode_by("content", "method", options), F.col("content")))
    return files.select("path", "method", "packed_size", data.alias("data"))
