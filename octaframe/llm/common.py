"""Helpers shared by the operators: shared storage, size-checked joins, tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text, as a regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and all of Spark is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="octaframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_SCRATCH: ContextVar[list[str] | None] = ContextVar("octaframe-scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what was stored within, in this thread; nothing lazy may leave the block."""
    token = _SCRATCH.set([])
    try:
        yield
    finally:
        paths = _SCRATCH.get() or []
        _SCRATCH.reset(token)
        forget(spark, paths)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/octaframe/{name}-{uuid.uuid4().hex}"
    if (mine := _SCRATCH.get()) is not None:
        mine.append(path)
    return path


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again, so that lost executors cost no recomputation."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast only after df (stored, so cheap to count) is shown to have few rows and bytes."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    wide += [F.coalesce(16 * F.size(c), F.lit(0)) for c, t in df.dtypes if t.startswith("array")]
    size = sum(wide, F.lit(8 * len(df.columns)))
    n, b = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and b <= max_bytes else df


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that are handed to Python, whatever the length of texts."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    now = str(spark.conf.get(key, f"{1 << 30}b")).removesuffix("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., and the new name of each old one: no name of a user can clash with one of ours."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
