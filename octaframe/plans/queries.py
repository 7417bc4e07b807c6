"""Registered queries of the library and their DuckDB counterparts.

All of them run over whole tables and whole texts.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Method, codec_methods, codec_options, methods, register
from ..codecs import rle
from ..functions import checksums as sums
from ..functions import codec
from ..operators import analysis, dictionary, frames
from ..sources import files, framed, seekable
from ..streaming import frames as streaming
from . import fixed

QUERIES = {}
ORACLE_SQL = {}
#: The bytes of the blob b as a list, in DuckDB.
BYTES = "list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::INTEGER)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register the decorated function, with its oracle if it has one."""

    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return add


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share; a temporary one where none is set and all of Spark is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="octaframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/octaframe/{name}-{uuid.uuid4().hex}"


@query(
    "SELECT lang, count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS raw_bytes, true AS all_round_trip FROM documents GROUP BY lang"
)
def compression_report(spark, sf_dir):
    """Documents, UTF-8 bytes and whether zlib brings all of them back, by language."""
    docs = table(spark, sf_dir, "documents").select("lang", F.encode("text", "UTF-8").alias("b"))
    docs = docs.withColumn("back", codec.decode(codec.encode("b", "zlib"), "zlib"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.octet_length("b")).alias("raw_bytes"), F.every(F.col("back") == F.col("b")).alias("all_round_trip")
    )


#: The first bytes of each format that has a magic number or a header that the defaults make.
_HEADS = {"zlib": "789C", "gzip": "1F8B0800", "bzip2": "425A6839", "xz": "FD377A585A000004", "lzma": "5D00008000", "lz4": "04224D18", "zstd": "28B52FFD"}
#: What of a text of 4000 bytes or more the methods take at most; filters keep the length. What rle takes follows from the runs of a text, doubled letters cost bytes.
_MOST = {"delta": 1.0, "bcj": 1.0, "reduce": 0.75, "lz4": 0.8}


def _round_trip(method: str):
    head, most = _HEADS.get(method, ""), _MOST.get(method, 0.6)

    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
        # Early ZIP streams do not say where they end: the container tells the decoder the size.
        size = F.octet_length("b") if method in ("reduce", "implode") else None
        docs = docs.withColumn("packed", codec.encode("b", method))
        docs = docs.withColumn("back", codec.decode("packed", method, size))
        n, taken = F.octet_length("b"), F.octet_length("packed")
        if method == "rle":
            exact = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else rle.size(bytes(b))).astype("Int64"), "long")
            small = taken.eqNullSafe(exact("b"))
        else:
            small = (n < 4000) | (taken <= n * most)
        return docs.select(
            "doc_id",
            F.octet_length("back").cast("long").alias("n_bytes"),
            F.col("back").eqNullSafe(F.col("b")).alias("ok"),
            (F.hex(F.substring("packed", 1, len(head) // 2)) if head else F.lit("")).alias("head"),
            small.alias("small"),
        )

    sizes = "all texts take exactly the bytes that their runs make" if method == "rle" else "texts of 4000 bytes or more take as little as they should"
    run.__doc__ = f"decode(encode(text)) by {method} for every document, how its streams begin, and whether {sizes}."
    return run


for _m in methods():
    query(
        f"SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS ok, '{_HEADS.get(_m.name, '')}' AS head, true AS small FROM documents",
        f"roundtrip_{_m.name}",
    )(_round_trip(_m.name))


@query("SELECT doc_id, sha256(encode(text)) AS digest FROM documents")
def sha256_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sums.sha256("text").alias("digest"))


@query(
    f"""WITH t AS (SELECT list(r ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), range(0, 8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS r FROM range(0, 256) x(n))),
    d AS (SELECT doc_id, {BYTES} AS v FROM (SELECT doc_id, encode(text) AS b FROM documents))
    SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(v, lambda x: x::BIGINT)),
      lambda c, x: xor(c // 256, t.t[CAST(xor(c % 256, x) AS INTEGER) + 1])), 4294967295::BIGINT) AS crc FROM d, t"""
)
def crc32_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sums.crc32("text").alias("crc"))


_ADLER = """CAST((n + list_sum(list_transform(v, lambda x, i: (n - i + 1) * x))) % 65521 * 65536 + (1 + list_sum(v)) % 65521 AS BIGINT)"""


@query(f"SELECT doc_id, CASE WHEN n = 0 THEN 1 ELSE {_ADLER} END AS adler FROM (SELECT doc_id, {BYTES} AS v, octet_length(b) AS n FROM (SELECT doc_id, encode(text) AS b FROM documents))")
def adler32_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sums.adler32("text").alias("adler"))


@query(f"SELECT source, {_ADLER} AS adler32, n AS length FROM (SELECT source, {BYTES} AS v, CAST(octet_length(b) AS BIGINT) AS n FROM (SELECT source, encode(string_agg(text, '' ORDER BY doc_id)) AS b FROM documents GROUP BY source))")
def adler32_combine_by_source(spark, sf_dir):
    """Adler-32 of each source's texts in the order of ids, from the sums of the texts, combined by ranges and then across them."""
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("source", "doc_id", sums.adler32("text").alias("a"), F.octet_length("text").cast("long").alias("n"))
    return sums.combine_adler32(parts, ["source"], "doc_id", "a", "n")


_CRC64 = f"""WITH t AS (SELECT list(r ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(CAST(n AS UBIGINT), CAST(range(0, 8) AS UBIGINT[])),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 14514072000185962306::UBIGINT) ELSE c // 2 END) AS r FROM range(0, 256) x(n))),
    d AS (SELECT doc_id, {BYTES} AS v FROM (SELECT doc_id, encode(text) AS b FROM documents))
    SELECT doc_id, printf('%016X', xor(list_reduce(list_prepend(18446744073709551615::UBIGINT, list_transform(v, lambda x: x::UBIGINT)),
      lambda c, x: xor(c // 256, t.t[CAST(xor(c % 256, x) AS INTEGER) + 1])), 18446744073709551615::UBIGINT)) AS crc FROM d, t"""
_BZIP2_CRC = f"""WITH t AS (SELECT list(r ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT) * 16777216, range(0, 8)),
      lambda c, k: CASE WHEN c >= 2147483648 THEN xor(c * 2 - 4294967296, 79764919) ELSE c * 2 END) AS r FROM range(0, 256) x(n))),
    d AS (SELECT doc_id, {BYTES} AS v FROM (SELECT doc_id, encode(text) AS b FROM documents))
    SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(v, lambda x: x::BIGINT)),
      lambda c, x: xor(c % 16777216 * 256, t.t[CAST(xor(c // 16777216, x) AS INTEGER) + 1])), 4294967295::BIGINT) AS crc FROM d, t"""


@query(_CRC64)
def crc64_documents(spark, sf_dir):
    """CRC-64 of xz, as hexadecimal digits."""
    crc = F.lpad(F.hex(sums.crc64("text")), 16, "0")
    return table(spark, sf_dir, "documents").select("doc_id", crc.alias("crc"))


@query(_BZIP2_CRC)
def bzip2_crc_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sums.bzip2_crc("text").alias("crc"))


_X32 = "4294967296"


def _rotated(x: str, r: int) -> str:
    return f"(({x}) * {1 << r} % {_X32} + ({x}) // {1 << 32 - r})"


_LANE = lambda i, at: f"(v[{at}] + v[{at} + 1] * 256 + v[{at} + 2] * 65536 + v[{at} + 3] * 16777216)"
_ROUND = lambda acc, lane: f"{_rotated(f'({acc} + {lane} * 2246822519) % {_X32}', 13)} * 2654435761 % {_X32}"
_XXH32 = f"""WITH d AS (SELECT doc_id, list_transform({BYTES}, lambda x: x::HUGEINT) AS v, octet_length(b)::HUGEINT AS n FROM (SELECT doc_id, encode(text) AS b FROM documents)),
    a AS (SELECT doc_id, v, n, CASE WHEN n >= 16 THEN list_reduce(list_prepend([606290984::HUGEINT, 2246822519, 0, 1640531535], list_transform(range(0, CAST(n // 16 AS BIGINT)),
        lambda k: [{', '.join(_LANE(0, f'16 * k + {4 * i + 1}') for i in range(4))}])),
      lambda c, w: [{', '.join(_ROUND(f'c[{i + 1}]', f'w[{i + 1}]') for i in range(4))}]) END AS c FROM d),
    m AS (SELECT doc_id, v, n, (CASE WHEN c IS NULL THEN 374761393::HUGEINT ELSE {' + '.join(_rotated(f'c[{i + 1}]', r) for i, r in enumerate((1, 7, 12, 18)))} END + n) % {_X32} AS h FROM a),
    w AS (SELECT doc_id, v, n, list_reduce(list_prepend(h, list_transform(range(0, CAST(n % 16 // 4 AS BIGINT)), lambda k: {_LANE(0, 'CAST(n // 16 * 16 AS BIGINT) + 4 * k + 1')})),
      lambda c, x: {_rotated(f'(c + x * 3266489917) % {_X32}', 17)} * 668265263 % {_X32}) AS h FROM m),
    b AS (SELECT doc_id, list_reduce(list_prepend(h, v[CAST(n // 4 * 4 AS BIGINT) + 1:]), lambda c, x: {_rotated(f'(c + x * 374761393) % {_X32}', 11)} * 2654435761 % {_X32}) AS h FROM w),
    e AS (SELECT doc_id, xor(h, h // 32768) * 2246822519 % {_X32} AS h FROM b), f AS (SELECT doc_id, xor(h, h // 8192) * 3266489917 % {_X32} AS h FROM e)
    SELECT doc_id, CAST(xor(h, h // 65536) AS BIGINT) AS xxh32 FROM f"""


@query(_XXH32)
def xxh32_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sums.xxh32("text").alias("xxh32"))


@query()
def checksums_documents(spark, sf_dir):
    """Sums that SQL lacks: XXH32 and XXH64 with seed 0, CRC-64 of xz, the CRC of bzip2."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", sums.xxh32("text").alias("xxh32"), sums.xxh64("text").alias("xxh64"), sums.crc64("text").alias("crc64"), sums.bzip2_crc("text").alias("bzip2_crc")
    )


_EACH = f"SELECT lang, unnest({BYTES}) AS byte FROM (SELECT lang, encode(text) AS b FROM documents)"


@query(f"SELECT lang, byte, count(*) AS n FROM ({_EACH}) GROUP BY lang, byte")
def byte_histogram(spark, sf_dir):
    return analysis.byte_histogram(table(spark, sf_dir, "documents"), "text", ["lang"])


@query(
    f"SELECT lang, CAST(sum(n) AS BIGINT) AS bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT lang, byte, count(*) AS n FROM ({_EACH}) GROUP BY lang, byte) GROUP BY lang"
)
def entropy_by_lang(spark, sf_dir):
    got = analysis.entropy(analysis.byte_histogram(table(spark, sf_dir, "documents"), "text", ["lang"]), ["lang"])
    return got.withColumn("entropy", F.round("entropy", 6))


_PAIRS = f"SELECT doc_id, i, v[i] AS cur, v[i - 1] AS prev FROM (SELECT doc_id, {BYTES} AS v FROM (SELECT doc_id, encode(text) AS b FROM documents)), unnest(range(1, len(v) + 1)) u(i)"


@query(
    f"""WITH p AS ({_PAIRS}), s AS (SELECT doc_id, i, sum(CASE WHEN i > 1 AND cur = prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p)
    SELECT run_length, count(*) AS n FROM (SELECT count(*) AS run_length FROM s GROUP BY doc_id, run) GROUP BY run_length"""
)
def rle_runs(spark, sf_dir):
    """Maximal runs of equal bytes in the documents by length."""
    return analysis.run_lengths(table(spark, sf_dir, "documents"), "text", [])


@query(
    f"""WITH p AS ({_PAIRS}), s AS (SELECT doc_id, i, sum(CASE WHEN i > 1 AND cur = prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
    r AS (SELECT doc_id, run, count(*) AS n FROM s GROUP BY doc_id, run),
    k AS (SELECT doc_id, run, n // 128 + CASE WHEN n % 128 >= 2 THEN 1 ELSE 0 END AS tokens, CASE WHEN n % 128 = 1 THEN 1 ELSE 0 END AS lit FROM r),
    g AS (SELECT *, sum(CASE WHEN tokens > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY run) AS grp FROM k),
    l AS (SELECT doc_id, grp, sum(lit) AS lits, sum(tokens) AS tokens FROM g GROUP BY doc_id, grp)
    SELECT doc_id, CAST(sum(2 * tokens + lits + (lits + 127) // 128) AS BIGINT) AS size FROM l GROUP BY doc_id"""
)
def rle_encoded_size(spark, sf_dir):
    """Bytes of each document in PackBits."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.octet_length(codec.encode("text", "rle")).cast("long").alias("size"))


@query(f"SELECT doc_id, CAST(sum((cur - CASE WHEN i > 1 THEN prev ELSE 0 END + 256) % 256) AS BIGINT) AS total FROM ({_PAIRS}) GROUP BY doc_id")
def delta_filter(spark, sf_dir):
    """Sum of the delta-filtered bytes of each document."""
    hist = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else int(np.frombuffer(b, dtype=np.uint8).sum(dtype=np.int64))), "long")
    return table(spark, sf_dir, "documents").select("doc_id", hist(codec.encode("text", "delta")).alias("total"))


@query("SELECT n_nationkey, list_transform(v, lambda x, i: CASE WHEN i <= 2 THEN x ELSE (x - v[i - 2] + 256) % 256 END) AS d FROM (SELECT n_nationkey, " + BYTES + " AS v FROM (SELECT n_nationkey, encode(n_name) AS b FROM nation))")
def delta_native(spark, sf_dir):
    """Delta of distance 2 over short values by built-in functions."""
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", analysis.delta(analysis.bytes_of("n_name"), 2).alias("d"))


@query(
    f"""WITH c AS (SELECT prev, cur, count(*) AS n FROM ({_PAIRS}) WHERE i > 1 GROUP BY prev, cur)
    SELECT * FROM (SELECT prev, cur, n, CAST(row_number() OVER (PARTITION BY prev ORDER BY n DESC, cur) AS INTEGER) AS rank FROM c WHERE n >= 3) WHERE rank <= 32"""
)
def bigram_followers_top32(spark, sf_dir):
    """Follower sets over the bytes of the documents."""
    return analysis.followers(analysis.bigrams(table(spark, sf_dir, "documents"), "text", []))


@query(
    "SELECT dmer, count(*) AS n FROM (SELECT unnest(list_transform(range(0, greatest(length(h) // 2 - 7, 0)), lambda i: substr(h, CAST(2 * i + 1 AS INTEGER), 16))) AS dmer FROM (SELECT hex(encode(html)) AS h FROM pages)) GROUP BY dmer"
)
def dmer_counts(spark, sf_dir):
    """Sequences of 8 bytes in the pages, with their counts."""
    return analysis.dmer_counts(table(spark, sf_dir, "pages"), "html").select(F.hex("dmer").alias("dmer"), "n")


@query()
def huffman_lengths_by_lang(spark, sf_dir):
    """Lengths of optimal codes of at most 12 bits for the bytes of each language."""
    return analysis.huffman_lengths(analysis.byte_histogram(table(spark, sf_dir, "documents"), "text", ["lang"]), ["lang"], 12)


@query(
    f"""WITH h AS (SELECT lang, list_sort(list(n)) AS f FROM (SELECT lang, byte, CAST(count(*) AS BIGINT) AS n FROM ({_EACH}) GROUP BY lang, byte) GROUP BY lang),
    p AS (SELECT lang, f, list_reduce(list_prepend(f, list_transform(range(0, 11), lambda k: f)),
      lambda w, g: list_sort(list_concat(g, list_transform(range(1, CAST(len(w) // 2 + 1 AS BIGINT)), lambda i: w[2 * i - 1] + w[2 * i])))) AS w FROM h)
    SELECT lang, CAST(len(f) AS BIGINT) AS symbols, CAST(4096 AS BIGINT) AS kraft, CAST(list_sum(w[1:2 * len(f) - 2]) AS BIGINT) AS cost FROM p"""
)
def huffman_cost_by_lang(spark, sf_dir):
    """Symbols, Kraft sum (of 4096) and bits of optimal codes of at most 12 bits for the bytes of each language."""
    hist = analysis.byte_histogram(table(spark, sf_dir, "documents"), "text", ["lang"])
    lengths = analysis.huffman_lengths(hist, ["lang"], 12)
    both = lengths.select("lang", F.col("byte").alias("b"), "length").join(hist.select(F.col("lang").alias("l2"), "byte", "n"), (F.col("lang").eqNullSafe(F.col("l2"))) & (F.col("b") == F.col("byte")))
    kraft = F.sum(F.pow(F.lit(2.0), 12 - F.col("length"))).cast("long")
    return both.groupBy("lang").agg(F.count("*").alias("symbols"), kraft.alias("kraft"), F.sum(F.col("n") * F.col("length")).alias("cost"))


@query(
    """WITH h AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
    d AS (SELECT item_id, i, substr(h, CAST(2 * i + 1 AS INTEGER), 16) AS m FROM h, unnest(range(0, greatest(length(h) // 2 - 7, 0))) u(i)),
    l AS (SELECT item_id, i - lag(i) OVER (PARTITION BY item_id, m ORDER BY i) AS back FROM d)
    SELECT h.item_id, count(l.item_id) AS positions, count(CASE WHEN back <= 32768 THEN 1 END) AS repeated FROM h LEFT JOIN l ON h.item_id = l.item_id GROUP BY h.item_id"""
)
def repeated_windows(spark, sf_dir):
    """Places in the benchmark texts where a match finder of 8 bytes and 32 KiB finds one."""
    return analysis.repeated_positions(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(
    """WITH l AS (SELECT p_size AS symbol, CAST(ceil(log2(p.n / c.n)) + 1 AS BIGINT) AS length FROM (SELECT p_size, count(*)::DOUBLE AS n FROM part GROUP BY p_size) c, (SELECT count(*)::DOUBLE AS n FROM part) p)
    SELECT symbol, length, CAST(coalesce(sum(pow(2, m - length)) OVER (ORDER BY length, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / pow(2, m - length) AS BIGINT) AS code
    FROM (SELECT *, max(length) OVER () AS m FROM l)"""
)
def canonical_huffman_codes(spark, sf_dir):
    """Canonical codes for part sizes, with lengths from their frequencies."""
    part = table(spark, sf_dir, "part")
    total = float(part.count())
    lengths = part.groupBy(F.col("p_size").alias("symbol")).agg((F.ceil(F.log2(F.lit(total) / F.count("*"))) + 1).cast("long").alias("length"))
    return analysis.canonical_codes(lengths, [])


@query(
    """WITH r AS (SELECT n_nationkey, i, substr(n_name, CAST(i + 1 AS INTEGER)) || substr(n_name, 1, CAST(i AS INTEGER)) AS t FROM nation, unnest(range(0, length(n_name))) u(i)),
    s AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY t, i) - 1 AS n FROM r)
    SELECT n_nationkey, string_agg(right(t, 1), '' ORDER BY n) AS bwt, CAST(min(CASE WHEN i = 0 THEN n END) AS INTEGER) AS origin FROM s GROUP BY n_nationkey"""
)
def bwt_names(spark, sf_dir):
    """Burrows-Wheeler transform of the nations' names."""
    return analysis.burrows_wheeler(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@query(
    f"""WITH v AS (SELECT n_nationkey, {BYTES} AS v FROM (SELECT n_nationkey, encode(n_name) AS b FROM nation)),
    e AS (SELECT n_nationkey, v, i, v[i] AS x, list_position(list_reverse(v[1:i - 1]), v[i]) AS back FROM v, unnest(range(1, len(v) + 1)) u(i))
    SELECT n_nationkey, list(CAST(CASE WHEN back IS NOT NULL THEN len(list_distinct(v[i - back + 1:i - 1]))
      ELSE x + len(list_filter(list_distinct(v[1:i - 1]), lambda y: y > x)) END AS INTEGER) ORDER BY i) AS ranks FROM e GROUP BY n_nationkey"""
)
def mtf_names(spark, sf_dir):
    """Move-to-front ranks of the bytes of the nations' names."""
    return table(spark, sf_dir, "nation").select("n_nationkey", analysis.move_to_front("n_name").alias("ranks"))


@query(
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'zstd' WHEN 1 THEN 'lz4' WHEN 2 THEN 'gzip' WHEN 3 THEN 'bzip2' WHEN 4 THEN 'xz' ELSE 'zlib' END AS method FROM documents"
)
def detect_mix(spark, sf_dir):
    """Documents encoded by a method each, and the method that detection names; every other one behind a skippable frame."""
    return _mixed(spark, sf_dir).select("doc_id", codec.detect("b").alias("method"))


def _mixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.element_at(F.array(*map(F.lit, ("zstd", "lz4", "gzip", "bzip2", "xz", "zlib"))), (F.col("doc_id") % 6 + 1).cast("int"))
    packed = docs.select("doc_id", codec.encode_by("text", name).alias("b"))
    skip = F.concat(frames.skippable_frame(F.encode(F.lit("note"), "UTF-8"), 3), F.col("b"))
    return packed.withColumn("b", F.when(F.floor(F.col("doc_id") / 6) % 2 == 1, skip).otherwise(F.col("b")))


@query("SELECT doc_id, sha256(encode(text)) AS digest FROM documents")
def detect_and_decode(spark, sf_dir):
    """Documents encoded by a method each, decoded by what detection names."""
    return _mixed(spark, sf_dir).select("doc_id", F.sha2(codec.decode_detected("b"), 256).alias("digest"))


@query("SELECT doc_id, sha256(unhex(array_to_string(list_reverse(regexp_extract_all(hex(encode(text)), '..')), ''))) AS digest, true AS ok FROM documents")
def user_method_roundtrip(spark, sf_dir):
    """A method that a user registers, on the executors: the digest of what it makes of each document, and whether it comes back."""
    register(Method("mirror", "bytes in reverse order", lambda b, o: b[::-1], lambda b, o: b[::-1]))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    docs = docs.withColumn("m", codec.encode("b", "mirror"))
    return docs.select("doc_id", F.sha2("m", 256).alias("digest"), (codec.decode("m", "mirror") == F.col("b")).alias("ok"))


@query("SELECT count(*) AS n FROM range(0, 65536) t(x) WHERE x // 256 % 16 = 8 AND x // 256 < 128 AND x % 31 = 0")
def zlib_header_guess_count(spark, sf_dir):
    """Pairs of bytes that pass for a zlib header."""
    pair = F.unhex(F.lpad(F.hex("id"), 4, "0"))
    return spark.range(65536).where(codec.zlib_header(pair)).agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, n + 5 * (greatest(1, (n + 2047) // 2048) + 1) AS deflate, n + 5 * (greatest(1, (n + 2047) // 2048) + 1) + 18 AS gzip, n + n // 50 + 1024 AS bzip2,
    n + 6 * greatest(1, (n + 16383) // 16384) + 64 AS lzma2, n + 19 + greatest(1, (n + 4194303) // 4194304) * 4 + 4 AS lz4, n + 18 + 3 * (greatest(1, (n + 131071) // 131072) + 1) AS zstd,
    ((n + 3 + n // 3838) * 12 + 7) // 8 + 1 AS lzw, CASE WHEN n = 0 THEN 0 ELSE n + greatest(1, (n + 2) // 3) + 1 END AS rle, n + 44 + 6 * greatest(1, (n + 16383) // 16384) + CASE WHEN n = 0 THEN 0 ELSE 155 END AS xz,
    n + 8 * greatest(1, (n + 32767) // 32768) + 32 AS deflate64, CASE WHEN n = 0 THEN 2 ELSE n + 3 * greatest(1, (n + 65535) // 65536) + 3 END AS brotli, 2 * n + 16 AS shrink, 5 * n + 9000 AS reduce, 3 * n + 1024 AS implode,
    n AS delta, CAST(NULL AS BIGINT) AS lzma FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents)"""
)
def encode_bounds(spark, sf_dir):
    """Most bytes that each document can take, by method."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    names = ("deflate", "gzip", "bzip2", "lzma2", "lz4", "zstd", "lzw", "rle", "xz", "deflate64", "brotli", "shrink", "reduce", "implode", "delta", "lzma")
    return docs.select("doc_id", *(codec.encode_bound("n", m).alias(m) for m in names))


@query(
    "SELECT doc_id, CAST(f AS INTEGER) AS frame_no, CAST(f * 4096 AS BIGINT) AS d_off, CAST(least(4096, n - f * 4096) AS BIGINT) AS d_len FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents), unnest(range(0, (n + 4095) // 4096)) u(f)"
)
def seek_frames_index(spark, sf_dir):
    """Frames of 4096 bytes of each document."""
    return frames.slices(table(spark, sf_dir, "documents"), "doc_id", "text", 4096).drop("data")


@query("SELECT doc_id, substr(hex(encode(text)), 2 * 3000 + 1, 2 * 2500) AS data FROM documents WHERE octet_length(encode(text)) > 3000")
def seek_range_read(spark, sf_dir):
    """Bytes 3000 to 5500 of each document from its frames."""
    table_ = frames.frame_table(table(spark, sf_dir, "documents"), "doc_id", "text", 4096)
    return frames.range_read(table_, "doc_id", 3000, 2500).select("doc_id", F.hex("data").alias("data"))


@query("SELECT doc_id, CAST((octet_length(encode(text)) + 4095) // 4096 AS BIGINT) AS n_frames FROM documents")
def zstd_walk_frames(spark, sf_dir):
    """Frames that a walk over the seekable file of each document finds."""
    frames.register_walks(spark)
    packed = table(spark, sf_dir, "documents").select("doc_id", codec.encode("text", "zstd", zstd__seekable=True, zstd__seekable_frame_size=4096).alias("b"))
    walked = packed.lateralJoin(frames.ZstdWalk(F.col("b").outer()))
    return walked.groupBy("doc_id").agg(F.count_if(F.col("kind") == "frame").alias("n_frames"))


@query("SELECT doc_id, CAST(greatest(1, (octet_length(encode(text)) + 65535) // 65536) AS BIGINT) AS n_blocks FROM documents WHERE octet_length(encode(text)) > 0")
def lz4_walk_blocks(spark, sf_dir):
    """Blocks of the LZ4 frame of each document."""
    frames.register_walks(spark)
    packed = table(spark, sf_dir, "documents").where(F.octet_length("text") > 0).select("doc_id", codec.encode("text", "lz4", lz4__block_size=65536).alias("b"))
    return packed.lateralJoin(frames.Lz4Walk(F.col("b").outer())).groupBy("doc_id").agg(F.count_if(F.col("kind").isin("block", "raw")).alias("n_blocks"))


@query("SELECT doc_id, CAST(7 AS BIGINT) AS header_size, true AS checksum, CAST(65536 AS BIGINT) AS block_size FROM documents")
def peek_lz4(spark, sf_dir):
    """Header facts of the LZ4 frame of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", codec.encode("text", "lz4", lz4__content_checksum=True, lz4__block_size=65536).alias("b"))
    facts = codec.peek("b", "lz4")
    return docs.select("doc_id", *(facts[n].alias(n) for n in ("header_size", "checksum", "block_size")))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS content_size FROM documents")
def peek_zstd(spark, sf_dir):
    """Sizes that Zstandard frames of the documents state."""
    docs = table(spark, sf_dir, "documents").select("doc_id", codec.encode("text", "zstd").alias("b"))
    return docs.select("doc_id", codec.peek("b", "zstd")["content_size"].alias("content_size"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS ok FROM documents")
def filter_chain_roundtrip(spark, sf_dir):
    """xz with a chain of delta and x86 filters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    docs = docs.withColumn("back", codec.decode(codec.encode("b", "xz", xz__filters="delta:4,x86"), "xz"))
    return docs.select("doc_id", F.octet_length("back").cast("long").alias("n_bytes"), (F.col("back") == F.col("b")).alias("ok"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'CORRUPT' ELSE 'OK' END AS status, count(*) AS n FROM documents GROUP BY 1")
def try_decode_corrupt(spark, sf_dir):
    """Statuses of gzip values of which every other one lacks its last byte."""
    docs = table(spark, sf_dir, "documents").select("doc_id", codec.encode("text", "gzip").alias("b"))
    broken = F.substring("b", F.lit(1), F.octet_length("b") - 1)
    tried = codec.try_decode(F.when(F.col("doc_id") % 2 == 0, broken).otherwise(F.col("b")), "gzip")
    return docs.select(tried["status"].alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS raw_bytes FROM documents GROUP BY ROLLUP (lang, source)")
def ratio_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("text")).alias("raw_bytes"))


@query()
def ratio_by_method(spark, sf_dir):
    """Bytes of the documents by method and language, with rollup: the size report of fast methods."""
    docs = table(spark, sf_dir, "documents").select("lang", F.encode("text", "UTF-8").alias("b"))
    sized = docs.select("lang", F.octet_length("b").alias("raw"), *(F.octet_length(codec.encode("b", m)).alias(m) for m in ("deflate", "gzip", "bzip2", "xz", "zstd")))
    long = sized.unpivot(["lang", "raw"], ["deflate", "gzip", "bzip2", "xz", "zstd"], "method", "packed")
    return long.rollup("method", "lang").agg(F.sum("raw").alias("raw_bytes"), F.sum("packed").alias("packed_bytes"))


@query("SELECT * FROM (VALUES ('deflate.wrong'), ('no.such')) t(key)")
def options_unknown_keys(spark, sf_dir):
    """Option keys that the catalog does not know."""
    asked = spark.createDataFrame([("deflate.level",), ("deflate.wrong",), ("zstd.level",), ("no.such",)], "key string")
    return asked.join(codec_options(spark).select("key"), "key", "left_anti")


@query(fixed.OPTIONS_SQL)
def catalog_options(spark, sf_dir):
    return codec_options(spark).withColumn("allowed", F.array_join("allowed", "|"))


@query(fixed.METHODS_SQL)
def catalog_methods(spark, sf_dir):
    """The methods of the library itself."""
    return codec_methods(spark).where(F.col("method") != "mirror")


@query(
    "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS messages, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY 1"
)
def event_frames_tumbling(spark, sf_dir):
    """Frames of bounded size of the events of each day, summed up by day."""
    events = table(spark, sf_dir, "events")
    got = streaming.windowed_frames_bounded(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_id"], "props", frame_bytes=1 << 16)
    days = got.groupBy(F.col("start").cast("timestamp_ntz").alias("start"))
    return days.agg(F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"))


@query(
    "SELECT event_type AS key, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, true AS ok FROM events WHERE octet_length(encode(props)) > 0 GROUP BY 1"
)
def streaming_event_frames(spark, sf_dir):
    """The events as a stream in several micro-batches: bytes by type, and whether the decoded frames have the length and the running CRC told."""
    path, events = shared_path(spark, "stream"), table(spark, sf_dir, "events")
    events.select("event_id", "event_type", "props").repartition(3, "event_id").write.parquet(path + "/in")
    stream = spark.readStream.schema("event_id long, event_type string, props string").option("maxFilesPerTrigger", 1).parquet(path + "/in")
    out = streaming.encode_stream(stream, "event_type", ["event_id"], "props")
    run = out.writeStream.format("parquet").option("checkpointLocation", path + "/state").outputMode("append").trigger(availableNow=True).start(path + "/out")
    run.awaitTermination()
    read = spark.read.schema(streaming.FRAMES).parquet(path + "/out")
    plain = codec.decode("frame", "zstd")
    parts = F.array_sort(F.collect_list(F.struct("frame_no", F.hex(plain).alias("h"), "running_crc32")))
    whole = read.groupBy("key").agg(F.sum("d_len").alias("bytes"), parts.alias("_p"))
    data = F.unhex(F.array_join(F.transform("_p", lambda x: x["h"]), ""))
    return whole.select("key", "bytes", ((F.octet_length(data) == F.col("bytes")) & (F.crc32(data) == F.element_at("_p", -1)["running_crc32"])).alias("ok"))


@query("SELECT CAST(page_id AS VARCHAR) AS key, CAST(octet_length(encode(html)) AS BIGINT) AS d_len, sha256(encode(html)) AS digest FROM pages")
def framed_source(spark, sf_dir):
    """The pages written as framed files and read back."""
    framed.register(spark)
    path = shared_path(spark, "framed")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), F.encode("html", "UTF-8").alias("data"))
    pages.write.format("framed").mode("append").save(path)
    return spark.read.format("framed").load(path).select("key", "d_len", F.sha2("data", 256).alias("digest"))


@query("SELECT CAST(page_id AS VARCHAR) AS key FROM pages WHERE octet_length(encode(html)) > 4000 AND CAST(page_id AS VARCHAR) LIKE '1%'")
def framed_source_pushdown(spark, sf_dir):
    """Frames chosen by their index alone."""
    framed.register(spark)
    path = shared_path(spark, "framed")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), F.encode("html", "UTF-8").alias("data"))
    pages.write.format("framed").mode("append").save(path)
    return spark.read.format("framed").load(path).where("d_len > 4000 and key like '1%'").select("key")


@query()
def dictionary_gain(spark, sf_dir):
    """Bytes of held-out pages, a record each, without and with a dictionary that was trained on the others."""
    pages = table(spark, sf_dir, "pages").select("html", (F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0).alias("held"))
    trained = dictionary.train(pages.where("not held"), "html", capacity=8192)
    pages = pages.where("held").select(F.encode("html", "UTF-8").alias("b"))
    with_ = {"options": {"zlib.dictionary": trained}} if trained else {}
    sized = pages.select(F.octet_length("b").alias("raw"), F.octet_length(codec.encode("b", "zlib")).alias("plain"), F.octet_length(codec.encode("b", "zlib", **with_)).alias("with_dictionary"))
    return sized.agg(F.sum("raw").alias("raw_bytes"), F.sum("plain").alias("plain_bytes"), F.sum("with_dictionary").alias("dictionary_bytes"))


_SOURCES = "SELECT source, encode(string_agg(text, '' ORDER BY doc_id)) AS b FROM documents WHERE source IS NOT NULL GROUP BY source"


def _seekable_files(spark, sf_dir):
    """The texts of each source as a seekable file, in frames of 16 KiB."""
    path = shared_path(spark, "seekable")
    docs = table(spark, sf_dir, "documents").where("source is not null")
    rows = docs.repartition("source").sortWithinPartitions("source", "doc_id").select(F.col("source").alias("path"), F.encode("text", "UTF-8").alias("data"))
    seekable.register(spark)
    rows.write.format("seekable").option("frameSize", 16384).mode("append").save(path)
    return path


@query(f"SELECT source AS path, substr(hex(b), 2 * 30000 + 1, 2 * 50000) AS data FROM ({_SOURCES}) WHERE octet_length(b) > 30000")
def seekable_file_range(spark, sf_dir):
    """Bytes 30000 to 80000 of the seekable file of each source."""
    got = seekable.range_read(spark, _seekable_files(spark, sf_dir), 30_000, 50_000)
    return got.select("path", F.hex("data").alias("data"))


@query(
    f"SELECT source AS path, CAST(f AS BIGINT) AS frame_no, CAST(f * 16384 AS BIGINT) AS d_off, CAST(least(16384, n - f * 16384) AS BIGINT) AS d_len FROM (SELECT source, octet_length(b) AS n FROM ({_SOURCES})), unnest(range(0, (n + 16383) // 16384)) u(f) WHERE f * 16384 >= 32768"
)
def seekable_file_frames(spark, sf_dir):
    """Frames from the third on of the seekable file of each source, by the tables in the footers alone."""
    frames_ = seekable.load(spark, _seekable_files(spark, sf_dir), splitBytes=1 << 20)
    return frames_.where("d_off >= 32768").select("path", "frame_no", "d_off", "d_len")


@query("SELECT doc_id, true AS has_table, CAST((octet_length(encode(text)) + 4095) // 4096 AS BIGINT) AS frame_count, CAST(octet_length(encode(text)) AS BIGINT) AS size, substr(hex(encode(text)), 2 * 1000 + 1, 2 * 5000) AS part FROM documents")
def seekable_values(spark, sf_dir):
    """What the seek table of each document's seekable value tells, and bytes 1000 to 6000 read through it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", codec.encode("text", "zstd", zstd__seekable=True, zstd__seekable_frame_size=4096).alias("b"))
    told = docs.withColumn("i", seekable.info("b"))
    return told.select("doc_id", "i.has_table", "i.frame_count", "i.size", F.hex(seekable.read_bytes("b", 1000, 5000)).alias("part"))


@query("SELECT lang, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, 'gzip' AS method FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY lang")
def compressed_files(spark, sf_dir):
    """The documents written by Spark as gzip text files, and read as files of a format that their content tells."""
    path = shared_path(spark, "files")
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    docs.select("lang", "text").write.partitionBy("lang").option("compression", "gzip").text(path)
    got = files.read(spark, path, "*.gz").withColumn("lang", F.regexp_extract("path", "lang=([^/]+)/", 1))
    return got.groupBy("lang").agg(F.sum(F.octet_length("data")).cast("long").alias("bytes"), F.max("method").alias("method"))


def _pieces_as_stream(spark, sf_dir, method, size):
    """A stream of the pieces, cut without regard to frames, of the encoded documents, in several micro-batches."""
    path = shared_path(spark, "pieces")
    docs = table(spark, sf_dir, "documents").select("doc_id", codec.encode("text", method).alias("b"))
    pieces = frames.slices(docs, "doc_id", "b", size).select("doc_id", "frame_no", "data")
    for k, few in enumerate(("frame_no < 1", "frame_no between 1 and 3", "frame_no > 3")):
        pieces.where(few).coalesce(4).write.mode("append").parquet(f"{path}/in")
    return path, spark.readStream.schema("doc_id long, frame_no int, data binary").option("maxFilesPerTrigger", 4).parquet(f"{path}/in")


def _ran(spark, stream, path, schema):
    run = stream.writeStream.format("parquet").option("checkpointLocation", path + "/state").outputMode("append").trigger(availableNow=True).start(path + "/out")
    run.awaitTermination()
    return spark.read.schema(schema).parquet(path + "/out")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, 'OK' AS status, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(encode(text)) AS digest FROM documents WHERE text IS NOT NULL")
def stream_decode_roundtrip(spark, sf_dir):
    """The gzip members of the documents, arriving in pieces of 700 bytes over several micro-batches, decoded as they complete."""
    path, stream = _pieces_as_stream(spark, sf_dir, "gzip", 700)
    got = _ran(spark, streaming.decode_stream(stream, "doc_id", ["frame_no"], "data", "gzip"), path, streaming.DECODED)
    return got.select("key", "status", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("digest"))


@query("SELECT event_type AS key, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, sha256(encode(string_agg(props, '' ORDER BY event_id % 3, event_id))) AS digest FROM events WHERE props IS NOT NULL GROUP BY event_type")
def stream_sync_flush(spark, sf_dir):
    """Events as a stream, sync-flushed at every micro-batch: the pieces of a type are one DEFLATE stream."""
    path, events = shared_path(spark, "sync"), table(spark, sf_dir, "events").where("props is not null")
    rows = events.select("event_id", "event_type", "props", (F.col("event_id") % 3).alias("turn"))
    for k in range(3):
        rows.where(F.col("turn") == k).coalesce(1).write.mode("append").parquet(path + "/in")
    stream = spark.readStream.schema("event_id long, event_type string, props string, turn long").option("maxFilesPerTrigger", 1).parquet(path + "/in")
    read = _ran(spark, streaming.encode_stream(stream, "event_type", ["event_id"], "props", "deflate", flush="sync"), path, streaming.FRAMES)
    ordered = F.array_sort(F.collect_list(F.struct("frame_no", F.hex("frame").alias("h"))))
    # The stream was never finished: an empty final block ends it.
    whole = F.unhex(F.concat(F.array_join(F.transform(ordered, lambda x: x["h"]), ""), F.lit("0300")))
    joined = read.groupBy("key").agg(whole.alias("b"))
    plain = codec.decode("b", "deflate", limits__max_expansion_ratio=0)
    return joined.select("key", plain.alias("p")).select("key", F.octet_length("p").cast("long").alias("bytes"), F.sha2("p", 256).alias("digest"))


# Relational operations around the codecs ------------------------------------------------------------------


@query(
    """WITH f AS (SELECT event_id, user_id, ts, octet_length(encode(props)) AS n FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error')
    SELECT f.event_id, f.n::BIGINT AS bytes, (SELECT max(e.ts) FROM e WHERE e.user_id = f.user_id AND e.ts < f.ts) AS last_error FROM f"""
)
def asof_last_error(spark, sf_dir):
    """As-of join: for each purchase the last error of its user before it, by one pass over both in the order of time."""
    events = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    events = events.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    before = Window.partitionBy("user_id").orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "error", F.col("ts"))).over(before)
    found = events.withColumn("last_error", last).where("event_type = 'purchase'")
    return found.select("event_id", F.octet_length("props").cast("long").alias("bytes"), F.col("last_error").cast("timestamp_ntz").alias("last_error"))


@query(
    """WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents), f AS (SELECT doc_id, i, i * 4096 AS lo, least(n, i * 4096 + 4096) AS hi FROM d, unnest(range(0, (n + 4095) // 4096)) u(i)),
    r AS (SELECT doc_id, doc_id % 7 * 1500 AS a, doc_id % 7 * 1500 + 3000 AS b FROM d) SELECT r.doc_id, count(*) AS n_frames, CAST(sum(least(hi, b) - greatest(lo, a)) AS BIGINT) AS bytes FROM r JOIN f ON r.doc_id = f.doc_id AND f.lo < r.b AND f.hi > r.a GROUP BY r.doc_id"""
)
def interval_frames(spark, sf_dir):
    """Interval join: the frames that a range of each document overlaps, and their bytes in it."""
    docs = table(spark, sf_dir, "documents")
    index = frames.slices(docs, "doc_id", "text", 4096).select(F.col("doc_id").alias("d"), F.col("d_off").alias("lo"), (F.col("d_off") + F.col("d_len")).alias("hi"))
    asked = docs.select("doc_id", (F.col("doc_id") % 7 * 1500).alias("a")).withColumn("b", F.col("a") + 3000)
    hit = asked.join(index, (F.col("doc_id") == F.col("d")) & (F.col("lo") < F.col("b")) & (F.col("hi") > F.col("a")))
    bytes_ = F.sum(F.least("hi", "b") - F.greatest("lo", "a")).cast("long")
    return hit.groupBy("doc_id").agg(F.count("*").alias("n_frames"), bytes_.alias("bytes"))


_BANDS = "(VALUES ('small', 0, 1000), ('middle', 1000, 10000), ('large', 10000, 1000000000)) b(band, lo, hi)"


@query(f"SELECT band, lang, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents JOIN {_BANDS} ON octet_length(encode(text)) >= lo AND octet_length(encode(text)) < hi GROUP BY band, lang")
def theta_size_bands(spark, sf_dir):
    """Theta join: documents with the band of sizes that they fall in, three rows that go to every task."""
    bands = spark.createDataFrame([("small", 0, 1000), ("middle", 1000, 10000), ("large", 10000, 1000000000)], "band string, lo int, hi int")
    docs = table(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("n"))
    both = docs.join(F.broadcast(bands), (F.col("n") >= F.col("lo")) & (F.col("n") < F.col("hi")))
    return both.groupBy("band", "lang").agg(F.count("*").alias("n"), F.sum("n").alias("bytes"))


@query(
    """SELECT o_orderpriority, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"""
)
def merge_join_priorities(spark, sf_dir):
    """Sort-merge join of two large tables on their key, asked for by name."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").hint("merge")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("(SELECT lang, source FROM documents WHERE n_chars > 5000 INTERSECT SELECT lang, source FROM documents WHERE n_chars < 200) EXCEPT SELECT lang, source FROM documents WHERE n_chars BETWEEN 1000 AND 1010")
def intersect_except_sources(spark, sf_dir):
    """Languages and sources that have long and short documents, but none of about a thousand characters."""
    docs = table(spark, sf_dir, "documents")
    pairs = lambda cond: docs.where(cond).select("lang", "source")
    return pairs("n_chars > 5000").intersect(pairs("n_chars < 200")).exceptAll(pairs("n_chars between 1000 and 1010").distinct())


@query(
    "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT substr(sha256(encode(text)), 1, 2)) AS first_bytes FROM documents GROUP BY lang"
)
def distinct_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.substring(sums.sha256("text"), 1, 2)).alias("first_bytes"))


@query(
    """SELECT date_trunc('month', ts) AS month, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS digit, count(*) AS n, round(sum(sqrt(value)), 6) AS roots, CAST(max(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts))) AS INTEGER) AS last_day
    FROM events GROUP BY 1, 2"""
)
def json_by_month(spark, sf_dir):
    """JSON, dates and mathematics over the events."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    key = F.get_json_object("props", "$.k").cast("long") % 10
    days = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return events.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), key.alias("digit")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.sqrt("value")), 6).alias("roots"), F.max(days).alias("last_day")
    )


@query(
    "SELECT lang, CAST(list_sum(map_values(m)) AS BIGINT) AS n, CAST(cardinality(m) AS BIGINT) AS kinds, CAST(list_max(map_values(m)) AS BIGINT) AS most FROM (SELECT lang, histogram(source) AS m FROM documents GROUP BY lang)"
)
def map_of_sources(spark, sf_dir):
    """A map from source to its documents for each language, and what its values say."""
    counts = table(spark, sf_dir, "documents").where("source is not null").groupBy("lang", "source").agg(F.count("*").alias("n"))
    maps = counts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    return maps.select("lang", total.alias("n"), F.size("m").cast("long").alias("kinds"), F.array_max(F.map_values("m")).alias("most"))


@query(
    "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS messages FROM events WHERE ts < (SELECT max(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) FROM events) GROUP BY 1"
)
def watermark_days(spark, sf_dir):
    """Events as a stream in the order of time: the days that a watermark of one hour closes, which are all but the last."""
    path, events = shared_path(spark, "late"), table(spark, sf_dir, "events")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    middle = rows.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    rows.where(F.col("ts") <= F.lit(middle)).coalesce(1).write.mode("append").parquet(path + "/in")
    rows.where(F.col("ts") > F.lit(middle)).coalesce(1).write.mode("append").parquet(path + "/in")
    stream = spark.readStream.schema("ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(path + "/in")
    days = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("messages"))
    got = _ran(spark, days.select(F.col("w.start").alias("start"), "messages"), path, "start timestamp, messages long")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "messages")


# Stages of entropy coders -----------------------------------------------------------------------------------


@query(
    f"""WITH p AS ({_PAIRS}), s AS (SELECT doc_id, i, sum(CASE WHEN i > 1 AND cur = prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
    r AS (SELECT doc_id, run, count(*) AS n FROM s GROUP BY doc_id, run)
    SELECT doc_id, CAST(sum(n // 255 * 5 + CASE WHEN n % 255 < 4 THEN n % 255 ELSE 5 END) AS BIGINT) AS size, true AS ok FROM r GROUP BY doc_id"""
)
def rle1_sizes(spark, sf_dir):
    """Bytes of each document after the run stage of bzip2, and whether it comes back."""
    docs = table(spark, sf_dir, "documents").where(F.octet_length("text") > 0).select("doc_id", F.encode("text", "UTF-8").alias("b"))
    there = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else rle.rle1_encode(bytes(b))), "binary")
    back = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else rle.rle1_decode(bytes(b))), "binary")
    docs = docs.withColumn("r", there("b"))
    return docs.select("doc_id", F.octet_length("r").cast("long").alias("size"), (back("r") == F.col("b")).alias("ok"))


@query(
    f"""WITH h AS (SELECT lang, byte, CAST(count(*) AS BIGINT) AS n FROM ({_EACH}) GROUP BY lang, byte), f AS (SELECT lang, byte, n, greatest(1, n * 4096 // sum(n) OVER (PARTITION BY lang)) AS norm FROM h)
    SELECT lang, byte, n, CAST(norm + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY n DESC, byte) = 1 THEN 4096 - sum(norm) OVER (PARTITION BY lang) ELSE 0 END AS BIGINT) AS norm FROM f"""
)
def fse_counts_by_lang(spark, sf_dir):
    """Byte counts of each language scaled to 4096 states."""
    return analysis.fse_counts(analysis.byte_histogram(table(spark, sf_dir, "documents"), "text", ["lang"]), ["lang"], 12)


@query("SELECT unnest(['stored', 'fixed']) AS form, unnest(['level 0', 'strategy fixed']) AS setting, count(*) AS n FROM documents WHERE octet_length(encode(text)) > 0")
def block_forms(spark, sf_dir):
    """How DEFLATE codes the documents when it is told to store, or to use fixed codes."""
    docs = table(spark, sf_dir, "documents").where(F.octet_length("text") > 0)
    told = docs.select(
        F.explode(
            F.array(
                F.struct(analysis.block_form(codec.encode("text", "deflate", deflate__level=0)).alias("form"), F.lit("level 0").alias("setting")),
                F.struct(analysis.block_form(codec.encode("text", "deflate", deflate__strategy="fixed")).alias("form"), F.lit("strategy fixed").alias("setting")),
            )
        ).alias("x")
    )
    return told.groupBy("x.form", "x.setting").agg(F.count("*").alias("n"))


@query()
def context_clusters_by_lang(spark, sf_dir):
    """Bytes in clusters of contexts that share a code, by language."""
    return analysis.context_clusters(analysis.bigrams(table(spark, sf_dir, "documents"), "text", ["lang"]), ["lang"])


@query()
def block_starts(spark, sf_dir):
    """Where blocks with codes of their own begin in each document."""
    return table(spark, sf_dir, "documents").select("doc_id", analysis.blocks_of("text").alias("starts"))
