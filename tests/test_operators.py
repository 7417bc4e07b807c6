import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from octaframe import catalog
from octaframe.codecs import checksums as kernels
from octaframe.codecs import zstds
from octaframe.errors import CodecError
from octaframe.functions import checksums, codec
from octaframe.functions.codec import decode_bytes, encode_bytes
from octaframe.operators import analysis, dictionary, frames
from octaframe.sources import files, framed, seekable

R = random.Random(3)
VALUES = [None, b"", b"a", b"aab", b"abc" * 500, bytes(range(256)) * 4, R.randbytes(3000), b"\0" * 1000]


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame([(i, bytearray(v) if v is not None else None) for i, v in enumerate(VALUES)], "id long, b binary")


def test_encode_decode_columns(blobs):
    for method in ("zlib", "rle", "lz4", "zstd"):
        got = blobs.select("id", codec.decode(codec.encode("b", method), method).alias("x")).collect()
        assert [r.x if r.x is None else bytes(r.x) for r in sorted(got)] == VALUES


def test_options_are_checked_when_the_column_is_made():
    with pytest.raises(CodecError):
        codec.encode("b", "zlib", deflate__level=11)
    with pytest.raises(CodecError):
        codec.encode("b", "nothing")


def test_try_decode(blobs):
    got = blobs.select("id", codec.try_decode("b", "gzip").alias("t")).collect()
    assert [r.t if r.t is None else r.t.status for r in sorted(got)] == [None] + ["CORRUPT"] * 7


def test_detect_peek_and_skippable(spark):
    names = ["zstd", "lz4", "gzip", "bzip2", "xz", "zlib"]
    rows = [(n, bytearray(encode_bytes(b"hello" * 50, n))) for n in names] + [(None, bytearray(b"PK\3\4....")), (None, bytearray(b"ab"))]
    df = spark.createDataFrame(rows, "name string, b binary")
    assert all(r.name == r.d for r in df.select("name", codec.detect("b").alias("d")).collect())
    skip = frames.skippable_frame(F.lit(b"meta"), 2)
    assert all(r.name == r.d for r in df.where("name is not null").select("name", codec.detect(F.concat(skip, skip, F.col("b"))).alias("d")).collect())
    z = df.where("name = 'zstd'").select(codec.peek("b", "zstd").alias("p")).first().p
    assert z.content_size == 250 and not z.checksum
    assert df.where("name = 'gzip'").select(codec.peek("b", "zstd").alias("p")).first().p is None


def test_bounds_agree_with_integers(blobs):
    for m in catalog.methods():
        got = blobs.select(F.octet_length("b").alias("n"), codec.encode_bound(F.octet_length("b"), m.name).alias("x")).where("n is not null").collect()
        for r in got:
            assert r.x == (None if m.bound is None else m.bound(catalog.IntArith, r.n, m.validated({}))), m.name


def test_ratio_predicate(spark):
    df = spark.createDataFrame([(0, 5), (1, 10), (1, 11), (1 << 60, 1 << 62)], "a long, b long")
    assert [r.x for r in df.select(codec.within_ratio(F.col("a"), F.col("b"), 10).alias("x")).collect()] == [True, True, False, True]


def test_user_methods(spark, blobs):
    catalog.register(catalog.Method("reverse", "test", lambda b, o: b[::-1], lambda b, o: b[::-1]))
    assert encode_bytes(b"abc", "reverse") == b"cba"


def test_user_methods_reach_the_executors(spark, blobs, tmp_path):
    shift = catalog.Option("shift.by", "int64", 1, 0, 255)
    turn = lambda b, k: bytes((x + k) & 255 for x in b)
    catalog.register(catalog.Method("shift", "test", lambda b, o: turn(b, o["shift.by"]), lambda b, o: turn(b, -o["shift.by"]), (shift,), magic=None))
    packed = blobs.select("id", codec.encode("b", "shift", shift__by=3).alias("p"))
    got = {r.id: r for r in packed.select("id", "p", codec.decode("p", "shift", shift__by=3).alias("b"), codec.try_decode("p", "shift", shift__by=3).alias("t")).collect()}
    for i, v in enumerate(VALUES):
        assert (got[i].p, got[i].b) == ((None, None) if v is None else (turn(v, 3), v)) and (v is None or bytes(got[i].t.value) == v)
    with pytest.raises(CodecError):
        codec.encode("b", "shift", shift__by=300)
    codec.register_functions(spark)
    blobs.createOrReplaceTempView("to_shift")
    assert [r.x for r in spark.sql("SELECT id, decode_shift(encode_shift(b)) AS x FROM to_shift ORDER BY id").collect()] == VALUES
    by = blobs.withColumn("m", F.when(F.col("id") % 2 == 0, "shift").otherwise("lz4"))
    assert [r.x for r in by.select("id", codec.decode_by(codec.encode_by("b", "m"), "m").alias("x")).orderBy("id").collect()] == VALUES
    framed.register(spark)
    rows = blobs.select(F.col("id").cast("string").alias("key"), F.col("b").alias("data"))
    rows.write.format("framed").option("method", "shift").mode("append").save(str(tmp_path / "s"))
    assert {int(r.key): r.data for r in spark.read.format("framed").load(str(tmp_path / "s")).collect()} == dict(enumerate(VALUES))
    assert frames.range_read(frames.frame_table(blobs, "id", "b", 64, "shift"), "id", 60, 10, "shift").count() == sum(v is not None and len(v) > 60 for v in VALUES)
    catalog.register(catalog.wrapped("shift_zlib", "zlib", lambda b: turn(b, 7), lambda b: turn(b, -7)))
    there = blobs.select("id", codec.encode("b", "shift_zlib").alias("p"))
    assert [r.x for r in there.select("id", codec.decode("p", "shift_zlib").alias("x")).orderBy("id").collect()] == VALUES
    assert zlib.decompress(there.where("id = 3").first().p) == turn(VALUES[3], 7)


def test_option_objects():
    o = catalog.Options("zstd", {"zstd.level": 5})
    assert o.get("zstd.level", "int64") == 5 and o.get("zstd.checksum") is False
    copy = o.freeze().clone().set("zstd.level", 9)
    assert (o.get("zstd.level"), copy.get("zstd.level"), copy.given()) == (5, 9, {"zstd.level": 9})
    for wrong in (lambda: o.set("zstd.level", 1), lambda: copy.set("zstd.level", 99), lambda: copy.get("zstd.level", "bool"), lambda: copy.set("lz4.concat", True)):
        with pytest.raises(CodecError):
            wrong()


def test_memory_limits_hold():
    big = R.randbytes(1 << 20)
    packed = encode_bytes(big, "zstd", {"zstd.window_log": 20})
    assert decode_bytes(packed, "zstd", {"limits.max_memory_bytes": 1 << 20}) == big
    cases = [("zstd", packed, 1 << 18), ("xz", encode_bytes(big, "xz"), 1 << 20), ("lzma", encode_bytes(big, "lzma"), 1 << 20), ("bzip2", encode_bytes(big, "bzip2"), 1 << 20), ("gzip", encode_bytes(big, "gzip"), 1 << 14), ("lz4", encode_bytes(big, "lz4"), 1 << 20)]
    for method, data, most in cases:
        if "limits.max_memory_bytes" in {o.key for o in catalog.find(method).options}:
            with pytest.raises(CodecError) as e:
                decode_bytes(data, method, {"limits.max_memory_bytes": most})
            assert e.value.status == "LIMIT"


def test_detect_passes_over_any_number_of_skippable_frames(spark):
    skips = b"".join((0x184D2A50 + k % 16).to_bytes(4, "little") + len(x).to_bytes(4, "little") + x for k, x in enumerate([b"", b"note", b"x" * 300, b"", b"\0" * 9]))
    rows = [(n, bytearray(skips + encode_bytes(b"hello" * 50, n))) for n in ("zstd", "lz4", "gzip", "xz")] + [(None, bytearray(skips)), (None, bytearray(skips[:-3])), (None, bytearray(b""))]
    got = spark.createDataFrame(rows, "n string, b binary").select("n", codec.detect("b").alias("d"), codec.decode_detected("b").alias("x")).collect()
    assert all(r.n == r.d and r.x == (b"hello" * 50 if r.n else None) for r in got)


def test_running_sums(spark):
    pieces = [(g, i, None if i == 3 else bytearray(R.randbytes(R.randrange(3000)))) for g in (None, "a", "b") for i in range(9)]
    df = spark.createDataFrame(pieces, "g string, i long, b binary").repartition(3)
    whole = {g: b"".join(bytes(b) for k, _, b in pieces if k == g and b is not None) for g in (None, "a", "b")}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for kind, want in (("xxh32", kernels.xxh32), ("xxh64", lambda b: signed(kernels.xxh64(b))), ("crc32", zlib.crc32), ("adler32", zlib.adler32)):
        got = {r.g: (r.digest, r.length) for r in checksums.digest_parts(df, ["g"], ["i"], "b", kind).collect()}
        assert got == {g: (want(b), len(b)) for g, b in whole.items()}
    for kind in ("xxh32", "xxh64"):
        state = kernels.State(kind, 7)
        for k in range(0, 500, 13):
            state.update(whole["a"][k : k + 13])
        state.digest()
        state.update(b"more")
        assert state.digest() == getattr(kernels, kind)(whole["a"][:507][: k + 13] + b"more", 7) == kernels._xxh(whole["a"][: k + 13] + b"more", 7, int(kind[3:]))
        state.reset()
        assert state.digest() == getattr(kernels, kind)(b"", 7)
    with pytest.raises(CodecError):
        kernels.State("md5")
    first = df.withColumn("c", F.crc32("b")).withColumn("more", checksums.crc32_update("c", F.lit(b"tail"))).withColumn("a", checksums.adler32_update(F.lit(1), "b"))
    for r in first.collect():
        assert r.b is None and r.more is None or r.more == zlib.crc32(bytes(r.b) + b"tail")
        assert r.a == (1 if r.b is None else zlib.adler32(bytes(r.b)))


def test_checksum_columns(blobs):
    got = {r.id: r for r in blobs.select("id", checksums.adler32("b").alias("a"), checksums.xxh64("b").alias("x"), checksums.crc64("b").alias("c"), checksums.xxh64_seed42("b").alias("s")).collect()}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for i, v in enumerate(VALUES):
        if v is None:
            assert got[i].a is None and got[i].s is None
        else:
            assert (got[i].a, got[i].x, got[i].c, got[i].s) == (zlib.adler32(v), signed(kernels.xxh64(v)), signed(kernels.crc64(v)), signed(kernels.xxh64(v, 42)))


def test_combined_adler(spark):
    parts = [(g, i, R.randbytes(R.randrange(2000))) for g in "ab" for i in range(20)]
    df = spark.createDataFrame([(g, i, zlib.adler32(b), len(b)) for g, i, b in parts], "g string, i long, a long, n long")
    got = {r.g: (r.adler32, r.length) for r in checksums.combine_adler32(df, ["g"], "i", "a", "n").collect()}
    for g in "ab":
        whole = b"".join(b for k, _, b in parts if k == g)
        assert got[g] == (zlib.adler32(whole), len(whole))


def test_statistics(blobs):
    real = [v for v in VALUES if v is not None]
    assert {r.byte: r.n for r in analysis.byte_histogram(blobs, "b", []).collect()} == Counter(b for v in real for b in v)
    assert {(r.prev, r.cur): r.n for r in analysis.bigrams(blobs, "b", []).collect()} == Counter(p for v in real for p in zip(v, v[1:]))
    for d in (6, 8):
        want = Counter(v[i : i + d] for v in real for i in range(len(v) - d + 1))
        assert {bytes(r.dmer): r.n for r in analysis.dmer_counts(blobs, "b", d).collect()} == want


def test_range_reads_and_seek_tables(blobs):
    table = frames.frame_table(blobs, "id", "b", 256, "zstd").cache()
    for offset, length in ((0, 10), (250, 20), (300, 700), (2990, 100), (5000, 1)):
        got = {r.id: bytes(r.data) for r in frames.range_read(table, "id", offset, length).collect()}
        assert got == {i: v[offset : offset + length] for i, v in enumerate(VALUES) if v and len(v) > offset}
    tables = {r.id: bytes(r.seek_table) for r in frames.seek_table(table, "id").collect()}
    for r in table.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("frame_no", "frame"))).alias("f")).collect():
        whole = b"".join(bytes(x.frame) for x in r.f) + tables[r.id]
        assert sum(x[1] for x in zstds.read_seek_table(whole)) == len(VALUES[r.id])
        assert decode_bytes(whole, "zstd") == VALUES[r.id]


def test_partitioning_does_not_change_frames(blobs):
    a = frames.frame_table(blobs, "id", "b", 100).select("id", "frame_no", "frame").collect()
    b = frames.frame_table(blobs.repartition(5), "id", "b", 100).select("id", "frame_no", "frame").collect()
    assert sorted(a) == sorted(b)


def test_framed_source(spark, tmp_path):
    framed.register(spark)
    path = str(tmp_path / "f")
    rows = [(f"k{i}", bytearray(b"x" * i)) for i in range(30)] + [(None, None)]
    spark.createDataFrame(rows, "key string, data binary").repartition(3).write.format("framed").option("method", "lz4").mode("append").save(path)
    read = lambda: spark.read.format("framed").load(path)
    assert sorted(((r.key, None if r.data is None else bytes(r.data)) for r in read().collect()), key=str) == sorted([(k, None if d is None else bytes(d)) for k, d in rows], key=str)
    few = read().where("d_len >= 10 and key like 'k1%'")
    assert "Filter" not in few._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert sorted(r.key for r in few.collect()) == [f"k{i}" for i in range(10, 20)]
    spark.createDataFrame(rows[:2], "key string, data binary").write.format("framed").mode("append").save(path)
    assert read().count() == 33


def test_framed_source_prunes_chunks_by_the_manifest(spark, tmp_path):
    framed.register(spark)
    path = str(tmp_path / "c")
    rows = spark.range(100).selectExpr("format_string('k%03d', id) AS key", "cast(repeat('x', cast(id AS int)) AS binary) AS data").coalesce(1)
    rows.write.format("framed").option("chunk", 10).mode("append").save(path)
    read = lambda where: spark.read.format("framed").load(path).where(where)
    assert read("key like 'k04%'").rdd.getNumPartitions() == 1 and read("key like 'k04%'").count() == 10
    assert read("d_len >= 55 and d_len < 72").rdd.getNumPartitions() == 3 and read("d_len >= 55 and d_len < 72").count() == 17
    assert read("key = 'k017'").rdd.getNumPartitions() == 1 and [bytes(r.data) for r in read("key = 'k017'").collect()] == [b"x" * 17]
    assert read("key = 'none'").count() == 0 and read("true").rdd.getNumPartitions() == 10


def test_seekable_files(spark, tmp_path):
    path = str(tmp_path / "z")
    texts = {"a": R.randbytes(70_000), "b": b"", "c": b"abc" * 4000, "d": R.randbytes(4096)}
    rows = [(k, i, bytearray(v[at : at + 999])) for k, v in texts.items() for i, at in enumerate(range(0, max(1, len(v)), 999))] + [("c", 10**6, None)]
    df = spark.createDataFrame(rows, "path string, i long, data binary").repartition(3, "path").sortWithinPartitions("path", "i").drop("i")
    seekable.register(spark)
    df.write.format("seekable").option("frameSize", 4096).mode("append").save(path)
    for split in (1 << 20, 5000):
        got = seekable.load(spark, path, splitBytes=split).orderBy("path", "frame_no").collect()
        for k, v in texts.items():
            mine = [r for r in got if r.path == k]
            assert b"".join(bytes(r.data) for r in mine) == v and [r.d_off for r in mine] == list(range(0, len(v), 4096)) and [r.frame_no for r in mine] == list(range(len(mine)))
    few = seekable.load(spark, path, splitBytes=5000).where("d_off >= 8192 and path = 'a' and d_len = 4096").select("frame_no")
    assert "Filter" not in few._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert sorted(r.frame_no for r in few.collect()) == list(range(2, 17))
    for offset, length in ((0, 5), (4090, 20), (8192, 4096), (10_000, 10**6), (69_999, 3), (70_000, 1)):
        got = {r.path: bytes(r.data) for r in seekable.range_read(spark, path, offset, length).collect()}
        assert got == {k: v[offset : offset + length] for k, v in texts.items() if len(v) > offset}
    # Files that others wrote, with and without a table.
    import os

    import zstandard

    other = tmp_path / "other"
    os.makedirs(other)
    (other / "plain.zst").write_bytes(zstandard.compress(b"one" * 100) + zstandard.compress(b"two" * 50))
    (other / "seek.zst").write_bytes(encode_bytes(texts["c"], "zstd", {"zstd.seekable": True, "zstd.seekable_frame_size": 1024}))
    got = seekable.load(spark, str(other)).orderBy("path", "frame_no").collect()
    assert [bytes(r.data) for r in got if r.path.endswith("plain.zst")] == [b"one" * 100, b"two" * 50]
    assert b"".join(bytes(r.data) for r in got if r.path.endswith("seek.zst")) == texts["c"]
    whole = (other / "seek.zst").read_bytes()
    (other / "seek.zst").write_bytes(whole[:100] + bytes([whole[100] ^ 255]) + whole[101:])
    with pytest.raises(Exception, match="CORRUPT"):
        seekable.load(spark, str(other)).collect()


def test_files_are_decoded_by_what_tells_their_format(spark, tmp_path):
    for name, method in (("a.gz", "gzip"), ("b", "xz"), ("c.zst", "zstd"), ("d.bin", "lz4"), ("e.bz2", "bzip2"), ("f.lzma", "lzma")):
        (tmp_path / name).write_bytes(encode_bytes(name.encode() * 100, method))
    (tmp_path / "g.txt").write_bytes(b"as it is, for nothing tells a format")
    got = {r.path.rpartition("/")[2]: (r.method, bytes(r.data)) for r in files.read(spark, str(tmp_path)).collect()}
    assert got["g.txt"] == (None, b"as it is, for nothing tells a format")
    assert {k: v for k, v in got.items() if k != "g.txt"} == {n: (m, n.encode() * 100) for n, m in (("a.gz", "gzip"), ("b", "xz"), ("c.zst", "zstd"), ("d.bin", "lz4"), ("e.bz2", "bzip2"), ("f.lzma", "lzma"))}


def test_dictionary_helps(spark):
    lines = [f'{{"user": {R.randrange(10**6)}, "action": "purchase_completed", "currency": "EUR", "amount": {R.randrange(1000)}}}'.encode() for _ in range(400)]
    df = spark.createDataFrame([(bytearray(x),) for x in lines[:300]], "b binary")
    trained = dictionary.train(df, "b", 1024)
    plain = sum(len(encode_bytes(x, "zlib")) for x in lines[300:])
    assert 0 < len(trained) <= 1024 and sum(len(encode_bytes(x, "zlib", {"zlib.dictionary": trained})) for x in lines[300:]) < 0.8 * plain
    assert dictionary.train(df.limit(0), "b") == b""


def greedy_dictionary(values, capacity, segment, d):
    """The best segment of all again and again, scored by the repeated d-mers that are not covered."""
    counts = Counter(v[i : i + d] for v in values for i in range(len(v) - d + 1))
    counts = {k: n for k, n in counts.items() if n > 1}
    own = {s: {s[i : i + d] for i in range(len(s) - d + 1)} for v in values for s in (v[at : at + segment] for at in range(0, len(v), segment))}
    score = lambda s: sum(counts.get(x, 0) for x in own[s])
    left, out = sorted(own, key=lambda s: (-score(s), s)), b""
    while len(out) < capacity and (best := max(left, key=score)) and score(best):
        out = best[: capacity - len(out)] + out
        for x in own[best]:
            counts.pop(x, None)
    return out


@pytest.mark.parametrize("d", [6, 8])
def test_dictionary_keeps_content_behind_boilerplate(spark, d):
    r = random.Random(5)
    text = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    boilerplate, others = text(60), [text(64) for _ in range(6)]
    values = [boilerplate + text(4) for _ in range(300)] + [x for x in others for _ in range(3)]
    df = spark.createDataFrame([(bytearray(x),) for x in [*values, b"", b"abc"]] + [(None,)], "b binary").repartition(3)
    trained = dictionary.train(df, "b", 512, 64, d)
    assert all(x in trained for x in [boilerplate, *others])
    assert trained == greedy_dictionary(values, 512, 64, d)
    long = [text(150) * 2 + text(9) for _ in range(40)]
    df = spark.createDataFrame([(bytearray(x),) for x in long], "b binary")
    assert dictionary.train(df, "b", 1000, 64, d) == greedy_dictionary(long, 1000, 64, d)


def test_brute_force_of_unoracled_queries(spark):
    import __spark_entry__ as entry

    got = entry.queries()["checksums_documents"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.xxh32 == kernels.xxh32(texts[r.doc_id]) and r.bzip2_crc == kernels.bzip2_crc(texts[r.doc_id]) for r in got)
    assert entry.entry(spark).count() >= 1
    sizes = entry.queries()["dictionary_gain"](spark, "/root/testdata/sf0.001").first()
    assert sizes.dictionary_bytes < sizes.plain_bytes < sizes.raw_bytes


def test_sql_functions(spark, blobs):
    codec.register_functions(spark)
    frames.register_walks(spark)
    blobs.createOrReplaceTempView("blobs")
    got = spark.sql("SELECT id, decode_lz4(encode_lz4(b)) AS x FROM blobs ORDER BY id").collect()
    assert [r.x if r.x is None else bytes(r.x) for r in got] == VALUES
    walked = spark.sql("SELECT id, w.kind FROM (SELECT id, encode_zstd(b) AS z FROM blobs) t, LATERAL zstd_walk(t.z) w WHERE w.kind = 'frame'")
    assert walked.count() == len(VALUES) - 1


def test_move_to_front_and_burrows_wheeler(spark):
    words = ["banana", "a", "mississippi", "zz"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string")
    for r in df.select("w", analysis.move_to_front("w").alias("m")).collect():
        order, want = list(range(256)), []
        for b in r.w.encode():
            want.append(order.index(b))
            order.insert(0, order.pop(want[-1]))
        assert r.m == want
    for r in analysis.burrows_wheeler(df, "i", "w").collect():
        w = words[r.i]
        turns = sorted((w[k:] + w[:k], k) for k in range(len(w)))
        assert r.bwt == "".join(t[-1] for t, _ in turns) and turns[r.origin][1] == 0


def test_streaming_replay_gives_the_same_frames(spark, tmp_path):
    from octaframe.streaming import frames as streaming

    schema = "id long, k string, v string"
    for part in range(3):
        rows = [(part * 10 + i, "ab"[i % 2], f"m{part}-{i};") for i in range(6)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = streaming.encode_stream(stream, "k", ["id"], "v")
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start(str(tmp_path / name))
        q.awaitTermination()
        return sorted(spark.read.parquet(str(tmp_path / name)).collect())

    one, two = run("one"), run("two")
    assert one == two and len(one) == 6
    whole = b"".join(decode_bytes(bytes(r.frame), "zstd") for r in one if r.key == "a")
    assert zlib.crc32(whole) == [r.running_crc32 for r in one if r.key == "a"][-1] and len(whole) == sum(r.d_len for r in one if r.key == "a")


def run_stream(spark, tmp_path, rows, schema, make, name):
    """The result of make(stream) over one micro-batch for each list of rows."""
    import time

    place = tmp_path / f"{name}-in"
    for k, few in enumerate(rows):
        spark.createDataFrame(few, schema).coalesce(1).write.mode("append").parquet(str(place))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place))
    q = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start(str(tmp_path / name))
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / name)).collect()


@pytest.mark.parametrize("method", ["deflate", "zlib", "gzip"])
def test_sync_flush_finish_and_reset(spark, tmp_path, method):
    from octaframe.streaming import frames as streaming

    m = lambda n: bytearray(f"message {n} says the same as the others;".encode())
    rows = [[(1, "k", m(1), False, False), (2, "k", m(2), False, False)], [(3, "k", None, False, False), (4, "k", m(4), False, False)], [(5, "k", m(5), True, False), (6, "k", m(6), False, False)], [(7, "k", m(7), False, True), (8, "k", None, True, False)]]
    got = run_stream(spark, tmp_path, rows, "id long, k string, v binary, e boolean, r boolean", lambda s: streaming.encode_stream(s, "k", ["id"], "v", method, flush="sync", finish="e", reset="r"), method)
    pieces = [(r.frame_no, r.d_off, bytes(r.frame)) for r in sorted(got, key=lambda r: r.d_len)]
    bits = {"deflate": -15, "zlib": 15, "gzip": 31}[method]
    first = [bytes(r.frame) for r in sorted((r for r in got if r.frame_no < 3 and (r.frame_no, r.d_off) != (0, 0)), key=lambda r: r.frame_no)]
    starts = [bytes(r.frame) for r in got if r.frame_no == 0]
    assert len(pieces) == len(got) and len(starts) in (2, 3)
    done = []
    for s in starts:
        z = zlib.decompressobj(bits)
        out = z.decompress(s)  # decodable up to the flush
        rest = list(first)
        while rest and not z.eof:
            out += z.decompress(rest.pop(0))
        done.append((out, z.eof))
    want = bytes(m(1) + m(2) + m(4) + m(5))
    assert any(out == want and end for out, end in done)
    # A repeated message costs little: the window goes on over the flushes.
    assert min(len(f) for f in first) < 30
    with pytest.raises(CodecError):
        streaming.encode_stream(spark.range(1), "id", ["id"], "id", "lz4", flush="sync")


@pytest.mark.parametrize("method", ["gzip", "zstd", "lz4", "xz", "bzip2", "zlib", "deflate"])
def test_stream_decoder(spark, tmp_path, method):
    from octaframe.streaming import frames as streaming

    plain = [b"first frame " * 40, b"", b"second " * 9, R.randbytes(500)]
    whole = b"".join(encode_bytes(p, method) for p in plain)
    cuts = [0, 1, 5, len(whole) // 2, len(whole) - 3, len(whole)]
    rows = [[(k, "good", bytearray(whole[a:b]), False)] for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows[1].append((1, "null", None, False))
    rows[2] += [(2, "bad", bytearray(b"\xff\xfe\xfd\xfc\xfb\xfa\xf9\xf8" * 9), False), (2, "left", bytearray(whole[:6]), False)]
    rows[3] += [(3, "bad", bytearray(whole), False), (3, "left", bytearray(whole), True)]
    rows[4] += [(4, "bad", bytearray(whole), True)]
    got = run_stream(spark, tmp_path, rows, "n long, k string, v binary, r boolean", lambda s: streaming.decode_stream(s, "k", ["n"], "v", method, reset="r"), "d" + method)
    by = {k: sorted((r for r in got if r.key == k), key=lambda r: r.d_off) for k in ("good", "null", "bad", "left")}
    joined = lambda rs: b"".join(bytes(r.data) for r in rs if r.status == "OK" and r.data is not None)
    assert joined(by["good"]) == b"".join(plain) and sum(r.frames for r in by["good"]) == 4
    assert [r.d_off for r in by["good"]] == sorted({r.d_off for r in by["good"]}) and by["null"] == []
    assert [r.status for r in by["bad"] if r.status != "OK"] == ["CORRUPT"] and joined(by["bad"]) == b"".join(plain)
    assert joined(by["left"]) == b"".join(plain)


def test_windows_of_frames(spark):
    from octaframe.streaming import frames as streaming

    rows = [(k, k * 600, f"e{k};") for k in range(200)] + [(900, 400_000, "late;")]
    events = spark.createDataFrame(rows, "id long, s long, v string").selectExpr("id", "timestamp_seconds(s) AS ts", "v")
    tumbling = streaming.windowed_frames(events, "ts", "1 day", ["id"], "v").orderBy("start").collect()
    assert [r.messages for r in tumbling] == [144, 56, 1]
    assert decode_bytes(bytes(tumbling[0].frame), "zstd") == "".join(f"e{k};" for k in range(144)).encode()
    assert streaming.windowed_frames(events, "ts", "1 day", ["id"], "v", slide="12 hours").count() > 3
    assert sorted(r.messages for r in streaming.windowed_frames(events, "ts", "", ["id"], "v", gap="1 hour").collect()) == [1, 200]
    small = streaming.windowed_frames_bounded(events, "ts", "1 day", ["id"], "v", frame_bytes=100).orderBy("start", "frame_no").collect()
    assert max(r.bytes for r in small) <= 105 and sum(r.messages for r in small) == 201
    first = [r for r in small if r.start == small[0].start]
    assert b"".join(decode_bytes(bytes(r.frame), "zstd") for r in first) == "".join(f"e{k};" for k in range(144)).encode()
    assert [r.frame_no for r in first] == list(range(len(first)))


def test_limited_huffman_lengths():
    import heapq

    for n, most in ((2, 1), (5, 3), (40, 15), (256, 8), (200, 9)):
        counts = [R.randrange(1, 2 ** R.randrange(1, 20)) for _ in range(n)]
        got = analysis.limited_lengths(counts, most)
        assert max(got) <= most and sum(2.0**-x for x in got) == 1.0
        heap = list(counts)
        heapq.heapify(heap)
        best = 0
        while len(heap) > 1:
            heapq.heappush(heap, x := heapq.heappop(heap) + heapq.heappop(heap))
            best += x
        cost = sum(c * x for c, x in zip(counts, got))
        assert cost >= best
        free = analysis.limited_lengths(counts, 40) if n < 100 else None
        assert free is None or sum(c * x for c, x in zip(counts, free)) == best
    with pytest.raises(ValueError):
        analysis.limited_lengths([1, 1, 1], 1)


def test_finite_state_entropy():
    from octaframe.codecs import fse

    for n, log in ((1, 5), (2, 5), (7, 6), (200, 9), (256, 12)):
        counts = {s: R.randrange(1, 1 + 3 ** R.randrange(9)) for s in range(n)}
        norm = fse.normalised(counts, log)
        assert sum(norm.values()) == 1 << log and min(norm.values()) >= 1 and set(norm) == set(counts)
        assert Counter(fse.spread(norm, log)) == norm
        symbols = R.choices(list(counts), weights=list(counts.values()), k=500)
        first, bits = fse.encode(symbols, norm, log)
        assert fse.decode(first, bits, len(symbols), norm, log) == symbols
    skewed = fse.normalised({0: 10**6, **{s: 1 for s in range(1, 32)}}, 5)
    assert sum(skewed.values()) == 32 and min(skewed.values()) == 1
    with pytest.raises(CodecError):
        fse.normalised({s: 1 for s in range(33)}, 5)


def test_run_stage_of_bzip2():
    from octaframe.codecs import rle

    assert rle.rle1_encode(b"aaa") == b"aaa" and rle.rle1_encode(b"aaaa") == b"aaaa\0" and rle.rle1_encode(b"b" * 256) == b"bbbb\xfbb"
    for v in [x for x in VALUES if x is not None] + [b"\n" * 1000 + b"x" * 4 + b"\0" * 258]:
        assert rle.rle1_decode(rle.rle1_encode(v)) == v
    with pytest.raises(CodecError):
        rle.rle1_decode(b"zzzz")


def test_rle_round_trips_whatever_the_runs(spark, tmp_path):
    import duckdb

    from octaframe.plans import queries

    texts = [None, "", "a", "aab" * 2000, "aabbcée" * 900, "x" * 129 + "y" * 257 + "z", "abc" * 2000, "a" * 5000, "\n".join("ab" * i for i in range(100))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["roundtrip_rle"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLE_SQL["roundtrip_rle"]).fetchall())


def test_rle_takes_what_the_runs_make():
    from octaframe.codecs import rle

    assert rle.size(b"aab" * 2000) == 8000 and rle.size(b"a" * 129) == 4 and rle.size(b"ab" * 64) == 129 and rle.size(b"") == 0
    own = random.Random(5)
    values = [v for v in VALUES if v is not None] + [b"".join(bytes([own.randrange(3)]) * own.choice((1, 1, 2, 3, 127, 128, 129, 256, 257)) for _ in range(own.randrange(300))) for _ in range(50)]
    for v in values:
        for profile in ("packbits", "tga"):
            assert rle.size(v) == len(encode_bytes(v, "rle", {"rle.format": profile}))


def test_contexts_and_blocks(spark):
    import numpy as np

    kinds = np.array([[900, 100, 0, 0], [0, 0, 700, 300], [880, 120, 0, 0], [0, 0, 690, 310], [25, 25, 25, 25]])
    assert analysis.merged_contexts(kinds, 4, 50.0) == [0, 1, 0, 1, 4] and len(set(analysis.merged_contexts(kinds, 2, 0.0))) == 2

    def bits(rows):
        c = np.sum(rows, axis=0)
        return float(sum(x * np.log2(c.sum() / x) for x in c if x))

    def brute(rows, most, price):
        groups = [[i] for i in range(len(rows))]
        while len(groups) > 1:
            cost = [(bits(rows[a + b]) - bits(rows[a]) - bits(rows[b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
            c, x, y = min(cost, key=lambda t: (round(t[0], 6), t[1], t[2]))
            if len(groups) <= most and c >= price:
                break
            groups[x] += groups.pop(y)
        return [next(min(g) for g in groups if i in g) for i in range(len(rows))]

    rng = np.random.default_rng(4)
    for _ in range(10):
        rows = rng.integers(0, 60, (9, 5))
        assert analysis.merged_contexts(rows, 4, 15.0) == brute(rows, 4, 15.0)
    data = b"abab" * 2048 + bytes(range(200, 250)) * 102 + b"\xfa" * 20 + b"abab" * 1024
    starts = analysis.block_splits(data)
    assert starts == [0, 8192, 13312]
    assert analysis.block_splits(b"") == [] and analysis.block_splits(b"x" * 50_000) == [0]
    df = spark.createDataFrame([(1, bytearray(data)), (2, None)], "i long, b binary")
    assert {r.i: r.s for r in df.select("i", analysis.blocks_of("b").alias("s")).collect()} == {1: starts, 2: None}
    pairs = analysis.bigrams(df, "b", ["i"])
    got = analysis.context_clusters(pairs, ["i"], most=3).collect()
    assert {r.prev for r in got} == set(data) and len({r.cluster for r in got}) <= 3
