import bz2
import gzip
import lzma
import random
import zlib

import pytest

from octaframe.catalog import IntArith, find, methods
from octaframe.codecs import checksums, filters, lz4, zstds
from octaframe.errors import CodecError
from octaframe.functions.codec import decode_bytes, encode_bytes

R = random.Random(12345)
WORDS = [b"alpha", b"beta", b"gamma", b"delta", b"omega", b"sigma", b"tau", b"rho"]


def shapes():
    yield "empty", b""
    for n in (1, 2, 3, 127, 128, 129, 130, 255, 257, 4096):
        yield f"runs {n}", b"Z" * n
    yield "text", b" ".join(R.choice(WORDS) for _ in range(3000))
    yield "noise", R.randbytes(5000)
    yield "ramp", bytes((i * 7 + i // 997) % 251 for i in range(9000))
    yield "mixed", b" ".join(R.choice(WORDS) for _ in range(400)) + b"Z" * 3000 + R.randbytes(700) + bytes([144] * 50)
    yield "far", (far := R.randbytes(3000)) + bytes(30000) + far
    yield "pairs", b"aabbccddeeffa" * 200


SHAPES = list(shapes())
VARIANTS = {
    "deflate": [{}, {"deflate.level": 0}, {"deflate.window_bits": 8}, {"deflate.window_bits": 9, "deflate.level": 9}, {"deflate.strategy": "fixed"}, {"deflate.dictionary": b"alpha beta gamma"}],
    "zlib": [{}, {"zlib.dictionary": b"alpha beta gamma"}, {"deflate.window_bits": 8}],
    "gzip": [{}, {"gzip.name": "a", "gzip.comment": "é", "gzip.extra": b"xy", "gzip.header_crc": True, "gzip.mtime": 9}],
    "bzip2": [{}, {"bzip2.level": 1}],
    "xz": [{}, {"xz.check": "sha256", "xz.block_size": 1000}, {"xz.filters": "delta:4,x86"}, {"xz.filters": "arm64", "xz.check": "crc32"}, {"xz.check": "none"}],
    "lzma": [{}, {"lzma.raw": True, "lzma.preset": 1}],
    "lz4": [{}, {"lz4.block_size": 65536, "lz4.independent_blocks": False, "lz4.block_checksum": True, "lz4.content_checksum": True}, {"lz4.dictionary": b"alpha beta gamma delta"}],
    "zstd": [{}, {"zstd.level": 19, "zstd.checksum": True}, {"zstd.seekable": True, "zstd.seekable_frame_size": 1024}, {"zstd.long": True, "zstd.window_log": 20}],
    "lzw": [{}, {"lzw.format": "tiff"}, {"lzw.max_code_bits": 9}],
    "rle": [{}, {"rle.format": "tga"}],
    "deflate64": [{}, {"deflate64.level": 0}],
    "reduce": [{"reduce.factor": f} for f in (1, 2, 3, 4)],
    "implode": [{}, {"implode.dictionary_size": 4096, "implode.literal_tree": False}],
    "delta": [{"delta.distance": d} for d in (1, 4, 256)],
    "bcj": [{"bcj.arch": a} for a in filters.ARCHS if a != "riscv"],
    "brotli": [{"brotli.lgwin": w} for w in (10, 16, 17, 22)],
}
CASES = [(m.name, o) for m in methods() for o in VARIANTS.get(m.name, [{}])]


@pytest.mark.parametrize(("method", "options"), CASES, ids=lambda x: str(x)[:60])
def test_round_trip_and_bound(method, options):
    m = find(method)
    for name, data in SHAPES:
        packed = encode_bytes(data, method, options)
        if m.bound:
            assert len(packed) <= m.bound(IntArith, len(data), m.validated(options)), name
        more = {f"{method}.uncompressed_size": len(data)} if method in ("reduce", "implode") and data else {}
        assert decode_bytes(packed, method, options | more | {"limits.max_output_bytes": 10**6}) == data, name


def test_against_the_library():
    for _, data in SHAPES:
        assert zlib.decompress(encode_bytes(data, "zlib")) == data
        assert gzip.decompress(encode_bytes(data, "gzip", {"gzip.name": "n"})) == data
        assert bz2.decompress(encode_bytes(data, "bzip2")) == data
        for o in ({"xz.block_size": 1000}, {"xz.filters": "delta:4,x86", "xz.block_size": 700}):
            assert lzma.decompress(encode_bytes(data, "xz", o)) == data
        assert decode_bytes(lzma.compress(data, lzma.FORMAT_ALONE), "lzma", {"limits.max_expansion_ratio": 0}) == data
        assert decode_bytes(gzip.compress(data) + b"rest", "gzip", {"limits.max_expansion_ratio": 0}) == data
        two = gzip.compress(data) + gzip.compress(data)
        assert decode_bytes(two, "gzip", {"gzip.concat": True, "limits.max_expansion_ratio": 0}) == data * 2


@pytest.mark.parametrize("method", ["zlib", "gzip", "bzip2", "xz", "zstd", "lz4", "lzw", "lzma2", "deflate64", "brotli", "deflate"])
def test_every_prefix_is_corrupt(method):
    packed = encode_bytes(SHAPES[13][1][:300], method)
    for n in range(len(packed)):
        with pytest.raises(CodecError) as e:
            decode_bytes(packed[:n], method)
        assert e.value.status in ("CORRUPT", "LIMIT")


def test_trailing_bytes():
    for method in ("bzip2", "xz"):
        with pytest.raises(CodecError):
            decode_bytes(encode_bytes(b"abc", method) + b"junk", method)
    assert decode_bytes(encode_bytes(b"abc", "xz") + bytes(8), "xz") == b"abc"
    for method in ("zlib", "deflate", "gzip"):
        assert decode_bytes(encode_bytes(b"abc", method) + b"junk", method) == b"abc"


def test_limits():
    bomb = zlib.compress(bytes(10**6))
    with pytest.raises(CodecError) as e:
        decode_bytes(bomb, "zlib", {"limits.max_output_bytes": 1000})
    assert e.value.status == "LIMIT"
    for m in ("deflate", "zstd", "lz4", "lzw", "rle", "bzip2", "xz"):
        packed = encode_bytes(bytes(50_000), m)
        with pytest.raises(CodecError) as e:
            decode_bytes(packed, m, {"limits.max_output_bytes": 100})
        assert e.value.status == "LIMIT", m
    with pytest.raises(CodecError):
        decode_bytes(encode_bytes(bytes(50_000), "rle"), "rle", {"limits.max_expansion_ratio": 2})


def test_options_are_validated():
    for m, o in (("deflate", {"deflate.level": 10}), ("deflate", {"x": 1}), ("rle", {"rle.format": "z"}), ("gzip", {"gzip.os": -1}), ("lz4", {"lz4.concat": "yes"})):
        with pytest.raises(CodecError) as e:
            find(m).validated(o)
        assert e.value.status == "INVALID_ARG"
    assert len(methods()) >= 18


def test_packbits_tokens():
    assert encode_bytes(b"abbbbc", "rle") == bytes([0, 97, 253, 98, 0, 99])
    assert encode_bytes(b"\x05" * 129 + b"a", "rle") == bytes([129, 5, 1, 5, 97])
    assert decode_bytes(bytes([128, 254, 7]), "rle") == b"\7\7\7"


def test_checksums():
    data = b"123456789"
    assert checksums.crc32(data) == 0xCBF43926 and checksums.crc64(data) == 0x995DC9BBDF1939FA and checksums.bzip2_crc(data) == 0xFC891918
    for n in (0, 1, 3, 4, 15, 16, 31, 32, 33, 100, 1000):
        x = R.randbytes(n)
        for seed in (0, 42):
            assert checksums._xxh(x, seed, 32) == checksums.xxh32(x, seed) and checksums._xxh(x, seed, 64) == checksums.xxh64(x, seed)
        y = R.randbytes(n + 5)
        assert checksums.adler32_combine(zlib.adler32(x), zlib.adler32(y), len(y)) == zlib.adler32(x + y)


def test_walks():
    data = SHAPES[13][1] * 3
    frame = encode_bytes(data, "lz4", {"lz4.block_size": 65536}) + lz4.skippable(b"note", 3)
    assert [e[0] for e in lz4.walk(frame)] == ["header", "block", "frame", "skippable"]
    z = encode_bytes(data, "zstd", {"zstd.seekable": True, "zstd.seekable_frame_size": 20_000})
    rows = zstds.read_seek_table(z)
    assert sum(r[1] for r in rows) == len(data) and [e[0] for e in zstds.walk(z)].count("frame") == len(rows)
    assert decode_bytes(lz4.skippable(b"x") + encode_bytes(b"abc", "lz4"), "lz4") == b"abc"


def test_without_the_native_library(monkeypatch):
    from octaframe.codecs import native

    packed = {m: encode_bytes(SHAPES[14][1], m) for m in ("lz4",)}
    monkeypatch.setattr(native, "has", lambda name: False)
    for _, data in SHAPES:
        for m, o in (("lz4", {}), ("lz4", {"lz4.content_checksum": True, "lz4.block_size": 65536}), ("brotli", {})):
            assert decode_bytes(encode_bytes(data, m, o), m, {"limits.max_expansion_ratio": 0}) == data
    assert decode_bytes(packed["lz4"], "lz4") == SHAPES[14][1]
    with pytest.raises(CodecError):
        decode_bytes(encode_bytes(b"abc" * 100, "lz4")[:-2], "lz4")


def test_stated_sizes_and_ids():
    for _, data in SHAPES:
        packed = encode_bytes(data, "lzma", {"lzma.uncompressed_size": len(data)})
        assert int.from_bytes(packed[5:13], "little") == len(data) and lzma.decompress(packed, lzma.FORMAT_ALONE) == data
        raw = encode_bytes(data, "lzma", {"lzma.raw": True})
        assert decode_bytes(raw, "lzma", {"lzma.raw": True, "lzma.uncompressed_size": len(data)}) == data
    with pytest.raises(CodecError):
        encode_bytes(b"abc", "lzma", {"lzma.uncompressed_size": 4})
    assert encode_bytes(b"abc", "gzip", {"gzip.header_flags": 1})[3] == 1


def test_seek_tables_that_lie():
    z = encode_bytes(b"abc" * 2000, "zstd", {"zstd.seekable": True, "zstd.seekable_frame_size": 1024})
    assert zstds.read_seek_table(z[:-1]) is None and zstds.read_seek_table(b"") is None
    for at, value in ((-5, 0x04), (-9, 0xFF)):
        bad = bytearray(z)
        bad[at] = value
        with pytest.raises(CodecError):
            zstds.read_seek_table(bytes(bad))


# Vectors from outside: streams that others published or that another decoder reads -----------------------------


def test_gif_stream_of_a_published_image():
    """The 10 by 10 sample image of a well-known description of GIF, with a minimum code size of 2."""
    packed = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    pixels = bytes(int(c) for c in "".join(rows))
    assert decode_bytes(packed, "lzw", {"lzw.format": "gif", "lzw.lit_width": 2}) == pixels
    assert encode_bytes(pixels, "lzw", {"lzw.format": "gif", "lzw.lit_width": 2}) == packed


def test_packbits_stream_of_a_published_note():
    packed = bytes.fromhex("feaa0280002afdaa0380002a22f7aa")
    plain = bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
    assert decode_bytes(packed, "rle") == plain and encode_bytes(plain, "rle") == packed


def test_tga_packets_of_the_format():
    assert decode_bytes(bytes.fromhex("8241" + "014243" + "ff00"), "rle", {"rle.format": "tga"}) == b"AAABC" + b"\0" * 128


def test_deflate64_blocks_are_read_by_another_decoder():
    """Without long matches and far distances a Deflate64 stream is a DEFLATE stream."""
    rng = random.Random(12)
    words = [bytes(rng.choice(b"etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    for n in (1, 5, 300, 5000):
        plain = b" ".join(rng.choice(words) for _ in range(n))
        packed = encode_bytes(plain, "deflate64")
        if len(plain) <= 32768:
            assert zlib.decompress(packed, -15) == plain
        assert decode_bytes(packed, "deflate64") == plain
        if n > 100:
            assert len(packed) < 1.15 * len(zlib.compress(plain)) and packed[0] >> 1 & 3 == 2
    noise = rng.randbytes(100_000)
    assert len(encode_bytes(noise, "deflate64")) <= len(noise) + 16
    # Another encoder's DEFLATE is Deflate64 too, as long as no match has 258 bytes.
    plain = b" ".join(rng.choice(words) for _ in range(3000))
    assert decode_bytes(zlib.compress(plain)[2:-4], "deflate64") == plain


def test_implode_codes_follow_the_counts():
    plain = b"the frequent letters take few bits and the others more of them; " * 4 + bytes(range(256))
    text = b" ".join(plain[k : k + 9] for k in range(0, 250)) * 3
    for options in ({}, {"implode.literal_tree": False}, {"implode.dictionary_size": 4096}):
        packed = encode_bytes(text, "implode", options)
        assert decode_bytes(packed, "implode", options | {"implode.uncompressed_size": len(text)}) == text
    assert len(encode_bytes(b"ab" * 50 + bytes(97 + k % 7 for k in range(2000)), "implode")) < 400


def test_prefix_codes_longer_than_the_quick_table():
    from octaframe.codecs.bits import LsbReader, LsbWriter, PrefixCode, canonical, reverse_bits

    lengths = list(range(1, 15)) + [15, 15]
    codes = canonical(lengths)
    for flip in (False, True):
        w, symbols = LsbWriter(), [k % 16 for k in range(100)]
        for s in symbols:
            c, n = codes[s]
            w.bits(reverse_bits(c ^ ((1 << n) - 1 if flip else 0), n), n)
        src, code = LsbReader(w.done()), PrefixCode(lengths, flip)
        assert [code.read(src) for _ in symbols] == symbols


def test_zstandard_without_its_package(monkeypatch):
    plain = [b"", b"a", b"text and more text; " * 500, random.Random(1).randbytes(3000)]
    before = [encode_bytes(p, "zstd") for p in plain]
    monkeypatch.setattr(zstds, "zstandard", None)
    for p, old in zip(plain, before):
        assert decode_bytes(old, "zstd") == p and decode_bytes(encode_bytes(p, "zstd", {"zstd.level": 7}), "zstd") == p
        seekable = encode_bytes(p, "zstd", {"zstd.seekable": True, "zstd.seekable_frame_size": 1024})
        assert decode_bytes(seekable + old, "zstd") == p + p
    with pytest.raises(CodecError) as e:
        decode_bytes(before[2], "zstd", {"limits.max_output_bytes": 100})
    assert e.value.status == "LIMIT"
    with pytest.raises(CodecError) as e:
        encode_bytes(b"x", "zstd", {"zstd.dictionary": b"some words"})
    assert e.value.status == "UNSUPPORTED"
