"""Catalog of methods and their options, and the registry that codecs are looked up in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .codecs import blocksort, brotli, deflates, filters, lz4, lzmas, lzw, rle, zip_legacy, zstds
from .errors import INVALID_ARG, UNSUPPORTED, CodecError

U32, MIB = (1 << 32) - 1, 1 << 20


@dataclass(frozen=True)
class Option:
    """Keys, kinds, defaults and ranges below are fixed values: the interface of the methods."""

    key: str
    kind: str  # int64, uint64, bool, string, bytes
    default: object = None
    least: int | None = None
    most: int | None = None
    allowed: tuple[str, ...] = ()

    def checked(self, value):
        """value in the option's type, or an INVALID_ARG error."""
        kinds = {"int64": int, "uint64": int, "bool": bool, "string": str, "bytes": (bytes, bytearray)}
        if self.kind == "bool" and value in (0, 1):
            value = bool(value)
        if not isinstance(value, kinds[self.kind]) or (isinstance(value, bool) and self.kind != "bool"):
            raise CodecError(INVALID_ARG, f"{self.key} is of type {self.kind}")
        if self.kind == "uint64" and value < 0:
            raise CodecError(INVALID_ARG, f"{self.key} is not negative")
        if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
            raise CodecError(INVALID_ARG, f"{self.key} is from {self.least} to {self.most}")
        if self.allowed and value not in self.allowed:
            raise CodecError(INVALID_ARG, f"{self.key} is one of {', '.join(self.allowed)}")
        return bytes(value) if self.kind == "bytes" else value


@dataclass(frozen=True)
class Method:
    """A codec: pure functions of bytes and validated options."""

    name: str
    spec: str
    encode: Callable[[bytes, dict], bytes]
    decode: Callable[[bytes, dict], bytes]
    options: tuple[Option, ...] = ()
    bound: Callable | None = None  # (n, options) -> n; works on ints and on Columns through `arith`
    peek: Callable[[bytes], dict] | None = None
    magic: bytes | None = None
    flush: str = "none"  # none, sync, full
    inner: tuple[str, ...] = field(default=())
    memory: Callable[[bytes], int] | None = None  # what decoding takes besides input and output

    def validated(self, given: dict | None) -> dict:
        """All options of the method with the given values; unknown keys and bad values are refused."""
        known = {o.key: o for o in self.options}
        out = {k: o.default for k, o in known.items()}
        for key, value in (given or {}).items():
            if key not in known:
                raise CodecError(INVALID_ARG, f"{self.name} has no option {key}")
            out[key] = known[key].checked(value)
        return out


def _limits(ratio: int, output: int = 0, memory: int = 0, window: int | None = None) -> tuple[Option, ...]:
    out = [
        Option("limits.max_output_bytes", "uint64", output),
        Option("limits.max_memory_bytes", "uint64", memory),
        Option("limits.max_expansion_ratio", "uint64", ratio),
    ]
    return tuple(out + ([Option("limits.max_window_bytes", "uint64", window)] if window is not None else []))


_THREADS = (Option("threads.count", "uint64", 1, 0),)
_DEFLATE = (
    Option("deflate.level", "int64", 6, 0, 9),
    Option("deflate.window_bits", "uint64", 15, 8, 15),
    Option("deflate.dictionary", "bytes"),
    Option("deflate.strategy", "string", "default", allowed=("default", "lazy", "huffman_only", "rle", "fixed")),
)
_BIG, _MEM = 512 * MIB, 256 * MIB


def _lz(prefix: str, lc: int, raw: bool = False) -> tuple[Option, ...]:
    out = [
        Option(f"{prefix}.preset", "int64", 6, 0, 9),
        Option(f"{prefix}.lc", "int64", 3, 0, lc),
        Option(f"{prefix}.lp", "int64", 0, 0, 4),
        Option(f"{prefix}.pb", "int64", 2, 0, 4),
    ]
    if prefix == "xz":
        return (*out, Option("xz.dict_size", "uint64", 0))
    return (*out, Option(f"{prefix}.dict_size", "uint64", 1 << 23, 4096, U32))


# Header facts --------------------------------------------------------------------------------------------


def _info(header: int, **more) -> dict:
    return {"header_size": header, "content_size": None, "window_size": None, "checksum": None, "dictionary_id": None, "block_size": None} | more


def _peek_zlib(data: bytes) -> dict:
    from .errors import corrupt

    if len(data) < 2 or data[0] & 15 != 8 or data[0] >> 4 > 7 or (data[0] << 8 | data[1]) % 31:
        raise corrupt("not a zlib header")
    named = data[1] >> 5 & 1
    return _info(2 + 4 * named, window_size=1 << (data[0] >> 4) + 8, checksum=True, dictionary_id=int.from_bytes(data[2:6], "big") if named else None)


def _peek_gzip(data: bytes) -> dict:
    return _info(deflates.gzip_fields(data)["body"], window_size=32768, checksum=True)


def _peek_bzip2(data: bytes) -> dict:
    from .errors import corrupt

    if len(data) < 4 or data[:3] != b"BZh" or not 49 <= data[3] <= 57:
        raise corrupt("not a bzip2 header")
    return _info(4, block_size=(data[3] - 48) * 100_000, checksum=True)


def _peek_xz(data: bytes) -> dict:
    from .errors import corrupt

    if len(data) < 12 or data[:6] != b"\xfd7zXZ\0":
        raise corrupt("not an xz header")
    return _info(12, checksum=data[7] & 15 != 0)


def _peek_lzma(data: bytes) -> dict:
    from .errors import corrupt

    if len(data) < 13 or data[0] >= 225:
        raise corrupt("not an LZMA header")
    size = int.from_bytes(data[5:13], "little")
    return _info(13, window_size=int.from_bytes(data[1:5], "little"), content_size=None if size == (1 << 64) - 1 else size)


def _peek_brotli(data: bytes) -> dict:
    from .codecs.bits import LsbReader

    return _info(1, window_size=(1 << brotli.window_bits(LsbReader(data))) - 16)


def _peek_lz4(data: bytes) -> dict:
    from .errors import corrupt

    if data[:4] != b"\x04\x22\x4d\x18":
        raise corrupt("not an LZ4 frame")
    i = lz4.frame_info(data)
    return _info(i["header_size"], content_size=i["content_size"], checksum=i["content_checksum"], dictionary_id=i["dictionary_id"], block_size=i["block_size"])


def _peek_zstd(data: bytes) -> dict:
    i = zstds.frame_header(data)
    return _info(i["header_size"], content_size=i["content_size"], window_size=i["window_size"], checksum=i["checksum"], dictionary_id=i["dictionary_id"])


def _peek_nothing(data: bytes) -> dict:
    return _info(0)


# Working memory of decoders, from the header: the window, or the block and its tables -----------------------


def _window(peek: Callable[[bytes], dict], per_block: int = 1):
    def memory(data: bytes) -> int:
        try:
            facts = peek(data)
        except CodecError:
            return 0  # the decoder will say what is wrong
        return facts["window_size"] or (facts["block_size"] or 0) * per_block

    return memory


def _xz_memory(data: bytes) -> int:
    """The dictionary of the first block's LZMA2 filter."""
    if len(data) < 24 or not data[12]:
        return 0
    at = 14 + sum(1 for bit in (6, 7) if data[13] >> bit & 1)
    head = data[at : 12 + 4 * (data[12] + 1)]
    k = head.find(b"\x21\x01")
    code = head[k + 2] & 63 if k >= 0 and k + 2 < len(head) else 0
    return (2 | code & 1) << (code // 2 + 11) if code < 40 else U32


# Bounds: arithmetic that holds for ints and, with the operations of `a`, for Columns ----------------------


class IntArith:
    div = staticmethod(lambda x, y: x // y)
    max1 = staticmethod(lambda x: max(1, x))
    zero = staticmethod(lambda n, other: 0 if n == 0 else other)

    @classmethod
    def blocks(cls, n, b):
        return cls.max1(cls.div(n + (b - 1), b))


def _bound_deflate(a, n, o):
    wb = o.get("deflate.window_bits", 15)
    m = min(65535, max(8, max(4096, 1 << (wb if 8 <= wb <= 15 else 15)) // 16))
    return n + 5 * (a.blocks(n, m) + 1)


def _bound_zlib(a, n, o):
    return _bound_deflate(a, n, o) + 6 + (4 if o["zlib.dictionary"] else 0)


def _bound_gzip(a, n, o):
    head = sum(len(o[k]) + 1 for k in ("gzip.name", "gzip.comment") if o[k]) + (len(o["gzip.extra"]) + 2 if o["gzip.extra"] else 0)
    return _bound_deflate(a, n, o) + 18 + head + 2 * bool(o["gzip.header_crc"])


def _bound_xz(a, n, o):
    size = o["xz.block_size"]
    pieces = a.blocks(n, size) if size else 1
    return n + 44 + 6 * a.blocks(n, 16384) + a.zero(n, 155 * pieces)


def _bound_lz4(a, n, o):
    return n + 19 + a.blocks(n, o["lz4.block_size"]) * (8 if o["lz4.block_checksum"] else 4) + (8 if o["lz4.content_checksum"] else 4)


def _bound_zstd(a, n, o):
    log, seek = o["zstd.window_log"] or zstds.window_log(o["zstd.level"]), o["zstd.seekable"]
    frames = a.blocks(n, o["zstd.seekable_frame_size"]) if seek else 1
    out = n + 18 * frames + 3 * (a.blocks(n, min(131072, 1 << log)) + 1 + (frames if seek else 0))
    out = out + (4 * frames if o["zstd.checksum"] else 0)
    return out + (frames * (12 if o["zstd.seekable_checksum"] else 8) + 17 if seek else 0)


def _bound_lzw(a, n, o):
    top, lit = o["lzw.max_code_bits"], o["lzw.lit_width"] if o["lzw.lit_width"] is not None else 8
    span = max(1, (1 << top) - ((1 << lit) + 2))
    return a.div((n + 3 + a.div(n, span)) * top + 7, 8) + 1


# The methods with the keys, ranges and defaults of their options.
_METHODS = [
    Method("deflate", "RFC 1951", deflates.deflate_encode, deflates.deflate_decode, (*_DEFLATE, *_limits(1032, _BIG, _MEM, 32768)), _bound_deflate, _peek_nothing, flush="sync"),
    Method("zlib", "RFC 1950", deflates.zlib_encode, deflates.zlib_decode, (Option("zlib.dictionary", "bytes"), *_DEFLATE, *_limits(1032, _BIG, _MEM)), _bound_zlib, _peek_zlib, flush="sync", inner=("deflate",)),
    Method(
        "gzip", "RFC 1952", deflates.gzip_encode, deflates.gzip_decode,
        (
            Option("gzip.mtime", "uint64", 0, 0, U32), Option("gzip.os", "uint64", 255, 0, 255), Option("gzip.name", "string"), Option("gzip.comment", "string"),
            Option("gzip.extra", "bytes"), Option("gzip.header_crc", "bool", False), Option("gzip.text", "bool", False), Option("gzip.xfl", "uint64", None, 0, 255),
            Option("gzip.header_flags", "uint64", None, 0, 255), Option("gzip.concat", "bool", False), Option("gzip.max_name_bytes", "uint64", MIB, 1),
            Option("gzip.max_comment_bytes", "uint64", MIB, 1), Option("gzip.max_extra_bytes", "uint64", 65536, 1), *_DEFLATE, *_limits(1032, _BIG, _MEM),
        ),
        _bound_gzip, _peek_gzip, b"\x1f\x8b", "sync", ("deflate",),
    ),
    Method("deflate64", "ZIP method 9", deflates.deflate64_encode, deflates.deflate64_decode, (Option("deflate64.level", "int64", 6, 0, 9), *_limits(29128)), lambda a, n, o: n + 8 * a.blocks(n, 32768) + 32),
    Method("brotli", "RFC 7932", brotli.encode, brotli.decode, (Option("brotli.lgwin", "int64", 16, 10, 24), Option("brotli.level", "int64", 1, 0, 5), *_limits(1290556, window=1 << 24)), lambda a, n, o: a.zero(n, n + 3 * a.blocks(n, 65536) + 1) + 2, _peek_brotli),
    Method("bzip2", "bzip2", blocksort.encode, blocksort.decode, (Option("bzip2.level", "int64", 9, 1, 9), *_limits(2500000), *_THREADS), lambda a, n, o: n + a.div(n, 50) + 1024, _peek_bzip2, b"BZh", "full"),
    Method(
        "xz", "xz container", lzmas.xz_encode, lzmas.xz_decode,
        (*_lz("xz", 4), Option("xz.check", "string", "crc64", allowed=tuple(lzmas.CHECKS)), Option("xz.block_size", "uint64", 0), Option("xz.filters", "string", ""), *_limits(8192, window=3 << 29), *_THREADS),
        _bound_xz, _peek_xz, b"\xfd7zXZ\0", "full",
    ),
    Method(
        "lzma", "LZMA alone or raw", lzmas.lzma_encode, lzmas.lzma_decode,
        (Option("lzma.raw", "bool", False), *_lz("lzma", 8), Option("lzma.uncompressed_size", "uint64", (1 << 64) - 1), *_limits(8192, window=3 << 29)), None, _peek_lzma,
    ),
    Method("lzma2", "LZMA2 chunks", lzmas.lzma2_encode, lzmas.lzma2_decode, (*_lz("lzma2", 4), *_limits(8192, window=3 << 29)), lambda a, n, o: n + 6 * a.blocks(n, 16384) + 64, flush="sync"),
    Method(
        "lz4", "LZ4 frame", lz4.encode, lz4.decode,
        (
            Option("lz4.block_size", "uint64", 4 * MIB, 65536, 4 * MIB), Option("lz4.block_checksum", "bool", False), Option("lz4.content_checksum", "bool", False),
            Option("lz4.independent_blocks", "bool", True), Option("lz4.concat", "bool", False), Option("lz4.dictionary", "bytes"), Option("lz4.dictionary_id", "uint64", None, 0, U32),
            Option("lz4.content_size", "uint64"), Option("limits.max_block_bytes", "uint64", 4 * MIB), *_limits(255, _BIG, _MEM), *_THREADS,
        ),
        _bound_lz4, _peek_lz4, b"\x04\x22\x4d\x18", "full",
    ),
    Method(
        "zstd", "RFC 8878", zstds.encode, zstds.decode,
        (
            Option("zstd.level", "int64", 3, 0, 22), Option("zstd.checksum", "bool", False), Option("zstd.seekable", "bool", False), Option("zstd.seekable_frame_size", "uint64", MIB, 1024, (1 << 31) - 1),
            Option("zstd.seekable_checksum", "bool", True), Option("zstd.long", "bool", False), Option("zstd.ldm_min_match", "uint64", 64, 16, 4096), Option("zstd.ldm_hash_log", "uint64", 0, 0, 30),
            Option("zstd.ldm_hash_rate_log", "uint64", 6, 0, 12), Option("zstd.window_log", "uint64", 0, 0, 31), Option("zstd.content_size", "uint64"), Option("zstd.concat", "bool", True),
            Option("zstd.dictionary", "bytes"), Option("zstd.dictionary_id", "uint64"), Option("zstd.job_size", "uint64", 0, 0, 16 * MIB), *_limits(32768, _BIG, _MEM, 1 << 27), *_THREADS,
        ),
        _bound_zstd, _peek_zstd, b"\x28\xb5\x2f\xfd", "full",
    ),
    Method(
        "lzw", "GIF and TIFF", lzw.encode, lzw.decode,
        (Option("lzw.format", "string", "gif", allowed=("gif", "tiff")), Option("lzw.lit_width", "uint64"), Option("lzw.max_code_bits", "uint64", 12, 9, 12), Option("lzw.encoder_lookup", "string", "hash", allowed=("linear", "hash")), *_limits(2560)),
        _bound_lzw, _peek_nothing, flush="full",
    ),
    Method("rle", "PackBits and TGA", rle.encode, rle.decode, (Option("rle.format", "string", "packbits", allowed=("packbits", "tga")), *_limits(64)), lambda a, n, o: a.zero(n, n + a.blocks(n, 3) + 1), _peek_nothing, flush="sync"),
    Method("shrink", "ZIP method 1", zip_legacy.shrink_encode, zip_legacy.shrink_decode, _limits(7282), lambda a, n, o: 2 * n + 16),
    Method("reduce", "ZIP methods 2 to 5", zip_legacy.reduce_encode, zip_legacy.reduce_decode, (Option("reduce.factor", "int64", 4, 1, 4), Option("reduce.uncompressed_size", "uint64", 0), *_limits(1024)), lambda a, n, o: 5 * n + 9000),
    Method("implode", "ZIP method 6", zip_legacy.implode_encode, zip_legacy.implode_decode, (Option("implode.dictionary_size", "uint64", 8192), Option("implode.literal_tree", "bool", True), Option("implode.uncompressed_size", "uint64", 0), *_limits(152)), lambda a, n, o: 3 * n + 1024),
    Method("delta", "xz filter 3", filters.delta_encode, filters.delta_decode, (Option("delta.distance", "int64", 1, 1, 256), Option("limits.max_output_bytes", "uint64", 0)), lambda a, n, o: n, flush="sync"),
    Method("bcj", "xz filters 4 to 11", filters.bcj_encode, filters.bcj_decode, (Option("bcj.arch", "string", "x86", allowed=tuple(filters.ARCHS)), Option("bcj.start_offset", "uint64", 0, 0, U32), Option("limits.max_output_bytes", "uint64", 0)), lambda a, n, o: n),
]

_MEMORY = {
    "deflate": lambda data: 1 << 15, "zlib": _window(_peek_zlib), "gzip": lambda data: 1 << 15, "deflate64": lambda data: 1 << 16, "brotli": _window(_peek_brotli),
    "bzip2": _window(_peek_bzip2, 4), "xz": _xz_memory, "lzma": _window(_peek_lzma), "lz4": _window(_peek_lz4), "zstd": _window(_peek_zstd),
}
_REGISTRY: dict[str, Method] = {m.name: replace(m, memory=_MEMORY.get(m.name)) for m in _METHODS}


def register(method: Method) -> None:
    """Add a method of one's own; a second one of the same name is ignored.

    Columns made afterwards take the method along to the executors.  Its
    functions must be picklable; those of a module are looked up there again.
    """
    _REGISTRY.setdefault(method.name, method)


def wrapped(name: str, inner: str, before: Callable[[bytes], bytes], after: Callable[[bytes], bytes], spec: str = "") -> Method:
    """A method that puts ``before`` in front of another one's encoder, and ``after`` behind its decoder."""
    m = find(inner)
    return Method(
        name, spec or f"{name} over {inner}", lambda b, o: m.encode(before(b), o), lambda b, o: after(m.decode(b, o)), m.options, None, None, None, "none", (inner,), m.memory
    )


class Options:
    """Options of a method as an object: set and read by type, cloned, and frozen against changes."""

    def __init__(self, method: str, given: dict | None = None):
        self.method, self.frozen = method, False
        self._known = {o.key: o for o in find(method).options}
        self._values: dict = {}
        for k, v in (given or {}).items():
            self.set(k, v)

    def _option(self, key: str) -> Option:
        if key not in self._known:
            raise CodecError(INVALID_ARG, f"{self.method} has no option {key}")
        return self._known[key]

    def set(self, key: str, value) -> Options:
        if self.frozen:
            raise CodecError(INVALID_ARG, "the options are frozen")
        self._values[key] = self._option(key).checked(value)
        return self

    def get(self, key: str, kind: str | None = None):
        """The value, or the default; ``kind`` asks for a type."""
        o = self._option(key)
        if kind is not None and o.kind != kind:
            raise CodecError(INVALID_ARG, f"{key} is of type {o.kind}")
        return self._values.get(key, o.default)

    def freeze(self) -> Options:
        self.frozen = True
        return self

    def clone(self) -> Options:
        """A copy that can be changed."""
        return Options(self.method, self._values)

    def given(self) -> dict:
        """What was set, as the argument ``options`` of the column functions."""
        return dict(self._values)


def find(name: str) -> Method:
    if name not in _REGISTRY:
        raise CodecError(UNSUPPORTED, f"no method {name}")
    return _REGISTRY[name]


def methods() -> list[Method]:
    return sorted(_REGISTRY.values(), key=lambda m: m.name)


def inner_options(wrapper: str, inner: str, given: dict) -> dict:
    """Of the given options of a wrapper, those that the inner method declares."""
    known = {o.key for o in find(inner).options}
    return {k: v for k, v in given.items() if k in known and k in {o.key for o in find(wrapper).options}}


def codec_methods(spark: SparkSession) -> DataFrame:
    """A row for each method: name, spec, whether it has a bound and header facts, its flush mode."""
    rows = [(m.name, m.spec, m.bound is not None, m.peek is not None, m.flush) for m in methods()]
    return spark.createDataFrame(rows, "method string, spec string, has_bound boolean, has_peek boolean, flush string")


def codec_options(spark: SparkSession) -> DataFrame:
    """A row for each option of each method."""
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    rows = [(m.name, o.key, o.kind, text(o.default), text(o.least), text(o.most), list(o.allowed)) for m in methods() for o in m.options]
    return spark.createDataFrame(rows, "method string, key string, kind string, default_value string, least string, most string, allowed array<string>")
