"""Column functions over binary values: encode, decode, their trying forms, detect, peek, encode_bound and limits.

Methods are looked up when a column is made, on the driver, and travel to the
executors with it, so that a method of one's own works like any other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Method, find, methods
from ..errors import INTERNAL, LIMIT, OK, UNSUPPORTED, CodecError


def encode_bytes(data: bytes, method: str | Method, options: dict | None = None) -> bytes:
    m = method if isinstance(method, Method) else find(method)
    return m.encode(bytes(data), m.validated(options))


def decode_bytes(data: bytes, method: str | Method, options: dict | None = None) -> bytes:
    """Decode within the limits of the options; output in the wrong proportion to the input is refused."""
    m = method if isinstance(method, Method) else find(method)
    return _decoded(m, bytes(data), m.validated(options))


def _decoded(m: Method, data: bytes, o: dict) -> bytes:
    ratio, most, memory = (o.get(f"limits.max_{x}") or 0 for x in ("expansion_ratio", "output_bytes", "memory_bytes"))
    if ratio and data:  # no need to produce more than the ratio allows
        room = ratio * len(data)
        o = o | {"limits.max_output_bytes": min(most, room) if most else room}
    if memory and m.memory is not None and (asked := m.memory(data)) > memory:
        raise CodecError(LIMIT, f"decoding takes {asked} bytes of memory")
    return m.decode(data, o)


def _resolved(method: str, options: dict) -> tuple[Method, dict]:
    """The method itself and all its options, for a function that goes to the executors."""
    m = find(method)
    return m, m.validated(options)


def _binary(c: Column | str) -> Column:
    """Strings as their UTF-8 bytes."""
    return (F.col(c) if isinstance(c, str) else c).cast("binary")


def encode(c: Column | str, method: str, **options) -> Column:
    """Bytes of c encoded; options by their catalog keys, with dots as ``__`` or through a dict ``options``."""
    m, o = _resolved(method, _keys(options))

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else m.encode(bytes(b), o))

    return run(_binary(c))


def decode(c: Column | str, method: str, size: Column | str | None = None, **options) -> Column:
    """Bytes of c decoded; a value that cannot be decoded fails the query (see try_decode).

    size: the plain size of each value, for methods that have an option
    ``<method>.uncompressed_size`` because their streams do not tell where they end.
    """
    m, o = _resolved(method, _keys(options))
    if size is None:

        @F.pandas_udf("binary")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda b: None if b is None else _decoded(m, bytes(b), o))

        return run(_binary(c))
    key = f"{method}.uncompressed_size"
    if key not in o:
        raise CodecError("INVALID_ARG", f"{method} has no option {key}")

    @F.pandas_udf("binary")
    def sized(s: pd.Series, sizes: pd.Series) -> pd.Series:
        one = lambda b, n: None if b is None or pd.isna(n) else _decoded(m, bytes(b), o | {key: int(n)}) if n else b""
        return pd.Series([one(b, n) for b, n in zip(s, sizes, strict=True)], dtype=object)

    return sized(_binary(c), (F.col(size) if isinstance(size, str) else size).cast("long"))


TRIED = "status string, detail string, value binary"


def _trying(c: Column | str, one) -> Column:
    def attempt(b: bytes) -> tuple:
        try:
            return OK, None, one(bytes(b))
        except CodecError as e:
            return e.status, e.detail, None
        except Exception as e:  # noqa: BLE001  a defect of the codec is a status too
            return INTERNAL, repr(e)[:200], None

    @F.pandas_udf(TRIED)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if b is None else attempt(b) for b in s]
        return pd.DataFrame(rows, columns=["status", "detail", "value"])

    return F.when(_binary(c).isNotNull(), run(_binary(c)))


def try_decode(c: Column | str, method: str, **options) -> Column:
    """A struct of status, detail and value for each value; null for null."""
    m, o = _resolved(method, _keys(options))
    return _trying(c, lambda b: _decoded(m, b, o))


def try_encode(c: Column | str, method: str, **options) -> Column:
    """A struct of status, detail and value for each value; null for null."""
    m, o = _resolved(method, _keys(options))
    return _trying(c, lambda b: m.encode(b, o))


def _by_method(c: Column | str, method: Column | str, options: dict | None, step) -> Column:
    known = {m.name: (m, m.validated((options or {}).get(m.name))) for m in methods()}

    @F.pandas_udf("binary")
    def run(s: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for b, name in zip(s, names, strict=True):
            if b is not None and name is not None and name not in known:
                raise CodecError(UNSUPPORTED, f"no method {name}")
            out.append(None if b is None or name is None else step(known[name][0], bytes(b), known[name][1]))
        return pd.Series(out, dtype=object)

    return run(_binary(c), F.col(method) if isinstance(method, str) else method)


def encode_by(c: Column | str, method: Column | str, options: dict | None = None) -> Column:
    """Bytes of c encoded by the method that a column names; options: those of each method."""
    return _by_method(c, method, options, lambda m, b, o: m.encode(b, o))


def decode_by(c: Column | str, method: Column | str, options: dict | None = None) -> Column:
    """Bytes of c decoded by the method that a column names; null where it names none."""
    return _by_method(c, method, options, _decoded)


def decode_detected(c: Column | str, options: dict | None = None) -> Column:
    """Bytes of c decoded by the method that detect names; null where it names none.

    Skippable frames in front of a stream of another format than their own are
    taken off.
    """
    c = _binary(c)
    name = detect(c)
    plain = F.when(name.isin("zstd", "lz4"), c).otherwise(F.substring(c, _after_skips(c), F.octet_length(c)))
    return decode_by(plain, name, options)


def _keys(options: dict) -> dict:
    given = dict(options.pop("options", None) or {})
    return given | {k.replace("__", "."): v for k, v in options.items()}


def zlib_header(c: Column) -> Column:
    """Whether the first two bytes are those of a zlib stream."""
    b = lambda i: F.conv(F.hex(F.substring(c, i, 1)), 16, 10).cast("int")
    return (F.octet_length(c) >= 2) & (b(1) % 16 == 8) & (b(1) < 128) & ((b(1) * 256 + b(2)) % 31 == 0)


def _little(c: Column, at: Column) -> Column:
    """The little-endian 32-bit number at a (1-based) position of binary c."""
    h = lambda k: F.hex(F.substring(c, at + k, 1))
    return F.conv(F.concat(h(3), h(2), h(1), h(0)), 16, 10).cast("long")


def _after_skips(c: Column) -> Column:
    """The (1-based) position after all skippable frames at the start of c."""
    word = lambda at: _little(c, at)
    skips = lambda at: F.coalesce((word(at) >= 0x184D2A50) & (word(at) <= 0x184D2A5F), F.lit(False))
    step = lambda at, _: F.when(skips(at), F.least(at + 8 + word(at + 4), F.octet_length(c).cast("long") + 1)).otherwise(at)
    most = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.octet_length(c) / 8).cast("int")))
    # Only values that begin with such a frame are walked.
    return F.when(skips(F.lit(1)), F.aggregate(most, F.lit(1).cast("long"), step)).otherwise(F.lit(1).cast("long")).cast("int")


def detect(c: Column | str) -> Column:
    """Name of the method that the magic number tells, or null; skippable frames are passed over, however many.

    Built-in expressions alone.  Values of fewer than four bytes are not told.
    """
    c = _binary(c)
    rest = F.substring(c, _after_skips(c), F.lit(16))
    starts = lambda magic: F.substring(rest, 1, len(magic)) == F.lit(magic)
    case = F.when(F.octet_length(rest) < 4, None)
    for name in ("zstd", "lz4", "gzip", "bzip2", "xz"):
        case = case.when(starts(find(name).magic), name)
    return case.when(zlib_header(rest), "zlib")


PEEKED = "header_size long, content_size long, window_size long, checksum boolean, dictionary_id long, block_size long"


def peek(c: Column | str, method: str) -> Column:
    """Facts of the header, a struct with nulls for what it does not tell; null if there is no such header."""
    m = find(method)
    if m.peek is None:
        raise CodecError("UNSUPPORTED", f"{method} has no header to look at")
    names = [x.split()[0] for x in PEEKED.split(", ")]

    def one(b: bytes | None) -> dict:
        try:
            return {} if b is None else {k: v for k, v in m.peek(bytes(b)).items() if k in names} | {"_ok": True}
        except CodecError:
            return {}

    @F.pandas_udf(PEEKED + ", _ok boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in s], columns=[*names, "_ok"]).astype(object)

    got = run(_binary(c))
    return F.when(got["_ok"], F.struct(*(got[n].alias(n) for n in names)))


class ColumnArith:
    """The operations of bounds on Columns."""

    div = staticmethod(lambda x, y: F.floor(x / y).cast("long"))
    max1 = staticmethod(lambda x: F.greatest(F.lit(1).cast("long"), x))

    @staticmethod
    def zero(n, other):
        return F.when(n == 0, 0).otherwise(other)

    @classmethod
    def blocks(cls, n, b):
        return cls.max1(cls.div(n + (b - 1), b))


def encode_bound(n: Column | str, method: str, **options) -> Column:
    """Most bytes that n bytes can take; null for methods without a bound.  Built-in arithmetic."""
    m = find(method)
    o = m.validated(_keys(options))
    n = (F.col(n) if isinstance(n, str) else n).cast("long")
    return F.lit(None).cast("long") if m.bound is None else F.lit(0).cast("long") + m.bound(ColumnArith, n, o)


def within_output(n: Column, limit: int) -> Column:
    return F.lit(True) if not limit else n <= limit


def within_ratio(inputs: Column, outputs: Column, ratio: int) -> Column:
    """Whether outputs is at most ratio times inputs; empty inputs and a ratio of 0 always are."""
    return F.lit(True) if not ratio else (inputs == 0) | (outputs <= inputs.cast("decimal(38,0)") * ratio)


def _sql_function(fn, method: Method):
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else fn(b, method))

    return run


def register_functions(spark) -> None:
    """SQL functions encode_<method> and decode_<method> with default options."""
    for m in methods():
        spark.udf.register(f"encode_{m.name}", _sql_function(encode_bytes, m))
        spark.udf.register(f"decode_{m.name}", _sql_function(decode_bytes, m))


__all__ = [
    "decode", "decode_by", "decode_bytes", "decode_detected", "detect", "encode", "encode_bound", "encode_by", "encode_bytes", "peek", "register_functions",
    "try_decode", "try_encode", "within_output", "within_ratio", "zlib_header",
]
