"""Streaming encoders and decoders whose state is plain data, so that replays make the same bytes.

An encoder cuts at every micro-batch.  With full flushes each piece is a frame
that decodes on its own, and the state of a key is numbers (next frame, bytes so
far, running CRC-32).  With sync flushes the pieces of a key are one DEFLATE
stream, decodable up to every piece; the state has the last 32 KiB as well,
which are all that a next piece may refer to, never the bits of a compressor.

A decoder takes the bytes of a key in pieces cut anywhere, gives out what
complete frames hold, and keeps the rest for the next micro-batch.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..catalog import find
from ..codecs import lz4, zstds
from ..errors import INVALID_ARG, LIMIT, OK, UNSUPPORTED, CodecError, corrupt
from ..functions.codec import decode_bytes, encode_bytes

FRAMES = "key string, frame_no long, d_off long, d_len long, running_crc32 long, frame binary"
STATE = "frame_no long, bytes long, crc long, adler long, open boolean, tail binary"
_NAMES = [x.split()[0] for x in FRAMES.split(", ")]
_START = (0, 0, 0, 1, False, b"")
#: Bytes that a piece of a DEFLATE stream may refer to.
_REACH = 32768


def _flag(c: str | None) -> Column:
    return F.coalesce(F.col(c), F.lit(False)).cast("boolean") if c else F.lit(False)


def _sync_piece(method: str, plain: bytes, state: tuple, level: int, last: bool) -> bytes:
    """The next piece of a stream: begun with a header, sync-flushed, ended with a final block and the trailer."""
    _, total, crc, adler, is_open, tail = state
    z = zlib.compressobj(level, zlib.DEFLATED, -15, zdict=tail) if tail else zlib.compressobj(level, zlib.DEFLATED, -15)
    out = b"" if is_open or method == "deflate" else {"zlib": b"\x78\x9c", "gzip": b"\x1f\x8b\x08\0\0\0\0\0\0\xff"}[method]
    out += z.compress(plain) + z.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)
    if last and method == "zlib":
        out += struct.pack(">I", adler)
    if last and method == "gzip":
        out += struct.pack("<II", crc, total & 0xFFFFFFFF)
    return out


def encode_stream(
    messages: DataFrame, key: str, order: list[str], data: str, method: str = "zstd", flush: str = "full", finish: str | None = None, reset: str | None = None, level: int = 6
) -> DataFrame:
    """Pieces of a stream: the messages of a key in a micro-batch, in order, make one.

    Returns key, frame_no, d_off, d_len, running_crc32 (of all bytes of the key
    so far) and frame.  ``flush`` "full": every piece is a frame of its own, and
    concatenating the decoded frames of a key gives its messages.  "sync" (for
    deflate, zlib and gzip): concatenating the pieces gives one stream; a
    message on which the column ``finish`` is true ends it after its data, and
    the next begins another.  A message on which the column ``reset`` is true
    starts its key anew before its data; what was begun is left unfinished.
    Null messages add nothing.
    """
    if flush not in ("full", "sync") or (flush == "sync" and method not in ("deflate", "zlib", "gzip")):
        raise CodecError(UNSUPPORTED if flush == "sync" else INVALID_ARG, f"{flush} flushes of {method}")
    codec = find(method)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        now = tuple(state.get) if state.exists else _START
        held, out = [], []

        def cut(last: bool) -> None:
            nonlocal now
            plain = b"".join(held)
            held.clear()
            if not plain and not (last and flush == "sync"):
                return
            no, total, crc, adler, is_open, tail = now
            tail = bytes(tail or b"")
            crc, adler = zlib.crc32(plain, crc), zlib.adler32(plain, adler)
            if flush == "full":
                piece = encode_bytes(plain, codec)
            else:
                piece = _sync_piece(method, plain, (no, total + len(plain), crc, adler, is_open, tail), level, last)
            out.append((k[0], no, total, len(plain), crc, piece))
            done = last and flush == "sync"
            after = (no + 1, total + len(plain), crc)
            now = (no + 1, 0, 0, 1, False, b"") if done else (*after, adler, True, (tail + plain)[-_REACH:] if flush == "sync" else b"")

        for b, ends, anew in zip(rows["_data"], rows["_finish"], rows["_reset"], strict=True):
            if anew:
                held.clear()
                now = _START
            if b is not None:
                held.append(bytes(b))
            if ends:
                cut(True)
        cut(False)
        state.update(now)
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    rows = messages.select(F.col(key).cast("string").alias("_key"), *order, F.col(data).cast("binary").alias("_data"), _flag(finish).alias("_finish"), _flag(reset).alias("_reset"))
    return rows.groupBy("_key").applyInPandasWithState(step, FRAMES, STATE, "append", GroupStateTimeout.NoTimeout)


def _ended(data: bytes, start) -> int | None:
    """Length of the first stream of data by a decompressor of the standard library; None if it is incomplete."""
    z = start()
    try:
        z.decompress(data)
    except (zlib.error, OSError, lzma.LZMAError) as e:
        raise corrupt(str(e)) from e
    return len(data) - len(z.unused_data) if z.eof else None


def _walked(data: bytes, module, magics: tuple[int, int]) -> int | None:
    """Length of the first frame, skippable ones among them; None if it is incomplete."""
    if len(data) < 5:
        return None
    magic = struct.unpack_from("<I", data)[0]
    if magic & 0xFFFFFFF0 != zstds.SKIPPABLE and magic not in magics:
        raise corrupt("no frame begins here")
    try:
        for kind, at, n, _, _ in module.walk(data):
            if kind in ("frame", "skippable"):
                return at + n
    except CodecError as e:
        if "truncated" in (e.detail or "") or "is cut" in (e.detail or ""):
            return None
        raise
    return None


#: Length of the first complete frame of the bytes at hand, by method.
BOUNDARIES = {
    "zlib": lambda b: _ended(b, zlib.decompressobj),
    "gzip": lambda b: _ended(b, lambda: zlib.decompressobj(31)),
    "deflate": lambda b: _ended(b, lambda: zlib.decompressobj(-15)),
    "bzip2": lambda b: _ended(b, bz2.BZ2Decompressor),
    "xz": lambda b: _ended(b, lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ)),
    "zstd": lambda b: _walked(b, zstds, (zstds.MAGIC, zstds.MAGIC)),
    "lz4": lambda b: _walked(b, lz4, (0x184D2204, 0x184D2204)),
}
DECODED = "key string, piece_no long, d_off long, frames long, status string, detail string, data binary"
DECODER = "piece_no long, bytes long, failed boolean, rest binary"


def decode_stream(pieces: DataFrame, key: str, order: list[str], data: str, method: str, reset: str | None = None, most_held: int = 256 << 20) -> DataFrame:
    """What the complete frames of a key hold that its pieces have brought so far, a row for each micro-batch that completes some.

    Returns key, piece_no, d_off, frames, status, detail and data.  Pieces may
    be cut anywhere; bytes of a frame that is not complete wait in the state, at
    most ``most_held`` of them.  A key whose bytes cannot be decoded gives a row
    with the status and no data, and is passed over from then on, until a piece
    on which the column ``reset`` is true starts it anew.  Null pieces add
    nothing.
    """
    if method not in BOUNDARIES:
        raise CodecError(UNSUPPORTED, f"{method} streams do not tell where they end")
    codec, first = find(method), BOUNDARIES[method]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        no, total, failed, rest = state.get if state.exists else (0, 0, False, b"")
        rest, out, plain, frames = bytearray(rest or b""), [], bytearray(), 0

        def give(status: str, detail: str | None) -> None:
            nonlocal no, total, frames, failed
            if frames or status != OK:
                out.append((k[0], no, total, frames, status, detail, bytes(plain) if frames else None))
                no, total = no + 1, total + len(plain)
            failed = status != OK
            plain.clear()
            frames = 0

        def take() -> None:
            """Decode all complete frames at hand."""
            nonlocal frames, failed
            try:
                while rest and (n := first(bytes(rest))) is not None:
                    plain.extend(decode_bytes(bytes(rest[:n]), codec))
                    frames += 1
                    del rest[:n]
                if len(rest) > most_held:
                    raise CodecError(LIMIT, f"more than {most_held} bytes of an incomplete frame")
            except CodecError as e:
                rest.clear()
                if frames:
                    give(OK, None)
                give(e.status, e.detail)

        for b, anew in zip(rows["_data"], rows["_reset"], strict=True):
            if anew:
                if not failed:
                    take()
                give(OK, None)
                rest.clear()
                no, total, failed = 0, 0, False
            if b is not None and not failed:
                rest += bytes(b)
        if not failed:
            take()
        if not failed:
            give(OK, None)
        state.update((no, total, failed, bytes(rest)))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in DECODED.split(", ")])

    rows = pieces.select(F.col(key).cast("string").alias("_key"), *order, F.col(data).cast("binary").alias("_data"), _flag(reset).alias("_reset"))
    return rows.groupBy("_key").applyInPandasWithState(step, DECODED, DECODER, "append", GroupStateTimeout.NoTimeout)


def windowed_frames(
    events: DataFrame, time: str, width: str, order: list[str], data: str, method: str = "zstd", late: str | None = None, slide: str | None = None, gap: str | None = None
) -> DataFrame:
    """One frame for each window of event time: start, messages, bytes, frame.

    Windows tumble, or begin every ``slide``; with ``gap`` they are sessions that
    end when nothing comes for so long (``width`` has no meaning then).  On a
    stream, ``late`` is how long windows stay open for late rows.
    """
    if late:
        events = events.withWatermark(time, late)
    window = F.session_window(time, gap) if gap else F.window(time, width, slide) if slide else F.window(time, width)
    codec = find(method)
    part = F.struct(*order, F.col(data).cast("binary").alias("_data"))
    cut = events.groupBy(window.alias("w")).agg(F.count("*").alias("messages"), F.array_sort(F.collect_list(part)).alias("_parts"))
    cut = cut.select(F.col("w.start").alias("start"), "messages", F.transform("_parts", lambda x: x["_data"]).alias("_parts"))

    @F.pandas_udf("bytes long, frame binary")
    def packed(parts: pd.Series) -> pd.DataFrame:
        plain = [b"".join(bytes(b) for b in p if b is not None) for p in parts]
        return pd.DataFrame({"bytes": [len(b) for b in plain], "frame": [encode_bytes(b, codec) for b in plain]})

    return cut.select("start", "messages", packed("_parts").alias("_f")).select("start", "messages", F.col("_f.bytes").alias("bytes"), F.col("_f.frame").alias("frame"))


def windowed_frames_bounded(events: DataFrame, time: str, width: str, order: list[str], data: str, method: str = "zstd", frame_bytes: int = 4 << 20) -> DataFrame:
    """Frames of at most about ``frame_bytes`` within each tumbling window of a table: start, frame_no, messages, bytes, frame.

    A window of any size is cut by a running sum of lengths within ranges of its
    rows, so that none is gathered in one row.  Frames of a window follow one
    another in the order of its rows.  ``order`` must tell rows apart.
    """
    from pyspark.sql import Window

    spark, codec = events.sparkSession, find(method)
    rows = events.select(F.window(time, width)["start"].alias("_start"), *order, F.col(data).cast("binary").alias("_data"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "_start", *order).withColumn("_part", F.spark_partition_id())
    sums = F.sum(F.coalesce(F.octet_length("_data"), F.lit(0)).cast("long")).over(Window.partitionBy("_part", "_start").orderBy(*order))
    cut = rows.withColumn("_cut", F.floor((sums - 1) / frame_bytes))

    def step(t):
        import pyarrow as pa

        t = t.sort_by([(c, "ascending") for c in order])
        plain = b"".join(b for b in t["_data"].to_pylist() if b is not None)
        return pa.table(
            {
                "start": t["_start"].slice(0, 1), "_part": t["_part"].slice(0, 1), "_cut": t["_cut"].slice(0, 1),
                "messages": pa.array([t.num_rows], pa.int64()), "bytes": pa.array([len(plain)], pa.int64()), "frame": pa.array([encode_bytes(plain, codec)], pa.binary()),
            }
        )

    kind = dict(cut.dtypes)["_start"]
    made = cut.groupBy("_start", "_part", "_cut").applyInArrow(step, f"start {kind}, _part int, _cut long, messages long, bytes long, frame binary")
    number = F.row_number().over(Window.partitionBy("start").orderBy("_part", "_cut")) - 1
    return made.select("start", number.cast("long").alias("frame_no"), "messages", "bytes", "frame")
