"""Incremental codecs as stateful streaming operators.

A stream of bytes is a key; its pieces arrive in micro-batches as rows (key, seq, data, last). The
state of a key is small and plain, so that it lives in Spark's state store and survives a lost
executor: compressors keep the last 32 KiB, the checksum and the length (a deflate stream goes on
from a flush with its window as dictionary); decompressors keep the window and the bytes since the
last flush. Other codecs end a frame at each micro-batch, as their frames may follow one another,
and decoders keep the bytes of a frame that is not complete. A budget bounds what a key may hold.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.codecs import lzh, lzw, registry

WINDOW = 32768
STATE = "window binary, pending binary, crc bigint, size bigint, stage int"
FLUSH = {"sync": zlib.Z_SYNC_FLUSH, "full": zlib.Z_FULL_FLUSH, "partial": zlib.Z_PARTIAL_FLUSH}
MARK = b"\0\0\xff\xff"
FRAMES = ("bzip2", "xz", "zstd", "lz4", "snappy")
#: Codecs whose streams cannot follow one another: each piece is a stream of its own, and rows keep them apart.
ROWS: dict[str, tuple] = {
    "brotli": (lambda b: registry.compress("brotli", b), lambda b: registry.decompress("brotli", b)),
    "lzw": (lambda b: lzw.compress(b, lzw.TIFF), lambda b: lzw.decompress(b, lzw.TIFF)),
    "lzh": (lambda b: len(b).to_bytes(8, "little") + lzh.encode(b, "lh5"), lambda b: lzh.decode(b[8:], "lh5", int.from_bytes(b[:8], "little"))),
}


class BudgetExceeded(MemoryError):
    """A key holds more bytes than its budget."""


def compress_step(state: tuple | None, data: bytes, last: bool, codec: str = "gzip", level: int = 6, flush: str = "sync") -> tuple[tuple, bytes]:
    """(next state, bytes to send) for one piece of a gzip, zlib or deflate stream."""
    window, _, crc, size, stage = state or (b"", b"", 1 if codec == "zlib" else 0, 0, 0)
    out = b""
    if stage == 0:
        out = {"gzip": b"\x1f\x8b\x08\0\0\0\0\0\0\xff", "zlib": b"\x78\x9c", "deflate": b""}[codec]
    c = zlib.compressobj(level, zlib.DEFLATED, -15, zdict=window) if window else zlib.compressobj(level, zlib.DEFLATED, -15)
    # a partial flush leaves bits pending inside the object, which goes away here: it is sent as a sync flush
    out += c.compress(data) + c.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH if flush == "full" else zlib.Z_SYNC_FLUSH)
    crc = zlib.adler32(data, crc) if codec == "zlib" else zlib.crc32(data, crc)
    size += len(data)
    if last and codec == "gzip":
        out += crc.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little")
    elif last and codec == "zlib":
        out += crc.to_bytes(4, "big")
    kept = b"" if flush == "full" else (window + data)[-WINDOW:]
    return (kept, b"", crc, size, 2 if last else 1), out


def _header(data: bytes, codec: str) -> int | None:
    """Length of the stream's header, None if more bytes are needed."""
    if codec == "deflate":
        return 0
    if codec == "zlib":
        return 2 if len(data) >= 2 else None
    if len(data) < 18:
        return None
    from quarry.containers.others import gzip_header

    try:
        return gzip_header(data)["at"]
    except (ValueError, IndexError):
        return None if data[:2] == b"\x1f\x8b" else 0


def decompress_step(state: tuple | None, data: bytes, codec: str = "gzip", budget: int = 64 << 20) -> tuple[tuple, bytes]:
    """(next state, plain bytes up to the last flush in the data)."""
    window, pending, crc, size, stage = state or (b"", b"", 1 if codec == "zlib" else 0, 0, 0)
    pending += data
    out = b""
    while pending:
        if stage == 0:
            at = _header(pending, codec)
            if at is None:
                break
            pending, stage, window = pending[at:], 1, b""
        d = zlib.decompressobj(-15, zdict=window) if window else zlib.decompressobj(-15)
        try:
            plain = d.decompress(pending)
        except zlib.error as error:
            raise registry.CodecError(str(error)) from None
        if d.eof:
            trailer = {"gzip": 8, "zlib": 4, "deflate": 0}[codec]
            if len(d.unused_data) < trailer:
                break
            out += plain
            crc = zlib.adler32(plain, crc) if codec == "zlib" else zlib.crc32(plain, crc)
            size += len(plain)
            if codec == "gzip" and d.unused_data[:8] != crc.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little") or codec == "zlib" and d.unused_data[:4] != crc.to_bytes(4, "big"):
                raise registry.CodecError("checksum mismatch")
            pending, stage, window, crc, size = d.unused_data[trailer:], 0, b"", 1 if codec == "zlib" else 0, 0
            continue
        cut = pending.rfind(MARK)
        if cut < 0:
            break
        d = zlib.decompressobj(-15, zdict=window) if window else zlib.decompressobj(-15)
        plain = d.decompress(pending[: cut + 4])
        out += plain
        crc = zlib.adler32(plain, crc) if codec == "zlib" else zlib.crc32(plain, crc)
        size += len(plain)
        window, pending = (window + plain)[-WINDOW:], pending[cut + 4 :]
        break
    if len(pending) > budget:
        raise BudgetExceeded(f"{len(pending)} bytes without a flush; the budget is {budget}")
    return (window, pending, crc, size, stage), out


def frame_step(state: tuple | None, data: bytes, codec: str, budget: int = 64 << 20) -> tuple[tuple, bytes]:
    """(next state, plain bytes of all complete frames); the bytes of a frame that is cut off wait."""
    _, pending, _, size, _ = state or (b"", b"", 0, 0, 0)
    out, pending = registry.complete_frames(codec, pending + data)
    if len(pending) > budget:
        raise BudgetExceeded(f"{len(pending)} bytes of an incomplete frame; the budget is {budget}")
    return (b"", pending, 0, size + len(out), 1), out


def lzma2_chunks(data: bytes) -> tuple[list[bytes], bytes]:
    """(runs of chunks that begin with a dictionary reset and are complete, what is left). The end mark ends
    the last run; a run is complete when the next one begins or the end mark is there."""
    runs, begin, at = [], 0, 0
    while at < len(data):
        control = data[at]
        if control == 0:
            runs.append(data[begin:at])
            return [r for r in runs if r], data[at + 1 :]
        if at > begin and (control == 1 or control >= 0xE0):
            runs.append(data[begin:at])
            begin = at
        if at + 6 > len(data) and control >= 0x80 or at + 3 > len(data):
            break
        if control >= 0x80:
            at += (6 if control >= 0xC0 else 5) + int.from_bytes(data[at + 3 : at + 5], "big") + 1
        elif control in (1, 2):
            at += 3 + int.from_bytes(data[at + 1 : at + 3], "big") + 1
        else:
            raise registry.CodecError(f"LZMA2 control byte {control:#x}")
    return [r for r in runs if r], data[begin:]


def lzma2_step(state: tuple | None, data: bytes, budget: int = 64 << 20) -> tuple[tuple, bytes]:
    """(next state, plain bytes of all complete runs of chunks)."""
    _, pending, _, size, _ = state or (b"", b"", 0, 0, 0)
    runs, pending = lzma2_chunks(pending + data)
    if len(pending) > budget:
        raise BudgetExceeded(f"{len(pending)} bytes of an incomplete chunk; the budget is {budget}")
    out = b"".join(registry.lzma2_decompress(r + b"\0") for r in runs)
    return (b"", pending, 0, size + len(out), 1), out


def _stateful(df: DataFrame, step, key: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        now = tuple(state.get) if state.exists else None
        out = []
        for seq, data, last in zip(rows["seq"], rows["data"], rows["last"], strict=True):
            now, piece = step(now, bytes(data) if data is not None else b"", bool(last))
            out.append((k[0], int(seq), piece))
            if last:
                now = None
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update(now)
        yield pd.DataFrame(out, columns=[key, "seq", "data"])

    return df.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, seq bigint, data binary", STATE, "append", GroupStateTimeout.NoTimeout)


def compress_stream(df: DataFrame, codec: str = "gzip", key: str = "key", level: int = 6, flush: str = "sync", budget: int = 16 << 20) -> DataFrame:
    """(key, seq, data) with the pieces compressed; joined in order they are one stream of the codec."""

    def step(state: tuple | None, data: bytes, last: bool) -> tuple[tuple, bytes]:
        if len(data) > budget:
            raise BudgetExceeded(f"a piece of {len(data)} bytes; the budget is {budget}")
        if codec in ROWS:
            return (b"", b"", 0, 0, 1), ROWS[codec][0](data)
        if codec == "lzma2":  # each piece resets the dictionary; the last one has the end mark
            return (b"", b"", 0, 0, 1), (registry.lzma2_compress(data, level)[:-1] if data else b"") + b"\0" * last
        if codec in FRAMES:
            return (b"", b"", 0, 0, 1), registry.compress(codec, data, level if codec in ("bzip2", "xz", "zstd") else None)
        return compress_step(state, data, last, codec, level, flush)

    return _stateful(df, step, key)


def decompress_stream(df: DataFrame, codec: str = "gzip", key: str = "key", budget: int = 64 << 20) -> DataFrame:
    """(key, seq, data) with what can be decoded so far; ``last`` with bytes left over is an error."""

    def step(state: tuple | None, data: bytes, last: bool) -> tuple[tuple, bytes]:
        if codec in ROWS:
            return (b"", b"", 0, 0, 1), ROWS[codec][1](data)
        after, out = frame_step(state, data, codec, budget) if codec in FRAMES else lzma2_step(state, data, budget) if codec == "lzma2" else decompress_step(state, data, codec, budget)
        if last and after[1]:
            raise registry.CodecError("the stream ends inside a frame")
        return after, out

    return _stateful(df, step, key)


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; in local mode, which has one
    machine, under /tmp where that is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(known or '/tmp/checkpoints').rstrip('/')}/stream-{uuid.uuid4().hex}"


def played(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives for all input that there is now, written to the shared folder and read back."""
    path = shared_dir(spark)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def path_of(frame: DataFrame) -> str:
    """The folder that holds a frame that played() gave."""
    return frame.inputFiles()[0].rsplit("/", 1)[0]
