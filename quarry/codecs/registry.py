"""One registry of byte codecs: name -> (compress, decompress), over library kernels where they
exist and the kernels of this package elsewhere. Compressed bytes differ between encoders and
versions; only what decompresses is a contract."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import pyarrow as pa
import zstandard

from quarry.codecs import lz4, snappy


class CodecError(ValueError):
    """The bytes are not what the codec can read, or a limit was hit."""


class LimitExceeded(CodecError):
    """More bytes would come out than the limit; no more than that were made."""


def deflate(data: bytes, level: int = 6, dictionary: bytes = b"") -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15, zdict=dictionary) if dictionary else zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def inflate(data: bytes, dictionary: bytes = b"", limit: int = 0) -> bytes:
    return inflate_consumed(data, dictionary, limit)[0]


def inflate_consumed(data: bytes, dictionary: bytes = b"", limit: int = 0) -> tuple[bytes, int]:
    """(bytes, how many input bytes the stream took)."""
    d = zlib.decompressobj(-15, zdict=dictionary) if dictionary else zlib.decompressobj(-15)
    out = d.decompress(data, limit)
    if not limit:
        out += d.flush()
    if not d.eof:
        raise CodecError("deflate stream is not complete" if not d.unconsumed_tail else "output limit exceeded")
    return out, len(data) - len(d.unused_data)


def gzip_compress(data: bytes, level: int = 6, name: str = "", mtime: int = 0) -> bytes:
    extra = 4 if level <= 1 else 2 if level >= 9 else 0
    head = b"\x1f\x8b\x08" + bytes([8 if name else 0]) + mtime.to_bytes(4, "little") + bytes([extra, 255])
    return head + (name.encode() + b"\0" if name else b"") + deflate(data, level) + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def gzip_decompress(data: bytes) -> bytes:
    """All members, one after the other; anything after them that is no member ends the data."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        if not d.eof:
            raise CodecError("gzip member is not complete")
        data = d.unused_data
    if not out:
        raise CodecError("not a gzip stream")
    return b"".join(out)


def zlib_compress(data: bytes, level: int = 6, dictionary: bytes = b"") -> bytes:
    c = zlib.compressobj(level, zdict=dictionary) if dictionary else zlib.compressobj(level)
    return c.compress(data) + c.flush()


def zlib_decompress(data: bytes, dictionary: bytes = b"") -> bytes:
    d = zlib.decompressobj(zdict=dictionary) if dictionary else zlib.decompressobj()
    out = d.decompress(data) + d.flush()
    if not d.eof:
        raise CodecError("zlib stream is not complete")
    return out


#: Dictionary bits of the LZMA presets 0 to 9.
_LZMA_BITS = (18, 20, 21, 22, 22, 23, 23, 24, 25, 26)


def _lzma_filters(kind: int, level: int, size: int, dict_size: int | None = None) -> list[dict]:
    """The preset with a dictionary that holds ``size`` bytes, if its own is larger: an encoder's tables
    grow with the dictionary (94 MB at preset 6) and are made anew for every value."""
    level = min(9, level)
    fitted = min(1 << _LZMA_BITS[level], 1 << max(12, (size - 1).bit_length()))
    return [{"id": kind, "preset": level, "dict_size": max(4096, dict_size or fitted)}]


def lzma_raw(data: bytes, level: int = 6, dict_size: int | None = None) -> bytes:
    return lzma.compress(data, lzma.FORMAT_RAW, filters=_lzma_filters(lzma.FILTER_LZMA1, level, len(data), dict_size))


def lzma_alone(data: bytes, level: int = 6) -> bytes:
    return lzma.compress(data, lzma.FORMAT_ALONE, filters=_lzma_filters(lzma.FILTER_LZMA1, level, len(data)))


def lzma_raw_props(data: bytes, props: int, dict_size: int, size: int | None = None) -> bytes:
    """Raw LZMA of known properties byte and dictionary size; size bounds the output."""
    spec = {"id": lzma.FILTER_LZMA1, "lc": props % 9, "lp": props // 9 % 5, "pb": props // 45, "dict_size": max(4096, dict_size)}
    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[spec])
    out = d.decompress(data, -1 if size is None else size)
    if size is not None and len(out) < size:
        raise CodecError("LZMA stream is not complete")
    return out


def lzma2_compress(data: bytes, level: int = 6, dict_size: int | None = None) -> bytes:
    return lzma.compress(data, lzma.FORMAT_RAW, filters=_lzma_filters(lzma.FILTER_LZMA2, level, len(data), dict_size))


def lzma2_decompress(data: bytes, dict_size: int = 64 << 20) -> bytes:
    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": dict_size}])
    out = d.decompress(data)
    if not d.eof:
        raise CodecError("LZMA2 stream is not complete")
    return out


XZ_CHECKS = {"none": lzma.CHECK_NONE, "crc32": lzma.CHECK_CRC32, "crc64": lzma.CHECK_CRC64, "sha256": lzma.CHECK_SHA256}


def xz_compress(data: bytes, level: int = 6, check: str = "crc64") -> bytes:
    return lzma.compress(data, lzma.FORMAT_XZ, check=XZ_CHECKS[check], filters=_lzma_filters(lzma.FILTER_LZMA2, level, len(data)))


def zstd_compress(data: bytes, level: int = 3, dictionary: bytes = b"") -> bytes:
    """A frame with its checksum. Only this library has levels, dictionary and checksum: there is no other way."""
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(level=max(1, min(22, level)), write_checksum=True, dict_data=raw).compress(data)


def zstd_decompress(data: bytes, dictionary: bytes = b"") -> bytes:
    """All frames; skippable ones drop out, and anything that is no frame ends the data."""
    out, given = [], data
    while len(data) >= 4:
        magic = int.from_bytes(data[:4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            data = data[8 + int.from_bytes(data[4:8], "little") :]
            continue
        if magic != 0xFD2FB528:
            break
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        d = zstandard.ZstdDecompressor(dict_data=raw).decompressobj()
        out.append(d.decompress(data))
        if not d.eof:
            raise CodecError("zstd frame is not complete")
        data = d.unused_data
    if data is given:
        raise CodecError("not a zstd stream")
    return b"".join(out)


def _arrow_stream(data: bytes, codec: str) -> bytes:
    with pa.CompressedInputStream(pa.BufferReader(data), codec) as s:
        return s.read()


def brotli_compress(data: bytes, quality: int = 6) -> bytes:
    return pa.Codec("brotli", compression_level=min(11, max(0, quality))).compress(data, asbytes=True)


def lz4_frame(data: bytes, level: int = 1) -> bytes:
    return pa.compress(data, "lz4", asbytes=True)


def lz4_block(data: bytes, level: int = 1) -> bytes:
    return pa.compress(data, "lz4_raw", asbytes=True)


def lz4_unblock(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="lz4_raw", asbytes=True)


def bzip2_decompress(data: bytes) -> bytes:
    return bz2.decompress(data)


def complete_frames(codec: str, data: bytes) -> tuple[bytes, bytes]:
    """(plain bytes of the complete frames in front, what is left). Damage is an error; a frame that
    is only cut off is what is left."""
    out = []
    while data:
        if codec == "snappy":
            if len(data) < 4 or len(data) < 4 + int.from_bytes(data[1:4], "little"):
                break
            used = 4 + int.from_bytes(data[1:4], "little")
            chunk, data = data[:used], data[used:]
            out.append(b"" if chunk[0] == 0xFF else snappy.unframe(snappy.STREAM_ID + chunk))
            continue
        if codec == "lz4":
            try:
                plain, used = lz4.one_frame(data)
            except lz4.Truncated:
                break
            out.append(plain)
            data = data[used:]
            continue
        if codec == "zstd":
            magic = int.from_bytes(data[:4], "little")
            if len(data) < 8:
                break
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                used = 8 + int.from_bytes(data[4:8], "little")
                if len(data) < used:
                    break
                data = data[used:]
                continue
            d = zstandard.ZstdDecompressor().decompressobj()
        else:
            d = bz2.BZ2Decompressor() if codec == "bzip2" else lzma.LZMADecompressor(lzma.FORMAT_XZ)
        try:
            plain = d.decompress(data)
        except Exception as error:  # each library has its own
            raise CodecError(str(error)) from None
        if not d.eof:
            break
        out.append(plain)
        data = d.unused_data
    return b"".join(out), data


Compress = Callable[[bytes, int], bytes]
Decompress = Callable[[bytes], bytes]

CODECS: dict[str, tuple[Compress, Decompress]] = {
    "deflate": (deflate, inflate),
    "zlib": (zlib_compress, zlib_decompress),
    "gzip": (gzip_compress, gzip_decompress),
    "lzma": (lzma_alone, lambda b: lzma.decompress(b, lzma.FORMAT_ALONE)),
    "lzma2": (lzma2_compress, lzma2_decompress),
    "xz": (xz_compress, lambda b: lzma.decompress(b, lzma.FORMAT_XZ)),
    "bzip2": (lambda b, level=9: bz2.compress(b, min(9, max(1, level))), bzip2_decompress),
    "zstd": (zstd_compress, zstd_decompress),
    "lz4": (lz4_frame, lambda b: _arrow_stream(b, "lz4")),
    "brotli": (brotli_compress, lambda b: _arrow_stream(b, "brotli")),
    "snappy": (lambda b, level=0: snappy.frame(b), snappy.unframe),
    "snappy_raw": (lambda b, level=0: snappy.compress(b), snappy.decompress),
    "stored": (lambda b, level=0: b, lambda b: b),
}
BY_FORMAT = {"GZIP": "gzip", "XZ": "xz", "Bzip2": "bzip2", "Zstandard": "zstd", "LZ4": "lz4", "Brotli": "brotli", "Snappy": "snappy"}


def compress(codec: str, data: bytes, level: int | None = None) -> bytes:
    f = CODECS[codec][0]
    return f(data) if level is None else f(data, level)


def _drained(make: Callable, data: bytes, limit: int, magic: bytes | None) -> bytes:
    """Streams one after the other (those that begin with magic; one without it), up to limit bytes."""
    out, left = [], limit
    while True:
        d = make()
        piece = d.decompress(data, left + 1)
        if len(piece) > left:
            raise LimitExceeded(f"more than {limit} bytes")
        if not d.eof:
            raise CodecError("the stream is not complete")
        out.append(piece)
        left -= len(piece)
        data = d.unused_data
        if magic is None or not data.startswith(magic):
            return b"".join(out)


def bounded(codec: str, data: bytes, limit: int) -> bytes:
    """Decompresses, but never to more than limit bytes: LimitExceeded comes before they are made."""
    raw2 = [{"id": lzma.FILTER_LZMA2, "dict_size": 64 << 20}]
    streams = {
        "deflate": (lambda: zlib.decompressobj(-15), None),
        "zlib": (lambda: zlib.decompressobj(), None),
        "gzip": (lambda: zlib.decompressobj(31), b"\x1f\x8b"),
        "bzip2": (bz2.BZ2Decompressor, b"BZh"),
        "lzma": (lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE), None),
        "lzma2": (lambda: lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=raw2), None),
        "xz": (lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), b"\xfd7zXZ"),
    }
    if codec in streams:
        return _drained(streams[codec][0], data, limit, streams[codec][1])
    if codec in ("lz4", "brotli"):
        with pa.CompressedInputStream(pa.BufferReader(data), codec) as s:
            out = s.read(limit + 1)
    elif codec == "zstd":
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as s:
            out = s.read(limit + 1)
        out = out if len(out) > limit else zstd_decompress(data)  # which says whether the last frame is whole
    else:
        stated = snappy.stated_length(data) if codec == "snappy" else snappy.read_varint(data)[0] if codec == "snappy_raw" else len(data)
        if stated > limit:
            raise LimitExceeded(f"more than {limit} bytes")
        out = CODECS[codec][1](data)
    if len(out) > limit:
        raise LimitExceeded(f"more than {limit} bytes")
    return out


def decompress(codec: str, data: bytes, max_ratio: float | None = None, limit: int | None = None) -> bytes:
    """max_ratio, limit: an error for output that is larger than that many times the input, or than that many
    bytes, before more than that is made."""
    most = min([x for x in (limit, None if max_ratio is None else int(max_ratio * max(1, len(data)))) if x is not None], default=None)
    return CODECS[codec][1](data) if most is None else bounded(codec, data, most)
