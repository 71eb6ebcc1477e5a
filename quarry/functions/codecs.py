"""Codecs, checksums and crypto as vectorised columns (Arrow UDFs over the kernels).

Null stays null. A value that cannot be decoded raises, or is null with ``strict=False``.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.codecs import checksums, crypto, lz4, lzh, registry, snappy, szip, transforms


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on the session's Arrow batches end at that many bytes, too: a batch of 10,000 texts is as
    large as the texts are, and a Python worker holds it with what comes of it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _map(f: Callable[[bytes], object], kind: pa.DataType, strict: bool = True) -> Callable[[pa.Array], pa.Array]:
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in (x.as_py() for x in values):  # one at a time: a list of them would be a second copy of the batch
            if v is None:
                out.append(None)
                continue
            try:
                out.append(f(v))
            except Exception:
                if strict:
                    raise
                out.append(None)
        return pa.array(out, kind)

    return run


def _binary(col: Column, f: Callable[[bytes], bytes], strict: bool = True) -> Column:
    run = _map(f, pa.binary(), strict)

    @arrow_udf("binary")
    def u(v: pa.Array) -> pa.Array:
        return run(v)

    return u(col.cast("binary"))


def _binary_many(col: Column, f: Callable[[list[bytes]], list[bytes]]) -> Column:
    """As _binary, for kernels that take the values of a batch at once."""

    @arrow_udf("binary")
    def u(v: pa.Array) -> pa.Array:
        made = iter(f(v.drop_null().to_pylist()))
        return pa.array([next(made) if known else None for known in v.is_valid().to_pylist()], pa.binary())

    return u(col.cast("binary"))


def compress(col: Column, codec: str, level: int | None = None) -> Column:
    return _binary(col, lambda b: registry.compress(codec, b, level))


def decompress(col: Column, codec: str, strict: bool = True, max_ratio: float | None = None) -> Column:
    return _binary(col, lambda b: registry.decompress(codec, b, max_ratio), strict)


def deflate_with_dictionary(col: Column, dictionary: bytes, level: int = 6) -> Column:
    return _binary(col, lambda b: registry.deflate(b, level, dictionary))


def inflate_with_dictionary(col: Column, dictionary: bytes) -> Column:
    return _binary(col, lambda b: registry.inflate(b, dictionary))


def zlib_with_dictionary(col: Column, dictionary: bytes, level: int = 6) -> Column:
    return _binary(col, lambda b: registry.zlib_compress(b, level, dictionary))


def unzlib_with_dictionary(col: Column, dictionary: bytes) -> Column:
    return _binary(col, lambda b: registry.zlib_decompress(b, dictionary))


def zstd_with_dictionary(col: Column, dictionary: bytes, level: int = 3) -> Column:
    return _binary(col, lambda b: registry.zstd_compress(b, level, dictionary))


def unzstd_with_dictionary(col: Column, dictionary: bytes) -> Column:
    return _binary(col, lambda b: registry.zstd_decompress(b, dictionary))


def lz4_with_dictionary(col: Column, dictionary: bytes) -> Column:
    return _binary(col, lambda b: lz4.compress_frame(b, dictionary))


def unlz4_with_dictionary(col: Column, dictionary: bytes) -> Column:
    return _binary(col, lambda b: lz4.decompress_frame(b, dictionary))


def lz4_block(col: Column, level: int | None = None, dictionary: bytes = b"", step: int = 1) -> Column:
    """A raw block behind its size (8 bytes): fast with a step, or high compression with a level."""
    pack = (lambda b: lz4.compress_block(b, dictionary, step)) if level is None else (lambda b: lz4.compress_block_hc(b, level, dictionary))
    return _binary(col, lambda b: len(b).to_bytes(8, "little") + pack(b))


def lz4_unblock(col: Column, dictionary: bytes = b"") -> Column:
    return _binary(col, lambda b: lz4.decompress_block(b[8:], int.from_bytes(b[:8], "little"), dictionary))


def zstd_dictionary_id(col: Column) -> Column:
    """Id of a raw dictionary: the low 32 bits of its XXH64."""
    return xxh64_low(col)


def brotli_transform(word: Column, prefix: str = "", kind: str = "identity", n: int = 0, suffix: str = "") -> Column:
    """A dictionary word with prefix and suffix; kind: identity, first_upper, all_upper, omit_first or
    omit_last (n bytes)."""
    inner = {"identity": lambda: word, "first_upper": lambda: F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 20)), "all_upper": lambda: F.upper(word), "omit_first": lambda: F.substring(word, n + 1, 1 << 20), "omit_last": lambda: F.substring(word, F.lit(1), F.greatest(F.length(word) - n, F.lit(0)))}[kind]()
    return F.concat(F.lit(prefix), inner, F.lit(suffix))


def xz_with_check(col: Column, check: Column) -> Column:
    """An XZ stream with the check of that name: none, crc32, crc64 or sha256."""

    @arrow_udf("binary")
    def f(v: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([None if b is None or n is None else registry.xz_compress(b, check=n) for b, n in zip(v.to_pylist(), names.to_pylist(), strict=True)], pa.binary())

    return f(col.cast("binary"), check)


def xz_check_name(col: Column) -> Column:
    """Which check an XZ stream carries."""
    code = F.conv(F.hex(F.substring(col, 8, 1)), 16, 10).cast("int").bitwiseAND(F.lit(15))
    return F.when(code == 0, "none").when(code == 1, "crc32").when(code == 4, "crc64").when(code == 10, "sha256").otherwise("unknown")


def snappy_with_dictionary(col: Column, dictionary: bytes) -> Column:
    return _binary(col, lambda b: snappy.frame_with_dictionary(b, dictionary))


def unsnappy_with_dictionary(col: Column, dictionary: bytes) -> Column:
    return _binary(col, lambda b: snappy.unframe(b, dictionary))


def lzw(col: Column, config: object = None) -> Column:
    from quarry.codecs.lzw import TIFF, compress as f

    return _binary(col, lambda b: f(b, config or TIFF))


def unlzw(col: Column, config: object = None) -> Column:
    from quarry.codecs.lzw import TIFF, decompress as f

    return _binary(col, lambda b: f(b, config or TIFF))


def lzh_pack(col: Column, method: str = "lh5", dictionary: bytes = b"") -> Column:
    """Size in front (8 bytes), so that it can be unpacked on its own."""
    return _binary(col, lambda b: len(b).to_bytes(8, "little") + lzh.encode(b, method, dictionary))


def lzh_unpack(col: Column, method: str = "lh5", dictionary: bytes = b"") -> Column:
    if dictionary:
        return _binary(col, lambda b: lzh.decode(b[8:], method, int.from_bytes(b[:8], "little"), dictionary))
    return _binary_many(col, lambda values: lzh.decode_many([b[8:] for b in values], method, [int.from_bytes(b[:8], "little") for b in values]))


def bwt(col: Column) -> Column:
    """Last column of the sorted rotations behind the original's row (4 bytes)."""

    def f(b: bytes) -> bytes:
        out, row = transforms.bwt(b)
        return row.to_bytes(4, "big") + out

    return _binary(col, f)


def inverse_bwt(col: Column) -> Column:
    return _binary(col, lambda b: transforms.inverse_bwt(b[4:], int.from_bytes(b[:4], "big")))


def mtf(col: Column) -> Column:
    return _binary(col, transforms.mtf)


def inverse_mtf(col: Column) -> Column:
    return _binary(col, transforms.inverse_mtf)


def rle1(col: Column) -> Column:
    return _binary(col, transforms.rle1)


def inverse_rle1(col: Column) -> Column:
    return _binary(col, transforms.inverse_rle1)


def szip_encode(samples: Column, params: szip.Params) -> Column:
    @arrow_udf("binary")
    def u(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else len(x).to_bytes(4, "big") + szip.encode(x, params) for x in v.to_pylist()], pa.binary())

    return u(samples)


def szip_decode(data: Column, params: szip.Params) -> Column:
    @arrow_udf("array<bigint>")
    def u(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else szip.decode(x[4:], int.from_bytes(x[:4], "big"), params) for x in v.to_pylist()], pa.list_(pa.int64()))

    return u(data)


def _crc(col: Column, crc: checksums.Crc, kind: str) -> Column:
    @arrow_udf(kind)
    def u(v: pa.Array) -> pa.Array:
        known = v.is_valid().to_pylist()
        values = crc.many([x for x in v.to_pylist() if x is not None]).tolist() if any(known) else []
        it = iter(values)
        # 64-bit values are hex, as there is no unsigned type
        form = (lambda x: f"{x:016x}") if kind == "string" else int
        return pa.array([form(next(it)) if k else None for k in known], pa.string() if kind == "string" else pa.int64())

    return u(col.cast("binary"))


def crc16(col: Column) -> Column:
    return _crc(col, checksums.CRC16, "bigint")


def crc32c(col: Column) -> Column:
    return _crc(col, checksums.CRC32C, "bigint")


def crc64(col: Column) -> Column:
    """Hex of CRC-64/XZ."""
    return _crc(col, checksums.CRC64, "string")


def dual_crc(col: Column) -> Column:
    """CRC-32 (an expression of Spark's) and CRC-16."""
    return F.struct(F.crc32(col.cast("binary")).alias("crc32"), crc16(col).alias("crc16"))


def _number(col: Column, f: Callable[[bytes], int], kind: str = "bigint") -> Column:
    run = _map(f, pa.int64() if kind == "bigint" else pa.string())

    @arrow_udf(kind)
    def u(v: pa.Array) -> pa.Array:
        return run(v)

    return u(col.cast("binary"))


def adler32(col: Column) -> Column:
    return _number(col, zlib.adler32)


def adler32_expr(col: Column) -> Column:
    """The same without Python: two running sums over the bytes."""
    data = col.cast("binary")
    start = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint")
    step = lambda s, i: F.struct(((s["a"] + byte(i)) % 65521).alias("a"), ((s["b"] + s["a"] + byte(i)) % 65521).alias("b"))
    positions = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(positions, start, step, lambda s: s["b"] * 65536 + s["a"])


def xxh32(col: Column, seed: int = 0) -> Column:
    return _number(col, lambda b: checksums.xxh32(b, seed))


def xxh64(col: Column, seed: int = 0) -> Column:
    """Hex; Spark's own xxhash64 has a fixed seed of 42."""
    return _number(col, lambda b: f"{checksums.xxh64(b, seed):016x}", "string")


def xxh64_low(col: Column, seed: int = 0) -> Column:
    """The low 32 bits, as Zstandard stores them."""
    return _number(col, lambda b: checksums.xxh64(b, seed) & 0xFFFFFFFF)


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def hmac_sha1(col: Column, key: bytes) -> Column:
    return _binary(col, lambda b: hmac.new(key, b, hashlib.sha1).digest())


def pbkdf2_sha1(col: Column, salt: bytes, iterations: int = 1000, size: int = 32) -> Column:
    return _binary(col, lambda b: crypto.pbkdf2_sha1(b, salt, iterations, size))


def zipcrypto_encrypt(col: Column, password: bytes) -> Column:
    def f(values: list[bytes]) -> list[bytes]:
        checks = [bytes([crypto.crc_check_byte(b)]) for b in values]
        headed = [secrets.token_bytes(11) + check + b for b, check in zip(values, checks, strict=True)]
        return [b + check for b, check in zip(crypto.zipcrypto_many(headed, password, True), checks, strict=True)]

    return _binary_many(col, f)


def zipcrypto_decrypt(col: Column, password: bytes) -> Column:
    def f(values: list[bytes]) -> list[bytes]:
        plain = crypto.zipcrypto_many([b[:-1] for b in values], password, False)
        if any(len(p) < 12 or p[11] != b[-1] for p, b in zip(plain, values, strict=True)):
            raise PermissionError("wrong password")
        return [p[12:] for p in plain]

    return _binary_many(col, f)


def ae2_encrypt(col: Column, password: bytes, strength: int = 3) -> Column:
    return _binary(col, lambda b: crypto.ae2_encrypt(b, password, strength))


def ae2_decrypt(col: Column, password: bytes, strength: int = 3) -> Column:
    return _binary(col, lambda b: crypto.ae2_decrypt(b, password, strength))
