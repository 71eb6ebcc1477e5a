"""Queries of containers that this package reads and does not write: 7z, cabinets, ISO images, sparse
tape entries and ZIP files with descriptors are laid out here from table rows, by the formats' own
descriptions, and read back. Also header fields of blobs, and streams of pieces."""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.containers import others
from quarry.functions import bits as B
from quarry.functions import codecs as C
from quarry.operators import archives as A
from quarry.operators import training
from quarry.plans.archives import packed, packed_turns
from quarry.plans.scalars import table
from quarry.streaming import codecs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Files = list[tuple[str, bytes]]


def number7z(v: int) -> bytes:
    """A 7z number: as many leading ones as there are bytes behind the first."""
    n = next(n for n in range(9) if n == 8 or v < 1 << 7 * (n + 1))
    return bytes([0xFF00 >> n & 0xFF | (v >> 8 * n if n < 8 else 0)]) + (v & (1 << 8 * n) - 1).to_bytes(n, "little")


def sevenzip(files: Files, codec: str = "lzma2") -> bytes:
    """One folder of one coder over all files, with sizes and checksums of each."""
    body = b"".join(c for _, c in files)
    if codec == "copy":
        data, coder = body, b"\1\0"
    else:
        data = lzma.compress(body, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
        coder = b"\x21\x21\x01\x10"
    num = number7z
    crcs = b"".join(struct.pack("<I", zlib.crc32(c)) for _, c in files)
    folder = b"\x07\x0b" + num(1) + b"\0" + num(1) + coder + b"\x0c" + num(len(body)) + b"\0"
    streams_ = b"\x04\x06" + num(0) + num(1) + b"\x09" + num(len(data)) + b"\0" + folder + b"\x08\x0d" + num(len(files)) + b"\x09" + b"".join(num(len(c)) for _, c in files[:-1]) + b"\x0a\x01" + crcs + b"\0\0"
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in files)
    head = b"\1" + streams_ + b"\x05" + num(len(files)) + b"\x11" + num(len(names)) + names + b"\0\0"
    start = struct.pack("<QQI", len(data), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + data + head


def cabinet(files: Files, compressed: bool = True) -> bytes:
    """One folder; MSZIP blocks of 32 KiB, each with the ones before it as dictionary."""
    body, entries, at = b"".join(c for _, c in files), b"", 0
    for n, c in files:
        entries += struct.pack("<IIHHHH", len(c), at, 0, 0x5865, 0x6000, 0x21) + n.encode() + b"\0"
        at += len(c)
    blocks, data, history = 0, b"", b""
    for i in range(0, len(body), 32768):
        plain = body[i : i + 32768]
        z = zlib.compressobj(6, zlib.DEFLATED, -15, zdict=history) if history else zlib.compressobj(6, zlib.DEFLATED, -15)
        one = b"CK" + z.compress(plain) + z.flush() if compressed else plain
        head = struct.pack("<HH", len(one), len(plain))
        data += struct.pack("<I", others.cab_checksum(head, others.cab_checksum(one))) + head + one
        history, blocks = (history + plain)[-32768:], blocks + 1
    start = 36 + 8 + len(entries)
    return b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, start + len(data), 0, 44, 0, 3, 1, 1, len(files), 0, 0, 0) + struct.pack("<IHH", start, blocks, int(compressed)) + entries + data


def iso(files: Files) -> bytes:
    """A volume with one directory D that holds the files."""
    both = lambda v: struct.pack("<I", v) + struct.pack(">I", v)

    def record(name: bytes, sector: int, size: int, flags: int) -> bytes:
        body = b"\0" + both(sector) + both(size) + bytes([124, 3, 5, 12, 34, 56, 0]) + bytes([flags, 0, 0]) + b"\1\0\0\1" + bytes([len(name)]) + name
        body += b"\0" * (len(body) % 2 == 0)
        return bytes([len(body) + 1]) + body

    def sectors(records: list[bytes]) -> bytes:  # a record does not cross a sector's end
        out = b""
        for r in records:
            if len(out) // 2048 != (len(out) + len(r) - 1) // 2048:
                out = out.ljust(-(-len(out) // 2048) * 2048, b"\0")
            out += r
        return out.ljust(-(-len(out) // 2048) * 2048, b"\0")

    def directory(first: int, size: int) -> bytes:
        at, records = first, [record(b"\0", 19, size, 2), record(b"\1", 18, 2048, 2)]
        for n, c in files:
            records.append(record(n.encode() + b";1", at, len(c), 0))
            at += -(-len(c) // 2048)
        return sectors(records)

    size = len(directory(0, 0))
    sub = directory(19 + size // 2048, size)
    root = sectors([record(b"\0", 18, 2048, 2), record(b"\1", 18, 2048, 2), record(b"D", 19, size, 2)])
    volume = ((b"\1CD001\1\0").ljust(156, b"\0") + record(b"\0", 18, 2048, 2)).ljust(2048, b"\0")
    return b"\0" * 32768 + volume + b"\xffCD001\1".ljust(2048, b"\0") + root + sub + b"".join(c.ljust(-(-len(c) // 2048) * 2048, b"\0") for _, c in files)


def sparse_tar(files: Files) -> bytes:
    """Each file twice with a hole of 1,000 bytes between, as an old-GNU sparse entry."""
    out = b""
    for name, c in files:
        runs = [r for r in ((0, len(c)), (len(c) + 1000, len(c))) if r[1]]
        head = bytearray(512)
        octal = lambda v, n: f"{v:0{n - 1}o}\0".encode()
        head[0 : len(name)] = name.encode()
        head[100:108], head[108:116], head[116:124], head[124:136], head[136:148] = octal(0o644, 8), octal(0, 8), octal(0, 8), octal(2 * len(c), 12), octal(0, 12)
        head[156:157], head[257:265] = b"S", b"ustar  \0"
        for i, (at, n) in enumerate(runs):
            head[386 + 24 * i : 398 + 24 * i], head[398 + 24 * i : 410 + 24 * i] = octal(at, 12), octal(n, 12)
        head[483:495] = octal(2 * len(c) + 1000, 12)
        head[148:156] = b" " * 8
        head[148:156] = f"{sum(head):06o}\0 ".encode()
        out += bytes(head) + (c + c).ljust(-(-2 * len(c) // 512) * 512, b"\0")
    return out + b"\0" * 1024


def streamed_zip(files: Files) -> bytes:
    """Local headers without sizes, each payload with a descriptor behind it, and no directory."""
    out = b""
    for name, c in files:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed_ = z.compress(c) + z.flush()
        out += b"PK\3\4" + struct.pack("<HHHHHIIIHH", 20, 8, 8, 0, 33, 0, 0, 0, len(name), 0) + name.encode() + packed_ + b"PK\7\x08" + struct.pack("<III", zlib.crc32(c), len(packed_), len(c))
    return out


def blobs(rows: DataFrame, build: Callable[[Files], bytes], most: int = 2 << 20) -> DataFrame:
    """(archive, content): rows (archive, name, content) laid out by build, in volumes."""
    dealt = A.volumes(rows.select("archive", "name", "content"), "archive", most)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("name")
        made = build([(n, c or b"") for n, c in zip(group["name"].to_pylist(), group["content"].to_pylist(), strict=True)])
        return pa.table({"archive": group["archive"].slice(0, 1), "content": pa.array([made], pa.binary())})

    return dealt.groupBy("archive", "volume").applyInArrow(run, "archive string, content binary")


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files with names that every format can hold: one archive a source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("archive"), F.concat(F.lit("F"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("name"), F.col("text").cast("binary").alias("content"))


SOURCE_SQL = "(SELECT source AS archive, 'F' || doc_id || '.TXT' AS name, coalesce(text, '') AS text FROM documents)"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _entries(name: str, format: str, build: Callable[[Files], bytes], prefix: str = "", **options: object) -> None:
    sql = f"SELECT archive, '{format}' AS format, '{prefix}' || name AS name, strlen(text) AS size, sha256(text) AS digest, 'OK' AS status FROM {SOURCE_SQL}"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = A.scan(blobs(by_source(spark, sf_dir), build), with_content=True, **options).where("entry_type = 'File'")
        return found.select("archive", "format", "name", "size", F.sha2("content", 256).alias("digest"), "status")


_entries("sevenzip_entries", "7-Zip", sevenzip)
_entries("sevenzip_stored_entries", "7-Zip", lambda files: sevenzip(files, "copy"))
_entries("cab_entries", "CAB", cabinet)
_entries("cab_stored_entries", "CAB", lambda files: cabinet(files, False))
_entries("iso_entries", "ISO 9660", iso, "D/")
_entries("zip_stream_entries", "ZIP", streamed_zip, mode="stream")
query("tar_sparse_entries", f"SELECT archive, name, 2 * strlen(text) + 1000 AS size, sha256(text || repeat(chr(0), 1000) || text) AS digest FROM {SOURCE_SQL} WHERE strlen(text) > 0")(
    lambda s, d: A.scan(blobs(by_source(s, d), sparse_tar), with_content=True, format="TAR").where("size > 1000").select("archive", "name", "size", F.sha2("content", 256).alias("digest"))
)
query("damaged_folders", "SELECT archive, false AS whole FROM (SELECT DISTINCT source AS archive FROM documents)")(
    lambda s, d: A.scan(blobs(by_source(s, d), cabinet).select("archive", F.expr("substring(content, 1, octet_length(content) - 1)").alias("content")), with_content=True).groupBy("archive").agg((F.count_if(F.col("status") != "OK") == 0).alias("whole"))
)
query("tar_checksums", "SELECT archive, true AS ok FROM (SELECT DISTINCT role AS archive FROM conversations)")(lambda s, d: packed_turns(s, d, "tar").groupBy("archive").agg(F.every(B.tar_checksum_ok(F.substring("content", 1, 512))).alias("ok")))
query("zlib_dictionary_ids", f"SELECT doc_id, {zlib.adler32(b'common words of a dictionary')}::BIGINT AS asked FROM documents WHERE text IS NOT NULL")(
    lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", B.zlib_dict_id(C.zlib_with_dictionary(F.col("text"), b"common words of a dictionary")).cast("bigint").alias("asked"))
)
query("sample_parameters", "SELECT p_partkey, p_size BETWEEN 1 AND 32 AND p_partkey % 24 IN (8, 16) AS valid FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", B.valid_sample_params(F.col("p_size"), F.col("p_partkey") % 24).alias("valid")))
query("recovery_classes", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Verified' ELSE 'Recovered' END AS class FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", B.recovery_class(F.col("p_partkey"), F.expr("CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey + 1 ELSE 0 END"), F.col("p_partkey") % 3 == 2).alias("class"))
)
query("xz_checks", "SELECT n_nationkey, ['none', 'crc32', 'crc64', 'sha256'][n_nationkey % 4 + 1] AS name, sha256(n_name) AS digest FROM nation")(
    lambda s, d: table(s, d, "nation").withColumn("packed", C.xz_with_check(F.col("n_name"), F.expr("element_at(array('none', 'crc32', 'crc64', 'sha256'), cast(n_nationkey % 4 as int) + 1)"))).select("n_nationkey", C.xz_check_name(F.col("packed")).alias("name"), F.sha2(C.decompress(F.col("packed"), "xz"), 256).alias("digest"))
)
query("bounded_decoding", "SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'LIMIT' ELSE 'OK' END AS status FROM documents WHERE text IS NOT NULL")(
    lambda s, d: A.scan(A.single_stream(table(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("archive"), F.col("text").cast("binary").alias("content")), "bzip2"), format="Bzip2", with_content=True, memory_limit=4000).select(F.col("archive").cast("bigint").alias("doc_id"), "status")
)
query("listed_volumes", "SELECT lang AS archive, count(*) AS files FROM documents GROUP BY lang")(lambda s, d: A.totals(A.scan(packed(s, d, "tar"))).select("archive", "files"))


# ---- streams: conversations are streams of bytes, their turns the pieces


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations")
    ends = d.groupBy("conv_id").agg(F.max("turn").alias("_end")).withColumnRenamed("conv_id", "_c")
    stream = spark.readStream.schema(d.schema).parquet(f"{sf_dir}/conversations.parquet*")
    both = stream.join(ends, F.col("conv_id") == F.col("_c"))
    return both.select(F.col("conv_id").alias("key"), F.col("turn").cast("bigint").alias("seq"), F.col("text").cast("binary").alias("data"), (F.col("turn") == F.col("_end")).alias("last"))


def _streamed(name: str, codec: str, flush: str = "sync") -> None:
    head = {"gzip": "1F8B", "zlib": "789C", "zstd": "28B52FFD", "lz4": "04224D18", "bzip2": "425A68", "xz": "FD377A58", "snappy": "FF060000"}.get(codec)
    sql = f"SELECT conv_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS digest{f", '{head}' AS head" if head else ''} FROM conversations GROUP BY conv_id"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sent = streams.played(spark, streams.compress_stream(pieces(spark, sf_dir), codec, flush=flush))
        first = sent.groupBy("key").agg(F.min(F.struct("seq", "data"))["data"].alias("_first")).withColumnRenamed("key", "_k")
        last = sent.groupBy("key").agg(F.max("seq").alias("_end")).withColumnRenamed("key", "_k2")
        back = spark.readStream.schema(sent.schema).parquet(streams.path_of(sent)).join(last, F.col("key") == F.col("_k2")).select("key", "seq", "data", (F.col("seq") == F.col("_end")).alias("last"))
        got = streams.played(spark, streams.decompress_stream(back, codec))
        whole = got.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("_l")).join(first, F.col("key") == F.col("_k"))
        return whole.select(F.col("key").alias("conv_id"), F.sha2(training.join_bytes(F.col("_l.data")), 256).alias("digest"), *[F.hex(F.substring("_first", 1, len(head) // 2)).alias("head") for _ in [0] if head])


for _codec in ("gzip", "zlib", "deflate", "zstd", "lz4", "bzip2", "xz", "snappy", "lzma2", "brotli", "lzw", "lzh"):
    _streamed(f"stream_{_codec}", _codec)
for _flush in ("full", "partial"):
    _streamed(f"stream_gzip_{_flush}_flush", "gzip", _flush)
