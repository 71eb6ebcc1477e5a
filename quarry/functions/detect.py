"""Format detection and format facts, as columns over binary content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label, usual extension, MIME type, class of each format.
FORMATS = [
    ("ZIP", "zip", "application/zip", "archive"),
    ("GZIP", "gz", "application/gzip", "stream"),
    ("TAR", "tar", "application/x-tar", "archive"),
    ("LZH", "lzh", "application/x-lzh-compressed", "archive"),
    ("7-Zip", "7z", "application/x-7z-compressed", "archive"),
    ("XZ", "xz", "application/x-xz", "stream"),
    ("Bzip2", "bz2", "application/x-bzip2", "stream"),
    ("Zstandard", "zst", "application/zstd", "stream"),
    ("LZ4", "lz4", "application/x-lz4", "stream"),
    ("CAB", "cab", "application/vnd.ms-cab-compressed", "archive"),
    ("Brotli", "br", "application/x-brotli", "stream"),
    ("Snappy", "sz", "application/x-snappy", "stream"),
    ("ISO 9660", "iso", "application/x-iso9660-image", "archive"),
]
# Magic bytes at the start, in the order in which they are tried (after LZH).
MAGIC = [
    ("ZIP", "504B"), ("GZIP", "1F8B"), ("7-Zip", "377ABCAF271C"), ("XZ", "FD377A585A00"), ("Bzip2", "425A68"),
    ("Zstandard", "28B52FFD"), ("LZ4", "04224D18"), ("Snappy", "FF060000734E61507059"), ("CAB", "4D534346"),
]


def detect(content: Column) -> Column:
    """Format label of a blob from its first bytes; ISO 9660 by its volume descriptor; else Unknown. LZH comes
    first: its header begins with a size and a sum, which may be the two magic bytes of GZIP or ZIP, and no
    stream of those has LZH's method behind them."""
    begins = lambda h: F.startswith(content, F.unhex(F.lit(h)))
    at = lambda pos, n: F.hex(F.substring(content, pos, n))
    lzh = (at(3, 3) == F.lit("2D6C68")) | (at(3, 3) == F.lit("2D6C7A"))
    out = F.when(F.coalesce(F.octet_length(content), F.lit(0)) < 2, "Unknown").when(lzh & (at(7, 1) == F.lit("2D")), "LZH")
    for label, magic in MAGIC:
        out = out.when(begins(magic), label)
    out = out.when(at(258, 5) == F.lit("7573746172"), "TAR")
    iso = (at(32770, 5) == F.lit("4344303031")) & at(32769, 1).isin("01", "02", "03", "FF")
    return out.when(iso, "ISO 9660").otherwise("Unknown")


def detect_bytes(data: bytes) -> str:
    """The same for bytes in a kernel."""
    if len(data) >= 2:
        if data[2:5] in (b"-lh", b"-lz") and data[6:7] == b"-":
            return "LZH"
        for label, magic in MAGIC:
            if data.startswith(bytes.fromhex(magic)):
                return label
        if data[257:262] == b"ustar":
            return "TAR"
        if data[32769:32774] == b"CD001" and data[32768] in (1, 2, 3, 255):
            return "ISO 9660"
    return "Unknown"


def _fact(label: Column, index: int, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for row in FORMATS for x in (row[0], row[index])])
    return F.coalesce(table[label], F.lit(default))


def extension(label: Column) -> Column:
    return _fact(label, 1, "")


def mime_type(label: Column) -> Column:
    return _fact(label, 2, "application/octet-stream")


def is_compression_only(label: Column) -> Column:
    return label.isin([f[0] for f in FORMATS if f[3] == "stream"])


def is_archive(label: Column) -> Column:
    return label.isin([f[0] for f in FORMATS if f[3] == "archive"])


def by_extension(name: Column) -> Column:
    """Label by file extension, where magic bytes cannot tell (Brotli has none)."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    aliases = {"lha": "LZH", "brotli": "Brotli", "snappy": "Snappy", "zstd": "Zstandard", "tgz": "GZIP"}
    table = F.create_map(*[F.lit(x) for row in FORMATS for x in (row[1], row[0])], *[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(table[ext], F.lit("Unknown"))
