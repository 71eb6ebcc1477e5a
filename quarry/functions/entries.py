"""Facts about entry rows: predicates, ratios, attributes. Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Method labels, and ZIP method ids that have one.
METHODS = ["Stored", "Deflate", "lh0", "lh4", "lh5", "lh6", "lh7", "LZMA", "LZMA2", "Bzip2", "Zstd"]
ZIP_METHODS = {0: "Stored", 8: "Deflate", 12: "Bzip2", 14: "LZMA", 93: "Zstd"}


def is_file(entry_type: Column) -> Column:
    return entry_type == "File"


def is_dir(entry_type: Column) -> Column:
    return entry_type == "Directory"


def is_symlink(entry_type: Column) -> Column:
    return entry_type == "Symlink"


def is_stored(method: Column) -> Column:
    return method.isin("Stored", "lh0")


def method_name(zip_id: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ZIP_METHODS.items() for x in kv])
    return F.coalesce(table[zip_id.cast("int")], F.lit("Unknown"))


def is_readonly(dos: Column, mode: Column) -> Column:
    """DOS bit 0 where there are DOS attributes, else no write bit in the mode."""
    return F.coalesce(dos.bitwiseAND(F.lit(1)) != 0, mode.bitwiseAND(F.lit(0o222)) == 0, F.lit(False))


def is_hidden(dos: Column) -> Column:
    return F.coalesce(dos.bitwiseAND(F.lit(2)) != 0, F.lit(False))


def is_system(dos: Column) -> Column:
    return F.coalesce(dos.bitwiseAND(F.lit(4)) != 0, F.lit(False))


def compression_ratio(size: Column, compressed: Column) -> Column:
    """1.0 for empty entries."""
    return F.when(size == 0, F.lit(1.0)).otherwise(compressed.cast("double") / size.cast("double"))


def space_savings(size: Column, compressed: Column) -> Column:
    """Percent; 0.0 for empty entries."""
    return F.when(size == 0, F.lit(0.0)).otherwise((F.lit(1.0) - compressed.cast("double") / size.cast("double")) * 100.0)


def sort_ratio(size: Column, compressed: Column) -> Column:
    """The ratio that sorting uses: 0.0 for empty entries."""
    return F.when(size > 0, compressed.cast("double") / size.cast("double")).otherwise(F.lit(0.0))


def storage_choice(content_length: Column, threshold: int) -> Column:
    """Below the threshold entries are stored."""
    return F.when(content_length < threshold, F.lit("Stored")).otherwise(F.lit("Deflate"))


def within_limit(size: Column, limit: int | None, name: Column) -> Column:
    """The size, or an error that names the entry above the limit."""
    if limit is None:
        return size
    return F.when(size > limit, F.raise_error(F.concat(F.lit("entry exceeds memory limit: "), name)).cast("bigint")).otherwise(size)


def json_entry(name: Column, size: Column, compressed: Column, method: Column, crc: Column, mtime: Column, entry_type: Column) -> Column:
    """The listing's JSON object; absent values drop out."""
    return F.to_json(F.struct(
        name.alias("name"), size.alias("size"), compressed.alias("compressed_size"), compression_ratio(size, compressed).alias("ratio"), method.alias("method"),
        F.when(crc.isNotNull(), F.lower(F.lpad(F.hex(crc), 8, "0"))).alias("crc"), F.unix_timestamp(mtime).alias("mtime"), is_dir(entry_type).alias("is_dir"),
    ))
