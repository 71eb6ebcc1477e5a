"""The entry relation: one row for each member of an archive, whatever its format."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import types as T

WARNING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("entry_name", T.StringType()), T.StructField("expected", T.LongType()), T.StructField("computed", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("message", T.StringType())])
ATTRIBUTES = T.StructType([T.StructField("unix_mode", T.LongType()), T.StructField("dos_attributes", T.IntegerType()), T.StructField("uid", T.LongType()), T.StructField("gid", T.LongType())])

ENTRIES = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("format", T.StringType()), T.StructField("entry_index", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("name_raw", T.BinaryType()),
    T.StructField("entry_type", T.StringType()), T.StructField("size", T.LongType()), T.StructField("compressed_size", T.LongType()), T.StructField("method", T.StringType()), T.StructField("method_id", T.IntegerType()),
    T.StructField("modified", T.TimestampType()), T.StructField("created", T.TimestampType()), T.StructField("accessed", T.TimestampType()), T.StructField("attributes", ATTRIBUTES), T.StructField("crc32", T.LongType()), T.StructField("crc16", T.IntegerType()),
    T.StructField("comment", T.StringType()), T.StructField("link_target", T.StringType()), T.StructField("uname", T.StringType()), T.StructField("gname", T.StringType()), T.StructField("data_offset", T.LongType()), T.StructField("extra", T.BinaryType()),
    T.StructField("encrypted", T.BooleanType()), T.StructField("folder_index", T.IntegerType()), T.StructField("content", T.BinaryType()), T.StructField("raw_content", T.BinaryType()), T.StructField("status", T.StringType()), T.StructField("warnings", T.ArrayType(WARNING)),
])

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def arrow_schema() -> pa.Schema:
    """ENTRIES for Arrow; time stamps carry UTC."""
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = to_arrow_schema(ENTRIES)
    stamp = pa.timestamp("us", tz="UTC")
    return pa.schema([pa.field(f.name, stamp if pa.types.is_timestamp(f.type) else f.type, f.nullable) for f in plain])


class FormatError(ValueError):
    """The bytes are no archive of the format, or are cut off where nothing can be read."""


class Entry(dict):
    """A row under construction; missing columns are null."""

    def __init__(self, name: str, entry_type: str = "File", **columns: object) -> None:
        super().__init__({f: None for f in ENTRIES.names} | {"name": name, "entry_type": entry_type, "encrypted": False, "status": "OK", "warnings": []} | columns)

    def warn(self, kind: str, message: str, expected: int | None = None, computed: int | None = None, size: int | None = None) -> Entry:
        self["warnings"].append({"kind": kind, "entry_name": self["name"], "expected": expected, "computed": computed, "bytes": size, "message": message})
        return self


def dos_time(date: int, time: int) -> datetime | None:
    """Calendar-correct; None where the fields are no date."""
    try:
        return datetime((date >> 9) + 1980, date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, min(59, (time & 31) * 2), tzinfo=UTC)
    except ValueError:
        return None


def to_dos(when: datetime | None) -> tuple[int, int]:
    if when is None or when.year < 1980:
        return 33, 0
    when = when.astimezone(UTC) if when.tzinfo else when
    return (min(when.year, 2107) - 1980) << 9 | when.month << 5 | when.day, when.hour << 11 | when.minute << 5 | when.second // 2


def unix_time(seconds: float | None) -> datetime | None:
    try:
        return None if seconds is None else EPOCH + timedelta(seconds=seconds)
    except OverflowError:
        return None


def filetime(value: int) -> datetime | None:
    try:
        return EPOCH + timedelta(microseconds=(value - 116444736000000000) // 10) if value else None
    except OverflowError:
        return None


def seconds_of(when: datetime | None) -> int:
    if when is None:
        return 0
    return int(((when if when.tzinfo else when.replace(tzinfo=UTC)) - EPOCH).total_seconds())
