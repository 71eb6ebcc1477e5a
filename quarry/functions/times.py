"""Time stamps and numbers of archive headers. Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(value.cast("int"), shift).bitwiseAND(F.lit(mask))


def _try_timestamp(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.try_make_timestamp(year, month, day, hour, minute, second)


def dos_timestamp(date: Column, time: Column) -> Column:
    """Calendar-correct time stamp of DOS date and time words; null where it is none."""
    return _try_timestamp(_bits(date, 9, 0x7F) + 1980, _bits(date, 5, 0x0F), _bits(date, 0, 0x1F), _bits(time, 11, 0x1F), _bits(time, 5, 0x3F), (_bits(time, 0, 0x1F) * 2).cast("decimal(8,6)"))


def dos_time_ref(date: Column, time: Column) -> Column:
    """Seconds since 1970 by 30-day months and a leap day each fourth year, which drifts from the
    calendar; for comparison with listings that were made that way."""
    year, month, day = _bits(date, 9, 0x7F) + 1980, _bits(date, 5, 0x0F), _bits(date, 0, 0x1F)
    days = (year - 1970) * 365 + F.floor((year - 1969) / 4) + (month - 1) * 30 + day
    return days.cast("bigint") * 86400 + _bits(time, 11, 0x1F) * 3600 + _bits(time, 5, 0x3F) * 60 + _bits(time, 0, 0x1F) * 2


def to_dos_date(ts: Column) -> Column:
    """The date word; years before 1980 are 1980-01-01."""
    packed = F.shiftleft(F.year(ts) - 1980, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))
    return F.when(F.year(ts) < 1980, F.lit(33)).otherwise(packed)


def to_dos_time(ts: Column) -> Column:
    """The time word, in steps of two seconds."""
    packed = F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.floor(F.second(ts) / 2).cast("int"))
    return F.when(F.year(ts) < 1980, F.lit(0)).otherwise(packed)


def filetime(value: Column) -> Column:
    """Time stamp of 100 ns steps since 1601."""
    return F.timestamp_micros(F.floor((value.cast("decimal(20,0)") - F.lit(116444736000000000).cast("decimal(20,0)")) / 10).cast("bigint"))


def to_filetime(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 10 + F.lit(116444736000000000)


def octal(text: Column) -> Column:
    """Octal header number: NUL and spaces trimmed, empty is 0, null where it is none."""
    digits = F.regexp_replace(text, r"^[\x00 ]+|[\x00 ]+$", "")
    return F.when(digits == "", F.lit(0)).when(digits.rlike("^[0-7]+$"), F.conv(digits, 8, 10).cast("bigint"))


def ucs2_be(data: Column) -> Column:
    return F.decode(data, "UTF-16BE")


def byte_at(data: Column, index: Column | int) -> Column:
    """Unsigned byte, index from 0; null beyond the end."""
    at = (F.lit(index) if isinstance(index, int) else index) + 1
    return F.conv(F.nullif(F.hex(F.substring(data, at, F.lit(1))), F.lit("")), 16, 10).cast("bigint")


def little_endian(data: Column, at: int, size: int) -> Column:
    """Unsigned number of size bytes from byte at (0-based)."""
    out = byte_at(data, at)
    for i in range(1, size):
        out = out + byte_at(data, at + i) * F.lit(1 << (8 * i))
    return out


def leb128(data: Column) -> Column:
    """Variable-length number of 7-bit groups, low first (at most nine bytes)."""
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: byte_at(data, i))
    start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(1).cast("bigint").alias("scale"), F.lit(False).alias("done"))
    step = lambda a, b: F.when(a["done"] | b.isNull(), a).otherwise(F.struct((a["v"] + b.bitwiseAND(F.lit(127)) * a["scale"]).alias("v"), F.when(b >= 128, a["scale"] * 128).otherwise(a["scale"]).alias("scale"), (b < 128).alias("done")))
    return F.aggregate(bytes_, start, step, lambda a: F.when(a["done"], a["v"]))


def sevenzip_number(data: Column) -> Column:
    """7z number: leading ones of the first byte say how many bytes follow (six at most here)."""
    first = byte_at(data, 0)
    low = lambda n: sum((byte_at(data, i + 1) * F.lit(1 << (8 * i)) for i in range(n)), F.lit(0).cast("bigint"))
    out = F.when(first < 0x80, first)
    for n in range(1, 7):
        mask = 0x80 >> n
        out = out.when(first < 256 - mask, low(n) + first.bitwiseAND(F.lit(mask - 1)) * F.lit(1 << (8 * n)))
    return out
