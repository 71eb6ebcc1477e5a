"""ZIP: central directory, local headers, streams, repair scan, and writing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from datetime import datetime

from quarry.codecs import crypto, registry
from quarry.containers.model import Entry, FormatError, dos_time, to_dos, unix_time
from quarry.functions.entries import ZIP_METHODS

LOCAL, CENTRAL, END, DESCRIPTOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\7\x08"
END64, LOCATOR64 = b"PK\6\6", b"PK\6\7"
FULL32 = 0xFFFFFFFF


def _name(raw: bytes, flags: int) -> str:
    return raw.decode("utf-8", "replace")


def extra_fields(extra: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        out.setdefault(kind, extra[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def aes_info(extra: bytes) -> dict | None:
    """Version, strength and real method of a WinZip AES extra field."""
    body = extra_fields(extra).get(0x9901)
    if body is None or len(body) < 7:
        return None
    version, vendor, strength, method = struct.unpack("<H2sBH", body[:7])
    return {"version": version, "vendor": vendor, "strength": strength, "method": method}


def _entry(raw: bytes, flags: int, method: int, time: int, date: int, crc: int, packed: int, size: int, extra: bytes, **more: object) -> Entry:
    name, fields = _name(raw, flags), extra_fields(extra)
    modified = dos_time(date, time)
    if (stamp := fields.get(0x5455)) and stamp[0] & 1 and len(stamp) >= 5:
        modified = unix_time(struct.unpack_from("<i", stamp, 1)[0])
    aes = aes_info(extra)
    real = aes["method"] if method == 99 and aes else method
    kind = "Directory" if name.endswith("/") else "File"
    return Entry(name, kind, format="ZIP", name_raw=raw, size=size, compressed_size=packed, method=ZIP_METHODS.get(real, "Unknown"), method_id=method, modified=modified, crc32=crc, encrypted=bool(flags & 1), extra=extra, _flags=flags, _time=time, **more)


def _find_end(data: bytes) -> int:
    return data.rfind(END, max(0, len(data) - 65557))


def central(data: bytes) -> list[Entry]:
    """Entries of the central directory; payloads are not touched."""
    at = _find_end(data)
    if at < 0 or at + 22 > len(data):
        raise FormatError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", data, at + 10)
    if at >= 20 and data[at - 20 : at - 16] == LOCATOR64:
        wide = struct.unpack_from("<Q", data, at - 12)[0]
        if data[wide : wide + 4] == END64:
            count, size, start = struct.unpack_from("<QQQ", data, wide + 32)
    out, pos = [], start
    for index in range(count):
        if data[pos : pos + 4] != CENTRAL or pos + 46 > len(data):
            raise FormatError("central directory is cut off")
        made, _, flags, method, time, date, crc, packed, real, n, m, k, _, _, outside, local = struct.unpack_from("<HHHHHHIIIHHHHHII", data, pos + 4)
        raw, extra, comment = data[pos + 46 : pos + 46 + n], data[pos + 46 + n : pos + 46 + n + m], data[pos + 46 + n + m : pos + 46 + n + m + k]
        wide, w = extra_fields(extra).get(1, b""), 0
        values = [real, packed, local]
        for i, v in enumerate(values):
            if v == FULL32 and w + 8 <= len(wide):
                values[i] = struct.unpack_from("<Q", wide, w)[0]
                w += 8
        e = _entry(raw, flags, method, time, date, crc, values[1], values[0], extra, entry_index=index, comment=comment.decode("utf-8", "replace") or None, _local=values[2])
        mode = outside >> 16 if made >> 8 == 3 else None
        if mode and mode & 0o170000 == 0o120000:
            e["entry_type"] = "Symlink"
        e["attributes"] = {"unix_mode": mode & 0o7777 if mode else None, "dos_attributes": outside & 0xFF, "uid": None, "gid": None}
        out.append(e)
        pos += 46 + n + m + k
    for e in out:
        at = e["_local"]
        if data[at : at + 4] == LOCAL and at + 30 <= len(data):
            n, m = struct.unpack_from("<HH", data, at + 26)
            e["data_offset"] = at + 30 + n + m
    return out


def local(data: bytes, strict: bool = False) -> list[Entry]:
    """Entries by a walk over local headers. strict: also through data descriptors, by inflating
    (stored or LZMA payloads of unknown size are an error); else the walk ends at the first of them."""
    out, at = [], 0
    while data[at : at + 4] == LOCAL and at + 30 <= len(data):
        _, flags, method, time, date, crc, packed, size, n, m = struct.unpack_from("<HHHHHIIIHH", data, at + 4)
        raw, extra = data[at + 30 : at + 30 + n], data[at + 30 + n : at + 30 + n + m]
        wide = extra_fields(extra).get(1, b"")
        if size == FULL32 and packed == FULL32 and len(wide) >= 16:
            size, packed = struct.unpack_from("<QQ", wide)
        body = at + 30 + n + m
        after = 0
        if flags & 8 and packed == 0:
            if not strict:
                break
            if method != 8:
                raise FormatError("a descriptor can follow deflated data only")
            plain, used = registry.inflate_consumed(data[body:])
            after, fields = _descriptor(data, body + used, used, len(plain))
            crc, packed, size = fields
            if zlib.crc32(plain) != crc:
                raise FormatError("CRC mismatch in a stream")
        e = _entry(raw, flags, method, time, date, crc, packed, size, extra, entry_index=len(out), data_offset=body, _local=at)
        e["attributes"] = {"unix_mode": None, "dos_attributes": None, "uid": None, "gid": None}
        out.append(e)
        at = body + packed + after
    return out


def _descriptor(data: bytes, at: int, packed: int, size: int) -> tuple[int, tuple[int, int, int]]:
    """(its length, (crc, packed, size)) of a data descriptor, with or without signature or 64 bits."""
    for sign in (4, 0):
        if sign and data[at : at + 4] != DESCRIPTOR:
            continue
        for form, width in (("<III", 12), ("<IQQ", 20)):
            if at + sign + width <= len(data):
                fields = struct.unpack_from(form, data, at + sign)
                if fields[1:] == (packed, size):
                    return sign + width, fields
    raise FormatError("no data descriptor")


def read(data: bytes, mode: str = "auto") -> list[Entry]:
    """mode: auto (central directory, else local headers), central, local_headers or stream."""
    if mode == "stream":
        return local(data, strict=True)
    if mode == "local_headers":
        return local(data)
    try:
        return central(data)
    except FormatError:
        if mode == "central":
            raise
        out = local(data)
        if not out and data[:4] != END:
            raise FormatError("not a ZIP archive") from None
        return out


def raw(data: bytes, e: Entry) -> bytes:
    if e["data_offset"] is None or e["data_offset"] + e["compressed_size"] > len(data):
        raise FormatError("payload is cut off")
    return data[e["data_offset"] : e["data_offset"] + e["compressed_size"]]


def unlzma(body: bytes, size: int) -> bytes:
    """Method 14: version, length of the properties, properties, raw stream."""
    n = struct.unpack_from("<H", body, 2)[0]
    props, dict_size = body[4], struct.unpack_from("<I", body, 5)[0]
    return registry.lzma_raw_props(body[4 + n :], props, dict_size, size)


def enlzma(data: bytes, level: int = 6) -> bytes:
    alone = registry.lzma_alone(data, level)
    return b"\x09\x14\x05\x00" + alone[:5] + alone[13:]


def unpack(method: int, body: bytes, size: int, limit: int | None = None) -> bytes:
    if method == 14:
        if limit is not None and size > limit:
            raise registry.LimitExceeded(f"more than {limit} bytes")
        return unlzma(body, size)
    codec = {0: "stored", 8: "deflate", 12: "bzip2", 93: "zstd"}.get(method)
    if codec is None:
        raise NotImplementedError(f"method {method}")
    return registry.decompress(codec, body, limit=limit)


def content(data: bytes, e: Entry, password: bytes | None = None, limit: int | None = None) -> bytes:
    """Plain bytes, verified against the CRC-32 (AE-2 entries have none but their own tag)."""
    body, method, checked = raw(data, e), e["method_id"], True
    if e["encrypted"]:
        if password is None:
            raise PermissionError("a password is needed")
        aes = aes_info(e["extra"])
        if method == 99 and aes:
            body, method, checked = crypto.ae2_decrypt(body, password, aes["strength"]), aes["method"], aes["version"] == 1
        else:
            check = e["_time"] >> 8 if e["_flags"] & 8 else e["crc32"] >> 24
            body = crypto.zipcrypto_decrypt(body, password, check)
    plain = unpack(method, body, e["size"], limit)
    if checked and zlib.crc32(plain) != e["crc32"]:
        raise CrcMismatch(e["crc32"], zlib.crc32(plain), plain)
    return plain


class CrcMismatch(ValueError):
    def __init__(self, expected: int, computed: int, plain: bytes) -> None:
        super().__init__(f"checksum {computed:08x} instead of {expected:08x}")
        self.expected, self.computed, self.plain = expected, computed, plain


def recover(data: bytes, max_size: int = 64 << 20) -> Iterator[dict]:
    """Entries at every local header that can be read, whatever stands between them: dicts of name,
    offset, end, size, status (Verified, Recovered, RawOnly) and content (None for RawOnly)."""
    at = data.find(LOCAL)
    while at >= 0:
        found = _candidate(data, at, max_size)
        if found:
            yield found
            at = data.find(LOCAL, found["end"])
        else:
            at = data.find(LOCAL, at + 1)


def _candidate(data: bytes, at: int, max_size: int) -> dict | None:
    if at + 30 > len(data):
        return None
    version, flags, method, _, _, crc, packed, size, n, m = struct.unpack_from("<HHHHHIIIHH", data, at + 4)
    body = at + 30 + n + m
    if n == 0 or n > 4096 or body > len(data) or version > 100:
        return None
    name = _name(data[at + 30 : at + 30 + n], flags)
    has_descriptor = bool(flags & 8)
    end = body + packed
    if has_descriptor and packed == 0:
        stops = [i for s in (DESCRIPTOR, LOCAL, CENTRAL) if (i := data.find(s, body)) >= 0]
        end = min(stops, default=len(data))
    if end > len(data):
        end = len(data)
    out = {"name": name, "offset": at, "end": end, "method": ZIP_METHODS.get(method, "Unknown"), "size": None, "status": "RawOnly", "content": None, "crc32": crc}
    if max(size, 0) > max_size or flags & 1:
        return out
    try:
        if method == 8:
            plain, used = registry.inflate_consumed(data[body:end])
            out["end"] = end = body + used if has_descriptor else end
            if has_descriptor and data[end : end + 4] == DESCRIPTOR:
                out["end"] = end + 16
        else:
            plain = unpack(method, data[body:end], size)
    except Exception:  # any damage to the payload
        return out
    if len(plain) > max_size:
        return out
    status = "Recovered" if has_descriptor and crc == 0 else "Verified" if zlib.crc32(plain) == crc else "Recovered"
    return out | {"size": len(plain), "status": status, "content": plain}


class Writer:
    """Builds an archive in memory; ZIP64 fields where numbers overflow."""

    def __init__(self) -> None:
        self.out, self.directory = bytearray(), []

    def add(self, name: str, data: bytes = b"", method: str = "Deflate", level: int = 6, modified: datetime | None = None, mode: int | None = None, comment: str = "", password: bytes | None = None, encryption: str = "aes256") -> None:
        """A directory is a name that ends with a slash."""
        if name.endswith("/"):
            method, data = "Stored", b""
        crc, ident = zlib.crc32(data), {v: k for k, v in ZIP_METHODS.items()}[method]
        packed = {0: lambda: data, 8: lambda: registry.deflate(data, level), 12: lambda: registry.compress("bzip2", data), 14: lambda: enlzma(data, level), 93: lambda: registry.zstd_compress(data)}[ident]()
        if ident == 8 and len(packed) >= len(data):
            packed, ident = data, 0
        flags, extra = 0x800 if not name.isascii() else 0, b""
        if password is not None:
            flags |= 1
            if encryption == "traditional":
                packed = crypto.zipcrypto_encrypt(packed, password, crc >> 24)
            else:
                strength = {"aes128": 1, "aes192": 2, "aes256": 3}[encryption]
                packed = crypto.ae2_encrypt(packed, password, strength)
                extra, ident, crc = struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", strength, ident), 99, 0
        self._put(name, packed, len(data), ident, crc, flags, extra, modified, mode, comment)

    def add_raw(self, name: str, packed: bytes, method_id: int, crc: int, size: int, modified: datetime | None = None, mode: int | None = None, comment: str = "", flags: int = 0, extra: bytes = b"") -> None:
        """Compressed bytes as they are."""
        self._put(name, packed, size, method_id, crc, flags, extra, modified, mode, comment)

    def _put(self, name: str, packed: bytes, size: int, method: int, crc: int, flags: int, extra: bytes, modified: datetime | None, mode: int | None, comment: str) -> None:
        date, time = to_dos(modified)
        raw, at = name.encode(), len(self.out)
        wide = struct.pack("<HHQQ", 1, 16, size, len(packed)) if max(size, len(packed)) >= FULL32 else b""
        short = (FULL32, FULL32) if wide else (len(packed), size)
        need = 45 if wide else 51 if method == 99 else 63 if method in (14, 93) else 20
        self.out += LOCAL + struct.pack("<HHHHHIIIHH", need, flags, method, time, date, crc, *short, len(raw), len(wide + extra)) + raw + wide + extra + packed
        self.directory.append((raw, need, flags, method, time, date, crc, len(packed), size, extra, at, mode, comment.encode(), name.endswith("/")))

    def finish(self) -> bytes:
        start = len(self.out)
        for raw, need, flags, method, time, date, crc, packed, size, extra, at, mode, comment, is_dir in self.directory:
            over = [v for v in (size, packed, at) if v >= FULL32]
            wide = struct.pack(f"<HH{len(over)}Q", 1, 8 * len(over), *over) if over else b""
            unix = mode if mode is not None else 0o755 if is_dir else 0o644
            outside = (unix | (0o040000 if is_dir else 0o100000)) << 16 | 0x10 * is_dir
            self.out += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 3 << 8 | 63, need, flags, method, time, date, crc, min(packed, FULL32), min(size, FULL32), len(raw), len(wide + extra), len(comment), 0, 0, outside, min(at, FULL32)) + raw + wide + extra + comment
        size, n = len(self.out) - start, len(self.directory)
        if n >= 0xFFFF or start >= FULL32 or size >= FULL32:
            at = len(self.out)
            self.out += END64 + struct.pack("<QHHIIQQQQ", 44, 63, 45, 0, 0, n, n, size, start) + LOCATOR64 + struct.pack("<IQI", 0, at, 1)
        self.out += END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, FULL32), min(start, FULL32), 0)
        return bytes(self.out)
