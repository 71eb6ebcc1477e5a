"""LZH / LHA: header levels 0 to 3 with extension headers, and writing."""

from __future__ import annotations

import struct
from datetime import datetime

from quarry.codecs import lzh
from quarry.codecs.checksums import CRC16
from quarry.containers.model import Entry, FormatError, dos_time, filetime, seconds_of, to_dos, unix_time


UTF8 = 65001  # code page number


def _decode(raw: bytes, page: int = 932) -> str:
    return raw.decode("utf-8" if page == UTF8 else "cp932", "replace")


def extensions(data: bytes, at: int, first: int, width: int = 2) -> tuple[dict[int, bytes], int]:
    """(extension headers by type, byte after them): each says how long the next one is."""
    out, size = {}, first
    while size:
        if size < width + 1 or at + size > len(data):
            raise FormatError("extension header is cut off")
        out[data[at]] = data[at + 1 : at + size - width]
        size, at = int.from_bytes(data[at + size - width : at + size], "little"), at + size
    return out, at


def _apply(e: Entry, ext: dict[int, bytes]) -> None:
    a = e["attributes"]
    page = struct.unpack_from("<I", ext[0x46])[0] if len(ext.get(0x46, b"")) >= 4 else 932
    name, folder = ext.get(1, e["name_raw"]), ext.get(2)
    if name is not None:
        e["name_raw"] = name
        e["name"] = _decode(name, page).replace("\\", "/")
    if folder:
        e["name"] = _decode(folder.replace(b"\xff", b"/").rstrip(b"/"), page) + "/" + e["name"]
    for kind in (0x3F, 0x71):
        if kind in ext:
            e["comment"] = _decode(ext[kind], page)
    if len(ext.get(0x40, b"")) >= 2:
        a["dos_attributes"] = struct.unpack_from("<H", ext[0x40])[0] & 255
    if len(ext.get(0x41, b"")) >= 24:
        created, modified, accessed = struct.unpack_from("<QQQ", ext[0x41])
        e["created"], e["modified"], e["accessed"] = filetime(created), filetime(modified) or e["modified"], filetime(accessed)
    if len(ext.get(0x42, b"")) >= 16:
        e["compressed_size"], e["size"] = struct.unpack_from("<QQ", ext[0x42])
    if len(ext.get(0x50, b"")) >= 2:
        a["unix_mode"] = struct.unpack_from("<H", ext[0x50])[0] & 0o7777
    if len(ext.get(0x51, b"")) >= 4:
        a["gid"], a["uid"] = struct.unpack_from("<HH", ext[0x51])
    if 0x52 in ext:
        e["gname"] = _decode(ext[0x52])
    if 0x53 in ext:
        e["uname"] = _decode(ext[0x53])
    if len(ext.get(0x54, b"")) >= 4:
        e["modified"] = unix_time(struct.unpack_from("<I", ext[0x54])[0])


def read(data: bytes, lenient: bool = False) -> list[Entry]:
    """Entries in order. lenient: a cut-off end and a wrong level-0/1 header sum become warnings."""
    out, at = [], 0
    while at + 21 <= len(data) and data[at]:
        method = data[at + 2 : at + 7]
        if method[:1] != b"-" or method[4:5] != b"-":
            if lenient and out:
                out[-1].warn("SkippedEntry", f"no header at {at}")
                break
            raise FormatError(f"no LZH header at {at}")
        packed, size, stamp, attribute, level = struct.unpack_from("<IIIBB", data, at + 7)
        e = Entry("", format="LZH", entry_index=len(out), size=size, compressed_size=packed, method=method[1:4].decode("latin1"), attributes={"unix_mode": None, "dos_attributes": attribute, "uid": None, "gid": None})
        ext: dict[int, bytes] = {}
        if level in (0, 1):
            total, n = data[at], data[at + 21]
            raw = data[at + 22 : at + 22 + n]
            e["name_raw"], e["name"] = raw, _decode(raw).replace("\\", "/")
            e["crc16"] = struct.unpack_from("<H", data, at + 22 + n)[0]
            e["modified"] = dos_time(stamp >> 16, stamp & 0xFFFF)
            body = at + 2 + total
            if sum(data[at + 2 : body]) & 255 != data[at + 1]:
                if not lenient:
                    raise FormatError(f"header checksum mismatch at {at}")
                e.warn("HeaderChecksumMismatch", "header checksum mismatch", data[at + 1], sum(data[at + 2 : body]) & 255)
            if level == 1:
                first = struct.unpack_from("<H", data, body - 2)[0]
                ext, after = extensions(data, body, first)
                e["compressed_size"] = packed - (after - body)
                body = after
        elif level == 2:
            total = struct.unpack_from("<H", data, at)[0]
            e["crc16"], first = struct.unpack_from("<H", data, at + 21)[0], struct.unpack_from("<H", data, at + 24)[0]
            e["modified"] = unix_time(stamp)
            ext, _ = extensions(data, at + 26, first)
            body = at + total
        elif level == 3:
            e["crc16"] = struct.unpack_from("<H", data, at + 21)[0]
            total, first = struct.unpack_from("<II", data, at + 24)
            e["modified"] = unix_time(stamp)
            ext, _ = extensions(data, at + 32, first, 4)
            body = at + total
        else:
            raise FormatError(f"header level {level}")
        _apply(e, ext)
        if method == b"-lhd-" or e["name"].endswith("/"):
            e["entry_type"] = "Directory"
            e["name"] = e["name"].rstrip("/") + "/"
        if attribute == 0x10 and e["size"] == 0 and method == b"-lhd-":
            e["entry_type"] = "Directory"
        e["data_offset"] = body
        if body + e["compressed_size"] > len(data):
            if not lenient:
                raise FormatError("payload is cut off")
            e.warn("SkippedEntry", "payload is cut off", size=len(data) - body)
        out.append(e)
        at = body + e["compressed_size"]
    if not out and not (data and data[0] == 0):
        raise FormatError("not an LZH archive")
    return out


def raw(data: bytes, e: Entry) -> bytes:
    body = data[e["data_offset"] : e["data_offset"] + e["compressed_size"]]
    if len(body) < e["compressed_size"]:
        raise FormatError("payload is cut off")
    return body


def content(data: bytes, e: Entry) -> bytes:
    if e["entry_type"] == "Directory":
        return b""
    if e["method"] not in lzh.METHODS:
        raise NotImplementedError(f"method {e['method']}")
    plain = lzh.decode(raw(data, e), e["method"], e["size"])
    found = CRC16.one(plain)
    if e["crc16"] is not None and found != e["crc16"]:
        from quarry.containers.zip import CrcMismatch

        raise CrcMismatch(e["crc16"], found, plain)
    return plain


class Writer:
    """Level-1 headers, or level 3 where there is metadata for extension headers."""

    def __init__(self) -> None:
        self.out = bytearray()

    def add(self, name: str, data: bytes = b"", method: str = "lh5", modified: datetime | None = None, level: int | None = None, dos_attributes: int = 0x20, **metadata: object) -> None:
        """metadata: comment, unix_mode, uid, gid, uname, gname, created, accessed."""
        if name.endswith("/"):
            packed, ident = b"", "lhd"
        else:
            packed, ident = (lzh.encode(data, method), method) if method != "lh0" else (data, "lh0")
            if len(packed) >= len(data):
                packed, ident = data, "lh0"
        self._put(name, packed, ident, CRC16.one(data), len(data), modified, level, dos_attributes, metadata)

    def add_raw(self, name: str, packed: bytes, method: str, crc16: int, size: int, modified: datetime | None = None, dos_attributes: int = 0x20, **metadata: object) -> None:
        self._put(name, packed, method, crc16, size, modified, None, dos_attributes, metadata)

    def _put(self, name: str, packed: bytes, method: str, crc16: int, size: int, modified: datetime | None, level: int | None, dos: int, meta: dict) -> None:
        meta = {k: v for k, v in meta.items() if v is not None}
        folder, _, base = name.rstrip("/").rpartition("/")
        if method == "lhd":
            folder, base = name.rstrip("/"), ""
        try:
            (name + str(meta.get("comment", ""))).encode("cp932")
            page = "cp932"
        except UnicodeEncodeError:
            page = "utf-8"
        ext = [(1, base.encode(page))]
        if folder:
            ext.append((2, folder.encode(page).replace(b"/", b"\xff") + b"\xff"))
        if page == "utf-8":
            ext.append((0x46, struct.pack("<I", UTF8)))
        level = level if level is not None else 3 if meta or max(size, len(packed)) >> 32 else 1
        if level == 1 and len(base.encode(page)) > 200:
            level = 3
        ticks = lambda t: (seconds_of(t) * 10_000_000 + 116444736000000000) if t else 0
        if "created" in meta or "accessed" in meta:
            ext.append((0x41, struct.pack("<QQQ", ticks(meta.get("created")), ticks(modified), ticks(meta.get("accessed")))))
        if "unix_mode" in meta:
            ext.append((0x50, struct.pack("<H", int(meta["unix_mode"]) & 0xFFFF)))
        if "uid" in meta or "gid" in meta:
            ext.append((0x51, struct.pack("<HH", int(meta.get("gid", 0)) & 0xFFFF, int(meta.get("uid", 0)) & 0xFFFF)))
        for key, kind in (("gname", 0x52), ("uname", 0x53), ("comment", 0x3F)):
            if meta.get(key):
                ext.append((kind, str(meta[key]).encode(page, "replace")))
        if max(size, len(packed)) >> 32:
            ext.append((0x42, struct.pack("<QQ", len(packed), size)))
        short = [min(v, 0xFFFFFFFF) for v in (len(packed), size)]
        ident = f"-{method}-".encode()
        if level == 1:
            date, time = to_dos(modified)
            chain = self._chain(ext[1:], 2)
            inner = ident + struct.pack("<IIHHBB", short[0] + len(chain) - 2, short[1], time, date, dos, 1) + bytes([len(ext[0][1])]) + ext[0][1] + struct.pack("<H", crc16) + b"U" + chain[:2]
            self.out += bytes([len(inner), sum(inner) & 255]) + inner + chain[2:]
        elif level == 2:
            chain = self._chain(ext, 2)
            total = 24 + len(chain)
            if total & 255 == 0:
                chain += b"\0"
                total += 1
            self.out += struct.pack("<H", total) + ident + struct.pack("<IIIBBHB", *short, max(0, seconds_of(modified)), dos, 2, crc16, ord("U")) + chain
        else:
            chain = self._chain(ext, 4)
            self.out += struct.pack("<H", 4) + ident + struct.pack("<IIIBBHBI", *short, max(0, seconds_of(modified)), dos, 3, crc16, ord("U"), 28 + len(chain)) + chain
        self.out += packed

    @staticmethod
    def _chain(ext: list[tuple[int, bytes]], width: int) -> bytes:
        out = b""
        for kind, body in ext:
            out += (len(body) + 1 + width).to_bytes(width, "little") + bytes([kind]) + body
        return out + b"\0" * width

    def finish(self) -> bytes:
        return bytes(self.out) + b"\0"
