"""Readers for 7z, CAB, ISO 9660 and single-stream files."""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator

from quarry.codecs import lz4, registry, snappy
from quarry.containers.model import Entry, FormatError, dos_time, filetime, unix_time

# ---- 7z ----


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise FormatError("7z header is cut off")
        self.at += n
        return out

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        first, mask, value = self.byte(), 0x80, 0
        for i in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << (8 * i)
            value |= self.byte() << (8 * i)
            mask >>= 1
        return value

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[i // 8] >> (7 - i % 8) & 1) for i in range(n)]

    def maybe_bits(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


def _digests(b: _Bytes, n: int) -> list[int | None]:
    return [struct.unpack("<I", b.take(4))[0] if known else None for known in b.maybe_bits(n)]


def _streams(b: _Bytes) -> dict:
    """Pack positions, folders with their coders, and what each folder holds."""
    out: dict = {"pack_at": 0, "pack_sizes": [], "folders": [], "parts": []}
    kind = b.byte()
    if kind == 6:
        out["pack_at"], n = b.number(), b.number()
        while (kind := b.byte()) != 0:
            if kind == 9:
                out["pack_sizes"] = [b.number() for _ in range(n)]
            elif kind == 10:
                _digests(b, n)
        kind = b.byte()
    if kind == 7:
        if b.byte() != 11:
            raise FormatError("no folders")
        n = b.number()
        if b.byte():
            raise FormatError("external folders")
        for _ in range(n):
            coders = []
            ins = outs = 0
            for _ in range(b.number()):
                flags = b.byte()
                ident = b.take(flags & 15)
                i, o = (b.number(), b.number()) if flags & 16 else (1, 1)
                coders.append((ident, b.take(b.number()) if flags & 32 else b""))
                ins, outs = ins + i, outs + o
            binds = [(b.number(), b.number()) for _ in range(outs - 1)]
            packed = ins - len(binds)
            if packed > 1:
                for _ in range(packed):
                    b.number()
            out["folders"].append({"coders": coders, "outs": outs, "packed": packed, "crc": None, "binds": binds})
        if b.byte() != 12:
            raise FormatError("no folder sizes")
        for f in out["folders"]:
            f["sizes"] = [b.number() for _ in range(f["outs"])]
            bound = {o for _, o in f["binds"]}
            f["size"] = next(s for i, s in enumerate(f["sizes"]) if i not in bound)
        kind = b.byte()
        if kind == 10:
            for f, crc in zip(out["folders"], _digests(b, n), strict=True):
                f["crc"] = crc
            kind = b.byte()
        kind = b.byte()
    counts = [1] * len(out["folders"])
    if kind == 8:
        kind = b.byte()
        if kind == 13:
            counts = [b.number() for _ in counts]
            kind = b.byte()
        sizes = []
        for f, n in zip(out["folders"], counts, strict=True):
            own = [b.number() for _ in range(n - 1)] if kind == 9 else []
            sizes.append(own + [f["size"] - sum(own)] if n else [])
        if kind == 9:
            kind = b.byte()
        crcs: list[int | None] = []
        if kind == 10:
            open_ = sum(n for f, n in zip(out["folders"], counts, strict=True) if not (n == 1 and f["crc"] is not None))
            crcs = _digests(b, open_)
            kind = b.byte()
        it = iter(crcs)
        out["parts"] = [[(s, f["crc"] if n == 1 and f["crc"] is not None else next(it, None)) for s in own] for f, n, own in zip(out["folders"], counts, sizes, strict=True)]
        while kind:
            kind = b.byte()
        b.byte()  # the end of the streams
    else:
        out["parts"] = [[(f["size"], f["crc"])] for f in out["folders"]]
    return out


def _un7z(data: bytes, s: dict, index: int, limit: int | None = None) -> bytes:
    """Decodes a whole folder. Only one coder is supported: copy, LZMA or LZMA2."""
    f, first = s["folders"][index], sum(x["packed"] for x in s["folders"][:index])
    at = 32 + s["pack_at"] + sum(s["pack_sizes"][:first])
    body = data[at : at + s["pack_sizes"][first]]
    if len(body) < s["pack_sizes"][first]:
        raise FormatError("packed stream is cut off")
    if len(f["coders"]) != 1:
        raise NotImplementedError("chains of coders")
    if limit is not None and f["size"] > limit:
        raise registry.LimitExceeded(f"a folder of {f['size']} bytes")
    ident, props = f["coders"][0]
    if ident == b"\0":
        return body
    if ident == b"\3\1\1":
        return registry.lzma_raw_props(body, props[0], struct.unpack_from("<I", props, 1)[0], f["size"])
    if ident == b"\x21":
        p = props[0]
        return registry.lzma2_decompress(body, 0xFFFFFFFF if p >= 40 else (2 | p & 1) << (p // 2 + 11))
    raise NotImplementedError(f"coder {ident.hex()}")


_7Z_METHODS = {b"\0": "Stored", b"\3\1\1": "LZMA", b"\x21": "LZMA2"}


def read_7z(data: bytes) -> list[Entry]:
    if data[:6] != b"7z\xbc\xaf\x27\x1c" or len(data) < 32:
        raise FormatError("not a 7z archive")
    at, size, crc = struct.unpack_from("<QQI", data, 12)
    head = data[32 + at : 32 + at + size]
    if len(head) < size or zlib.crc32(head) != crc:
        raise FormatError("7z header is damaged")
    if not head:
        return []
    b = _Bytes(head)
    kind = b.byte()
    if kind == 0x17:
        b = _Bytes(_un7z(data, _streams(b), 0))
        kind = b.byte()
    if kind != 1:
        raise FormatError("no 7z header")
    s: dict = {"folders": [], "parts": [], "pack_at": 0, "pack_sizes": []}
    out: list[Entry] = []
    while (kind := b.byte()) != 0:
        if kind == 2:
            while b.byte():
                b.take(b.number())
        elif kind == 4:
            s = _streams(b)
        elif kind == 5:
            out = _files(b)
    parts = [(folder, i, *p) for folder, own in enumerate(s["parts"]) for i, p in enumerate(own)]
    it, offset = iter(parts), {}
    for e in out:
        if e.pop("_empty"):
            continue
        folder, i, n, crc = next(it)
        e["folder_index"], e["size"], e["crc32"] = folder, n, crc
        e["_offset"] = offset.get(folder, 0)
        offset[folder] = e["_offset"] + n
        coder = s["folders"][folder]["coders"][0][0]
        e["method"] = _7Z_METHODS.get(coder, "Unknown")
        first = sum(x["packed"] for x in s["folders"][:folder])
        e["compressed_size"] = s["pack_sizes"][first] if i == 0 else 0
        e["_streams"] = s
    return out


def _files(b: _Bytes) -> list[Entry]:
    n = b.number()
    out = [Entry("", format="7-Zip", entry_index=i, size=0, compressed_size=0, method="Stored", _empty=False, attributes={"unix_mode": None, "dos_attributes": None, "uid": None, "gid": None}) for i in range(n)]
    hollow: list[int] = []
    while (kind := b.byte()) != 0:
        part = _Bytes(b.take(b.number()))
        if kind == 14:
            hollow = [i for i, x in enumerate(part.bits(n)) if x]
            for i in hollow:
                out[i]["_empty"], out[i]["entry_type"] = True, "Directory"
        elif kind == 15:
            for i, x in zip(hollow, part.bits(len(hollow)), strict=True):
                if x:
                    out[i]["entry_type"] = "File"
        elif kind == 17:
            part.byte()
            names = part.data[1:].decode("utf-16-le", "replace").split("\0")
            for e, name in zip(out, names, strict=False):
                e["name"], e["name_raw"] = name, name.encode("utf-16-le", "replace")
        elif kind in (18, 19, 20):
            known = part.maybe_bits(n)
            part.byte()
            for e, k in zip(out, known, strict=True):
                if k:
                    e[{18: "created", 19: "accessed", 20: "modified"}[kind]] = filetime(struct.unpack("<Q", part.take(8))[0])
        elif kind == 21:
            known = part.maybe_bits(n)
            part.byte()
            for e, k in zip(out, known, strict=True):
                if k:
                    v = struct.unpack("<I", part.take(4))[0]
                    e["attributes"] = {"unix_mode": v >> 16 & 0o7777 if v & 0x8000 else None, "dos_attributes": v & 255, "uid": None, "gid": None}
                    if v & 0x10:
                        e["entry_type"] = "Directory"
    return out


# ---- CAB ----


def read_cab(data: bytes) -> list[Entry]:
    if data[:4] != b"MSCF" or len(data) < 36:
        raise FormatError("not a cabinet")
    files_at, n_folders, n_files, flags = struct.unpack_from("<I6xHHH", data, 16)
    at, header_extra, folder_extra, data_extra = 36, 0, 0, 0
    if flags & 4:
        header_extra, folder_extra, data_extra = struct.unpack_from("<HBB", data, 36)
        at = 40 + header_extra
    for bit in (1, 2):
        if flags & bit:
            for _ in range(2):
                at = data.index(b"\0", at) + 1
    folders = []
    for _ in range(n_folders):
        folders.append((*struct.unpack_from("<IHH", data, at), data_extra))
        at += 8 + folder_extra
    out, at = [], files_at
    for i in range(n_files):
        size, offset, folder, date, time, attr = struct.unpack_from("<IIHHHH", data, at)
        end = data.index(b"\0", at + 16)
        raw = data[at + 16 : end]
        name = raw.decode("utf-8" if attr & 0x80 else "cp1252", "replace").replace("\\", "/")
        method = {0: "Stored", 1: "Deflate"}.get(folders[folder][2] & 15, "Unknown") if folder < n_folders else "Unknown"
        out.append(Entry(name, format="CAB", entry_index=i, name_raw=raw, size=size, compressed_size=size, method=method, method_id=folders[folder][2] if folder < n_folders else None, modified=dos_time(date, time), folder_index=folder, _offset=offset, _folders=folders, attributes={"unix_mode": None, "dos_attributes": attr & 0x27, "uid": None, "gid": None}))
        at = end + 1
    return out


def cab_checksum(data: bytes, seed: int = 0) -> int:
    whole = len(data) & ~3
    for (v,) in struct.iter_unpack("<I", data[:whole]):
        seed ^= v
    tail = data[whole:]
    return seed ^ int.from_bytes(tail, "big") if tail else seed


def _uncab(data: bytes, folder: tuple, limit: int | None = None) -> bytes:
    at, blocks, kind, extra = folder
    if kind & 15 not in (0, 1):
        raise NotImplementedError(f"cabinet compression {kind & 15}")
    out, history, made = [], b"", 0
    for _ in range(blocks):
        check, packed, size = struct.unpack_from("<IHH", data, at)
        body = data[at + 8 + extra : at + 8 + extra + packed]
        if len(body) < packed:
            raise FormatError("cabinet is cut off")
        made += size
        if limit is not None and made > limit:
            raise registry.LimitExceeded(f"a folder of more than {limit} bytes")
        if check and cab_checksum(data[at + 4 : at + 8], cab_checksum(body)) != check:
            raise FormatError("cabinet block checksum mismatch")
        if kind & 15:
            if body[:2] != b"CK":
                raise FormatError("no MSZIP block")
            body = registry.inflate(body[2:], history) if history else registry.inflate(body[2:])
            history = (history + body)[-32768:]
        if len(body) != size:
            raise FormatError("wrong block size")
        out.append(body)
        at += 8 + extra + packed
    return b"".join(out)


# ---- ISO 9660 ----


def read_iso(data: bytes) -> list[Entry]:
    """Joliet names where there is a Joliet volume. Plain names keep their case, without version."""
    root = joliet = None
    for lba in range(16, 16 + 64):
        sector = data[lba * 2048 : lba * 2048 + 2048]
        if len(sector) < 2048 or sector[1:6] != b"CD001" or sector[0] == 255:
            break
        if sector[0] == 1:
            root = sector[156:190]
        elif sector[0] == 2 and sector[88:91] in (b"%/@", b"%/C", b"%/E"):
            joliet = sector[156:190]
    if root is None and joliet is None:
        raise FormatError("not an ISO 9660 image")
    record = joliet or root
    out: list[Entry] = []
    seen: set[int] = set()

    def walk(at: int, size: int, prefix: str) -> None:
        if at in seen:
            return
        seen.add(at)
        block, pos = data[at : at + size], 0
        while pos < len(block):
            n = block[pos]
            if n == 0:
                pos = (pos // 2048 + 1) * 2048
                continue
            r = block[pos : pos + n]
            pos += n
            if len(r) < 34:
                break
            raw = r[33 : 33 + r[32]]
            if raw in (b"\0", b"\1"):
                continue
            lba, length, is_dir = struct.unpack_from("<I", r, 2)[0], struct.unpack_from("<I", r, 10)[0], bool(r[25] & 2)
            name = raw.decode("utf-16-be", "replace") if joliet else raw.decode("latin1")
            name = name.split(";")[0].rstrip(".") if not is_dir else name
            y, m, d, hh, mm, ss = r[18:24]
            stamp = dos_time((max(0, y - 80) & 127) << 9 | m << 5 | d, hh << 11 | mm << 5 | ss // 2)
            out.append(Entry(prefix + name + "/" * is_dir, "Directory" if is_dir else "File", format="ISO 9660", entry_index=len(out), name_raw=raw, size=0 if is_dir else length, compressed_size=0 if is_dir else length, method="Stored", method_id=0, modified=stamp, data_offset=lba * 2048, attributes={"unix_mode": None, "dos_attributes": 2 * (r[25] & 1), "uid": None, "gid": None}))
            if is_dir:
                walk(lba * 2048, length, prefix + name + "/")

    walk(struct.unpack_from("<I", record, 2)[0] * 2048, struct.unpack_from("<I", record, 10)[0], "")
    return out


# ---- single streams ----


def gzip_header(data: bytes) -> dict:
    """Optional fields of the first member and where its payload begins."""
    if data[:3] != b"\x1f\x8b\x08" or len(data) < 18:
        raise FormatError("not a gzip stream")
    flags, mtime, xfl, system = struct.unpack_from("<BIBB", data, 3)
    at, out = 10, {"mtime": mtime, "xfl": xfl, "os": system, "name": None, "comment": None, "extra": b""}
    if flags & 4:
        n = struct.unpack_from("<H", data, at)[0]
        out["extra"], at = data[at + 2 : at + 2 + n], at + 2 + n
    for bit, key in ((8, "name"), (16, "comment")):
        if flags & bit:
            end = data.index(b"\0", at)
            out[key], at = data[at:end].decode("latin1"), end + 1
    if flags & 2:
        if struct.unpack_from("<H", data, at)[0] != zlib.crc32(data[:at]) & 0xFFFF:
            raise FormatError("gzip header checksum mismatch")
        at += 2
    return out | {"at": at}


def read_stream(data: bytes, label: str, name: str) -> list[Entry]:
    """The one entry of a compressed file; its size is null where the header does not state it."""
    suffixes = (".gz", ".xz", ".bz2", ".zst", ".lz4", ".br", ".sz", ".snappy", ".tgz")
    base = name.rsplit("/", 1)[-1]
    base = next((base[: -len(s)] for s in suffixes if base.endswith(s)), base) or "data"
    method = {"GZIP": "Deflate", "XZ": "LZMA2", "Bzip2": "Bzip2", "Zstandard": "Zstd"}.get(label, "Unknown")
    e = Entry(base, format=label, entry_index=0, compressed_size=len(data), method=method, data_offset=0)
    if label == "GZIP":
        h = gzip_header(data)
        e["name"], e["comment"], e["extra"] = h["name"] or base, h["comment"], h["extra"]
        e["modified"] = unix_time(h["mtime"]) if h["mtime"] else None
        e["crc32"], e["size"] = struct.unpack("<II", data[-8:])
    elif label == "XZ":
        if len(data) < 24 or data[:6] != b"\xfd7zXZ\0":
            raise FormatError("not an XZ stream")
    elif label == "LZ4":
        e["size"] = lz4.frame_header(data)["size"]
    elif label == "Zstandard":
        e["size"] = zstd_size(data)
    elif label == "Snappy":
        if not data.startswith(snappy.STREAM_ID):
            raise FormatError("no Snappy stream identifier")
    elif label == "Bzip2":
        if not (data[:3] == b"BZh" and data[3:4] in b"123456789"):
            raise FormatError("not a bzip2 stream")
    return [e]


def zstd_size(data: bytes) -> int | None:
    if len(data) < 6 or data[:4] != b"\x28\xb5\x2f\xfd":
        raise FormatError("not a Zstandard frame")
    d = data[4]
    at = 5 + (not d & 32) + (0, 1, 2, 4)[d & 3]
    n = (1 if d & 32 else 0, 2, 4, 8)[d >> 6]
    return None if not n else int.from_bytes(data[at : at + n], "little") + 256 * (n == 2)


def xz_check(data: bytes) -> str:
    return {0: "none", 1: "crc32", 4: "crc64", 10: "sha256"}.get(data[7] & 15, "unknown")


def contents(data: bytes, entries: list[Entry], limit: int | None = None) -> Iterator[tuple[Entry, bytes | Exception]]:
    """Plain bytes of 7z, CAB and ISO entries; each folder is decoded once, if it keeps to the limit."""
    done: dict[tuple, bytes | Exception] = {}
    for e in entries:
        if e["entry_type"] == "Directory" or e["format"] == "7-Zip" and e["folder_index"] is None:
            yield e, b""
            continue
        if e["format"] == "ISO 9660":
            body = data[e["data_offset"] : e["data_offset"] + e["size"]]
            yield e, body if len(body) == e["size"] else FormatError("payload is cut off")
            continue
        key = (e["format"], e["folder_index"])
        if key not in done:
            try:
                done = {key: _un7z(data, e["_streams"], e["folder_index"], limit) if e["format"] == "7-Zip" else _uncab(data, e["_folders"][e["folder_index"]], limit)}  # one folder is held
            except (ValueError, NotImplementedError, lzma.LZMAError, zlib.error, IndexError) as error:
                done = {key: error}
        whole = done[key]
        yield e, whole if isinstance(whole, Exception) else whole[e["_offset"] : e["_offset"] + e["size"]]
