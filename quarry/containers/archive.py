"""One reader and one writer over all formats: bytes <-> entry rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime

from quarry.codecs import registry
from quarry.containers import lzh, others, tar, zip as zipfmt
from quarry.containers.model import Entry, FormatError
from quarry.functions.detect import detect_bytes

SINGLE = registry.BY_FORMAT


def list_entries(data: bytes, archive: str = "", format: str | None = None, mode: str = "auto", lenient: bool = False) -> list[Entry]:
    """Entries without payloads. format: a label where magic bytes cannot tell (Brotli)."""
    label = format or detect_bytes(data)
    if label == "Unknown" and archive.endswith((".br", ".brotli")):
        label = "Brotli"
    read = {"ZIP": lambda: zipfmt.read(data, mode), "TAR": lambda: tar.read(data, lenient), "LZH": lambda: lzh.read(data, lenient), "7-Zip": lambda: others.read_7z(data), "CAB": lambda: others.read_cab(data), "ISO 9660": lambda: others.read_iso(data)}.get(label)
    if read is None:
        if label not in SINGLE:
            raise FormatError("unknown format")
        entries = others.read_stream(data, label, archive)
    else:
        entries = read()
    for e in entries:
        e["archive"] = archive
    return entries


def _status(error: Exception) -> str:
    if isinstance(error, zipfmt.CrcMismatch):
        return "CRC_MISMATCH"
    if isinstance(error, registry.LimitExceeded):
        return "LIMIT"
    if isinstance(error, NotImplementedError):
        return "UNSUPPORTED"
    if isinstance(error, PermissionError):
        return "PASSWORD"
    return "CORRUPT"


def _plain(data: bytes, entries: list[Entry], password: bytes | None, limit: int | None, max_ratio: float | None) -> Iterator[tuple[Entry, bytes | Exception]]:
    if entries and entries[0]["format"] in ("7-Zip", "CAB", "ISO 9660"):
        most = min([x for x in (limit, None if max_ratio is None else int(max_ratio * len(data))) if x is not None], default=None)
        yield from others.contents(data, entries, most)
        return
    for e in entries:
        packed = e["compressed_size"]
        most = min([x for x in (limit, None if max_ratio is None or not packed else int(max_ratio * packed)) if x is not None], default=None)
        try:
            if most is not None and e["size"] is not None and e["size"] > most and e["format"] in ("ZIP", "TAR", "LZH"):
                raise registry.LimitExceeded(f"an entry of {e['size']} bytes")
            if e["format"] == "ZIP":
                yield e, b"" if e["entry_type"] == "Directory" else zipfmt.content(data, e, password, most)
            elif e["format"] == "TAR":
                yield e, tar.content(data, e)
            elif e["format"] == "LZH":
                yield e, lzh.content(data, e)
            else:
                yield e, registry.decompress(SINGLE[e["format"]], data, limit=most)
        except Exception as error:  # whatever a damaged payload raises
            yield e, error


def rows(data: bytes | None, archive: str = "", **options: object) -> list[Entry]:
    """All of iter_rows at once."""
    return list(iter_rows(data, archive, **options))


def iter_rows(
    data: bytes | None, archive: str = "", format: str | None = None, mode: str = "auto", lenient: bool = False, content: bool = False, raw: bool = False, verify: bool = False,
    password: bytes | None = None, memory_limit: int | None = None, max_ratio: float | None = None, names: set[str] | None = None, prefixes: tuple[str, ...] = (),
) -> Iterator[Entry]:
    """Entry rows in order, each decoded when it is asked for. A damaged archive gives one row with its
    status; a damaged entry keeps its row with status and without content (with it, and a warning, where
    lenient). names and prefixes pick entries before anything is decoded. memory_limit (bytes of an
    entry, or of the folder that holds it) and max_ratio bound what a decoder makes: LIMIT."""
    if data is None:
        return
    try:
        entries = list_entries(data, archive, format, mode, lenient)
    except Exception as error:  # FormatError, or struct.error and the like of cut-off headers
        e = Entry(None, None, archive=archive, format=format or detect_bytes(data), entry_index=0, status="CORRUPT")
        yield e.warn("SkippedEntry", str(error), size=len(data))
        return
    if names is not None or prefixes:
        entries = [e for e in entries if (names is not None and e["name"] in names) or (prefixes and e["name"].startswith(prefixes))]
    plain_of = _plain(data, [e for e in entries if e["status"] == "OK"], password, memory_limit, max_ratio) if content or verify else iter(())
    for e in entries:
        if raw and e["format"] in ("ZIP", "TAR", "LZH"):
            at, n = e["data_offset"], e["compressed_size"] or 0
            e["raw_content"] = data[at : at + n] if at is not None else None
        if (content or verify) and e["status"] == "OK":
            _filled(*next(plain_of), lenient, content)
        yield e


def _filled(e: Entry, plain: bytes | Exception, lenient: bool, content: bool) -> None:
    """Puts the outcome of decoding into its row."""
    if isinstance(plain, Exception):
        e["status"] = _status(plain)
        if isinstance(plain, zipfmt.CrcMismatch):
            e.warn("CrcMismatch", str(plain), plain.expected, plain.computed)
            if lenient and content:
                e["content"] = plain.plain
        else:
            e.warn("SkippedEntry", str(plain))
        return
    if e["size"] is None:
        e["size"] = len(plain)
    if e["crc32"] is None and e["format"] != "ZIP" and e["entry_type"] == "File":
        e["crc32"] = zlib.crc32(plain)
    elif e["format"] in ("7-Zip", "GZIP") and e["crc32"] is not None and len(plain) == e["size"] and zlib.crc32(plain) != e["crc32"]:
        e["status"] = "CRC_MISMATCH"
        e.warn("CrcMismatch", "checksum mismatch", e["crc32"], zlib.crc32(plain))
    if content:
        e["content"] = plain


def pack(
    entries: Iterable[dict], format: str, level: int = 6, store_below: int = 0, password: bytes | None = None, encryption: str = "aes256", method: str = "Deflate",
) -> bytes:
    """Archive bytes of rows with name, content and, where they matter, entry_type, modified,
    attributes, method, comment, link_target and raw_content (taken as it is where it goes with
    method_id and crc). Rows are taken in order; names are made safe by the caller."""
    if format in ("gzip", "xz", "bzip2", "zstd", "lz4", "brotli", "snappy"):
        files = [e for e in entries if e.get("entry_type") != "Directory"]
        if len(files) != 1:
            raise ValueError("a single-stream format holds one file")
        data = files[0]["content"] or b""
        if format == "gzip":
            return registry.gzip_compress(data, level, files[0]["name"] or "", _seconds(files[0].get("modified")))
        return registry.compress(format, data, level)
    if format == "zip":
        z = zipfmt.Writer()
        for e in entries:
            a = e.get("attributes") or {}
            name, body = _dir_name(e), e.get("content") or b""
            common = {"modified": e.get("modified"), "mode": a.get("unix_mode"), "comment": e.get("comment") or ""}
            if e.get("raw_content") is not None and e.get("method_id") is not None and not e.get("encrypted"):
                z.add_raw(name, e["raw_content"], e["method_id"], e["crc32"], e["size"], **common)
                continue
            how = e.get("method") if e.get("method") in ("Stored", "Deflate", "LZMA", "Bzip2", "Zstd") else method
            z.add(name, body, "Stored" if len(body) < store_below else how, level, password=None if name.endswith("/") else password, encryption=encryption, **common)
        return z.finish()
    if format == "tar":
        t = tar.Writer()
        for e in entries:
            a = e.get("attributes") or {}
            t.add(e["name"], e.get("content") or b"", a.get("unix_mode"), e.get("modified"), a.get("uid") or 0, a.get("gid") or 0, e.get("uname") or "", e.get("gname") or "", e.get("entry_type") or "File", e.get("link_target") or "")
        return t.finish()
    if format == "lzh":
        w = lzh.Writer()
        for e in entries:
            a = e.get("attributes") or {}
            meta = {"comment": e.get("comment"), "unix_mode": a.get("unix_mode"), "uid": a.get("uid"), "gid": a.get("gid"), "uname": e.get("uname") or None, "gname": e.get("gname") or None, "created": e.get("created"), "accessed": e.get("accessed")}
            if e.get("raw_content") is not None and str(e.get("method")).startswith("lh"):
                w.add_raw(_dir_name(e), e["raw_content"], e["method"], e["crc16"], e["size"], e.get("modified"), **meta)
            else:
                how = e.get("method") if str(e.get("method")).startswith("lh") else "lh5"
                w.add(_dir_name(e), e.get("content") or b"", how if level else "lh0", e.get("modified"), **meta)
        return w.finish()
    raise ValueError(f"cannot write {format}")


def _dir_name(e: dict) -> str:
    return e["name"].rstrip("/") + "/" if e.get("entry_type") == "Directory" else e["name"]


def _seconds(when: datetime | None) -> int:
    from quarry.containers.model import seconds_of

    return max(0, seconds_of(when))


def recover(data: bytes, format: str | None = None, max_size: int = 64 << 20) -> list[dict]:
    """Rows of kind entry, skipped or warning from a damaged ZIP or TAR, whatever its directory says."""
    label = format or ("ZIP" if zipfmt.LOCAL in data else "TAR")
    found = list((zipfmt.recover if label == "ZIP" else tar.recover)(data, max_size))
    out = [{"kind": "entry", "start": f["offset"], "stop": f["end"], **{k: f[k] for k in ("name", "method", "size", "status", "content", "crc32")}} for f in found]
    at = 0
    tail = len(data)
    if label == "ZIP":
        stops = [i for s in (zipfmt.CENTRAL, zipfmt.END) if (i := data.find(s, found[-1]["end"] if found else 0)) >= 0]
        tail = min(stops, default=len(data))
    else:
        tail = len(data.rstrip(b"\0"))
    for f in [*found, {"offset": tail, "end": tail}]:
        if f["offset"] > at:
            out.append({"kind": "skipped", "start": at, "stop": f["offset"], "name": None, "method": None, "size": f["offset"] - at, "status": None, "content": None, "crc32": None})
        at = max(at, f["end"])
    return out
