"""TAR: ustar, PAX, GNU long names and sparse files; lenient reading, repair scan, and writing."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from quarry.containers.model import Entry, FormatError, seconds_of, unix_time

BLOCK, LOOK_AHEAD = 512, 16
TYPES = {"0": "File", "\0": "File", "7": "File", "1": "Hardlink", "2": "Symlink", "5": "Directory", "S": "File"}
SPARSE_CAP = 16 << 30


def checksum(block: bytes) -> int:
    return sum(block[:148]) + 8 * 32 + sum(block[156:512])


def number(field: bytes) -> int:
    """Octal, or base 256 where the top bit is set."""
    if field[:1] and field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    text = field.split(b"\0")[0].strip(b" \0")
    try:
        return int(text, 8) if text else 0
    except ValueError:
        raise FormatError("bad octal number") from None


def valid(block: bytes) -> bool:
    try:
        return len(block) == BLOCK and checksum(block) == number(block[148:156])
    except FormatError:
        return False


def pax_records(data: bytes) -> dict[str, str]:
    """``length key=value`` lines; the last of a key wins."""
    out, at = {}, 0
    while at < len(data):
        space = data.find(b" ", at)
        if space < 0 or not data[at:space].isdigit():
            break
        end = at + int(data[at:space])
        key, _, value = data[space + 1 : end - 1].partition(b"=")
        out[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        if end <= at:
            break
        at = end
    return out


def _text(field: bytes) -> str:
    return field.split(b"\0")[0].decode("utf-8", "replace")


def sparse_runs(data: bytes, at: int) -> tuple[list[tuple[int, int]], int, int]:
    """(runs, real size, blocks of continuation) of an old-GNU sparse header at byte at."""
    head = data[at : at + BLOCK]
    runs = _runs(head, 386, 4)
    more, blocks = head[482], 0
    while more and blocks < 4096:
        blocks += 1
        block = data[at + blocks * BLOCK : at + (blocks + 1) * BLOCK]
        if len(block) < BLOCK:
            raise FormatError("sparse map is cut off")
        runs += _runs(block, 0, 21)
        more = block[504]
    return runs, number(head[483:495]), blocks


def _runs(block: bytes, start: int, n: int) -> list[tuple[int, int]]:
    out = []
    for i in range(n):
        a, b = (block[start + 24 * i + k : start + 24 * i + k + 12] for k in (0, 12))
        if not a.strip(b"\0 ") and not b.strip(b"\0 "):
            continue
        out.append((number(a), number(b)))
    return out


def pax_sparse(attrs: dict[str, str]) -> tuple[list[tuple[int, int]], int] | None:
    if "GNU.sparse.map" not in attrs:
        return None
    n = [int(x) for x in attrs["GNU.sparse.map"].split(",") if x]
    return list(zip(n[::2], n[1::2], strict=True)), int(attrs.get("GNU.sparse.realsize") or attrs.get("GNU.sparse.size") or 0)


def check_sparse(runs: list[tuple[int, int]], real: int) -> None:
    end = 0
    for offset, length in sorted(runs):
        if length == 0 and offset == real:
            continue  # the closing run of a map
        if length <= 0 or offset < end or offset + length > real:
            raise FormatError("bad sparse map")
        end = offset + length
    if real > SPARSE_CAP:
        raise FormatError("sparse file is too large")


def fill_sparse(stored: bytes, runs: list[tuple[int, int]], real: int) -> bytes:
    out, at = bytearray(real), 0
    for offset, length in runs:
        out[offset : offset + length] = stored[at : at + length]
        at += length
    return bytes(out)


def read(data: bytes, lenient: bool = False) -> list[Entry]:
    """Entries in order. lenient: a broken header is looked past by up to 16 blocks, with a warning
    on the entry that follows; else it is an error."""
    out, at, glob, own, long_name, long_link, pending = [], 0, {}, {}, None, None, []
    while at + BLOCK <= len(data):
        head = data[at : at + BLOCK]
        if not head.strip(b"\0"):
            break
        if not valid(head):
            if not lenient:
                raise FormatError(f"bad header checksum at {at}")
            stored = _number_or(head[148:156])
            ahead = next((i for i in range(1, LOOK_AHEAD + 1) if valid(data[at + i * BLOCK : at + (i + 1) * BLOCK]) or data[at + i * BLOCK : at + (i + 1) * BLOCK] == b"\0" * BLOCK), None)
            if ahead is None:
                raise FormatError(f"no header within {LOOK_AHEAD} blocks after {at}")
            pending += [("HeaderChecksumMismatch", "header checksum mismatch", stored, checksum(head), None), ("ScannedForward", "scanned forward to the next header", None, None, ahead * BLOCK)]
            at += ahead * BLOCK
            continue
        kind, size = chr(head[156]), number(head[124:136])
        body = at + BLOCK
        follow = body + -(-size // BLOCK) * BLOCK
        payload = data[body : body + size]
        if kind in "xg":
            (glob if kind == "g" else own).update(pax_records(payload))
        elif kind == "L":
            long_name = _text(payload)
        elif kind == "K":
            long_link = _text(payload)
        else:
            attrs = glob | own
            prefix = _text(head[345:500]) if head[257:262] == b"ustar" and head[263:265] == b"00" else ""
            name = long_name or attrs.get("path") or (prefix + "/" if prefix else "") + _text(head[:100])
            size = int(attrs.get("size", size))
            follow = body + -(-size // BLOCK) * BLOCK
            stamp = float(attrs["mtime"]) if "mtime" in attrs else number(head[136:148])
            typ = "Directory" if name.endswith("/") and kind in "0\0" else TYPES.get(kind, "Unknown")
            e = Entry(
                name, typ, format="TAR", entry_index=len(out), name_raw=head[:100].split(b"\0")[0], size=size if typ == "File" else 0, compressed_size=size, method="Stored", method_id=0, modified=unix_time(stamp), data_offset=body,
                uname=attrs.get("uname") or _text(head[265:297]), gname=attrs.get("gname") or _text(head[297:329]), link_target=(long_link or attrs.get("linkpath") or _text(head[157:257])) if typ in ("Symlink", "Hardlink") else None,
                attributes={"unix_mode": number(head[100:108]) & 0o7777, "dos_attributes": None, "uid": int(attrs.get("uid", number(head[108:116]))), "gid": int(attrs.get("gid", number(head[116:124])))},
            )
            runs = None
            if kind == "S":
                runs, real, blocks = sparse_runs(data, at)
                e["data_offset"] = body = body + blocks * BLOCK
                follow = body + -(-size // BLOCK) * BLOCK
            elif found := pax_sparse(attrs):
                runs, real = found
                e["name"] = attrs.get("GNU.sparse.name", e["name"])
            if runs is not None:
                check_sparse(runs, real)
                e["_sparse"], e["size"] = (runs, real), real
            for w in pending:
                e.warn(*w)
            pending = []
            if follow > len(data) + BLOCK and not lenient and body + size > len(data):
                raise FormatError("payload is cut off")
            out.append(e)
            own, long_name, long_link = {}, None, None
        at = follow
    if not out and len(data) < BLOCK:
        raise FormatError("not a TAR archive")
    return out


def _number_or(field: bytes) -> int | None:
    try:
        return number(field)
    except FormatError:
        return None


def raw(data: bytes, e: Entry) -> bytes:
    body = data[e["data_offset"] : e["data_offset"] + e["compressed_size"]]
    if len(body) < e["compressed_size"]:
        raise FormatError("payload is cut off")
    return body


def content(data: bytes, e: Entry) -> bytes:
    if e["entry_type"] not in ("File", "Unknown"):
        return b""
    body = raw(data, e)
    return fill_sparse(body, *e["_sparse"]) if e.get("_sparse") else body


def recover(data: bytes, max_size: int = 64 << 20) -> Iterator[dict]:
    """Entries at every block that is a valid ustar header."""
    at = 0
    while at + BLOCK <= len(data):
        head = data[at : at + BLOCK]
        if head[257:262] != b"ustar" or not valid(head):
            at += BLOCK
            continue
        size = number(head[124:136])
        body, end = at + BLOCK, at + BLOCK + -(-size // BLOCK) * BLOCK
        whole = body + size <= len(data)
        if chr(head[156]) in "0\x005127":
            prefix = _text(head[345:500])
            keep = whole and size <= max_size
            yield {"name": (prefix + "/" if prefix else "") + _text(head[:100]), "offset": at, "end": min(end, len(data)), "method": "Stored", "size": size if keep else None, "status": "Recovered" if keep else "RawOnly", "content": data[body : body + size] if keep else None, "crc32": None}
        at = end if whole else at + BLOCK


class Writer:
    """ustar headers, with PAX records for what they cannot hold."""

    def __init__(self) -> None:
        self.out = bytearray()

    def add(self, name: str, data: bytes = b"", mode: int | None = None, modified: datetime | None = None, uid: int = 0, gid: int = 0, uname: str = "", gname: str = "", entry_type: str = "File", link: str = "") -> None:
        if entry_type == "Directory" and not name.endswith("/"):
            name += "/"
        kind = {"File": "0", "Hardlink": "1", "Symlink": "2", "Directory": "5"}[entry_type]
        data = data if kind == "0" else b""
        mode = mode if mode is not None else 0o755 if kind == "5" else 0o777 if kind == "2" else 0o644
        seconds, records = seconds_of(modified), {}
        prefix, base = self._split(name)
        if base is None:
            records["path"], prefix, base = name, "", name.encode()[:100].decode("utf-8", "ignore")
        if len(link.encode()) > 100:
            records["linkpath"] = link
        for key, value, bits in (("size", len(data), 33), ("uid", uid, 21), ("gid", gid, 21)):
            if value >> bits:
                records[key] = str(value)
        if records:
            body = b"".join(self._record(k, v) for k, v in records.items())
            self._block("PaxHeaders/" + base[:80], len(body), "x", 0o644, seconds, 0, 0, "", "", "", "")
            self._pad(body)
        self._block(base, min(len(data), (1 << 33) - 1), kind, mode, max(0, seconds), uid & 0o7777777, gid & 0o7777777, uname, gname, link, prefix)
        self._pad(data)

    @staticmethod
    def _split(name: str) -> tuple[str, str | None]:
        raw = name.encode()
        if len(raw) <= 100:
            return "", name
        cut = raw.rfind(b"/", 0, min(156, len(raw) - 1))
        while cut > 0:
            if len(raw) - cut - 1 <= 100 and cut <= 155:
                return raw[:cut].decode(), raw[cut + 1 :].decode()
            cut = raw.rfind(b"/", 0, cut)
        return "", None

    @staticmethod
    def _record(key: str, value: str) -> bytes:
        body = f" {key}={value}\n".encode()
        n = len(body) + 1
        while len(str(n)) + len(body) != n:
            n = len(str(n)) + len(body)
        return str(n).encode() + body

    def _pad(self, data: bytes) -> None:
        self.out += data + b"\0" * (-len(data) % BLOCK)

    def _block(self, name: str, size: int, kind: str, mode: int, seconds: int, uid: int, gid: int, uname: str, gname: str, link: str, prefix: str) -> None:
        field = lambda s, n: s.encode()[:n].ljust(n, b"\0")
        octal = lambda v, n: b"%0*o\0" % (n - 1, v)
        head = field(name, 100) + octal(mode, 8) + octal(uid, 8) + octal(gid, 8) + octal(size, 12) + octal(seconds, 12) + b" " * 8 + kind.encode() + field(link, 100) + b"ustar\x0000" + field(uname, 32) + field(gname, 32) + octal(0, 8) + octal(0, 8) + field(prefix, 155)
        head = head.ljust(BLOCK, b"\0")
        self.out += head[:148] + b"%06o\0 " % checksum(head) + head[156:]

    def finish(self) -> bytes:
        return bytes(self.out) + b"\0" * (2 * BLOCK)
