"""LZ4 blocks and frames with dictionaries, after the published block and frame formats."""

from __future__ import annotations

from quarry.codecs.checksums import xxh32

MAGIC = b"\x04\x22\x4d\x18"


class Truncated(ValueError):
    """More bytes are needed."""


WINDOW = 65535


def compress_block(data: bytes, dictionary: bytes = b"", step: int = 1) -> bytes:
    """Greedy matches over a table of four-byte keys; step > 1 skips positions (faster, larger)."""
    base = dictionary[-65536:]
    whole = base + data
    seen = {whole[i : i + 4]: i for i in range(max(0, len(base) - 3))}
    out, at, lit, end = bytearray(), len(base), len(base), len(whole)

    def token(literals: int, match: int | None, distance: int = 0) -> None:
        m = 0 if match is None else match - 4
        out.append(min(literals, 15) << 4 | min(m, 15))
        if literals >= 15:
            out.extend(b"\xff" * ((literals - 15) // 255))
            out.append((literals - 15) % 255)
        out.extend(whole[lit : lit + literals])
        if match is not None:
            out.extend(distance.to_bytes(2, "little"))
            if m >= 15:
                out.extend(b"\xff" * ((m - 15) // 255))
                out.append((m - 15) % 255)

    # the last match starts 12 bytes before the end at the latest, the last 5 bytes are literals
    while at < end - 12:
        key = whole[at : at + 4]
        where = seen.get(key)
        seen[key] = at
        if where is None or at - where > WINDOW:
            at += step
            continue
        n, most = 4, end - 5 - at
        while n < most and whole[where + n] == whole[at + n]:
            n += 1
        token(at - lit, n, at - where)
        at += n
        lit = at
    token(end - lit, None)
    return bytes(out)


def compress_block_hc(data: bytes, level: int = 9, dictionary: bytes = b"") -> bytes:
    """Longest matches over chains whose depth doubles with each level (1 to 12), put off by one
    position where the next one has a longer match."""
    base = dictionary[-65536:]
    whole, depth = base + data, 1 << max(1, min(12, level)) - 1
    chains: dict[bytes, list[int]] = {}
    end, at, lit, out = len(whole), len(base), len(base), bytearray()
    most = end - 5
    filled = 0

    def fill(upto: int) -> None:
        nonlocal filled
        while filled < min(upto, end - 3):
            chains.setdefault(whole[filled : filled + 4], []).append(filled)
            filled += 1

    def find(i: int) -> tuple[int, int]:
        fill(i)
        best = where = 0
        for j in reversed(chains.get(whole[i : i + 4], [])[-depth:]):
            if i - j > WINDOW:
                break
            n = 4
            while i + n < most and whole[j + n] == whole[i + n]:
                n += 1
            if n > best and i + n <= most:
                best, where = n, j
        return best, where

    while at < end - 12:
        n, where = find(at)
        if n < 4:
            at += 1
            continue
        if at + 1 < end - 12 and find(at + 1)[0] > n + 1:
            at += 1
            continue
        _sequence(out, whole[lit:at], n, at - where)
        at += n
        lit = at
    _sequence(out, whole[lit:end], None, 0)
    return bytes(out)


def _sequence(out: bytearray, literals: bytes, match: int | None, distance: int) -> None:
    n, m = len(literals), 0 if match is None else match - 4
    out.append(min(n, 15) << 4 | min(m, 15))
    for value in (n, None, m if match is not None else 0):
        if value is None:
            out += literals
            if match is not None:
                out += distance.to_bytes(2, "little")
        elif value >= 15:
            out += b"\xff" * ((value - 15) // 255) + bytes([(value - 15) % 255])


def decompress_block(data: bytes, limit: int, dictionary: bytes = b"") -> bytes:
    out = bytearray(dictionary[-65536:])
    base, at = len(out), 0

    def more(n: int, at: int) -> tuple[int, int]:
        while n >= 15:
            b = data[at]
            at += 1
            n += b
            if b < 255:
                break
        return n, at

    try:
        while at < len(data):
            tag = data[at]
            n, at = more(tag >> 4, at + 1) if tag >> 4 == 15 else (tag >> 4, at + 1)
            if at + n > len(data):
                raise ValueError("truncated literals")
            out += data[at : at + n]
            at += n
            if at >= len(data):
                break
            distance = int.from_bytes(data[at : at + 2], "little")
            n, at = more(tag & 15, at + 2) if tag & 15 == 15 else (tag & 15, at + 2)
            n += 4
            start = len(out) - distance
            if distance == 0 or start < 0:
                raise ValueError("bad match distance")
            out += out[start : start + n] if distance >= n else (bytes(out[start:]) * (n // distance + 1))[:n]
            if len(out) - base > limit:
                raise ValueError("output limit exceeded")
    except IndexError:
        raise ValueError("truncated block") from None
    if len(out) - base > limit:
        raise ValueError("output limit exceeded")
    return bytes(out[base:])


def compress_frame(data: bytes, dictionary: bytes = b"", dict_id: int | None = None, block: int = 1 << 22, with_size: bool = True, block_checksum: bool = False) -> bytes:
    """Independent blocks and a content checksum; blocks that do not shrink are stored."""
    if dictionary and dict_id is None:
        dict_id = xxh32(dictionary)
    flags = 0x40 | 0x20 | 0x10 * block_checksum | 0x08 * with_size | 0x04 | 0x01 * (dict_id is not None)
    size_id = next(i for i in (4, 5, 6, 7) if 1 << (8 + 2 * i) >= block)
    head = bytes([flags, size_id << 4]) + (len(data).to_bytes(8, "little") if with_size else b"") + (dict_id.to_bytes(4, "little") if dict_id is not None else b"")
    out = [MAGIC, head, bytes([xxh32(head) >> 8 & 255])]
    for i in range(0, len(data), block):
        piece = data[i : i + block]
        small = compress_block(piece, dictionary)
        body, stored = (small, 0) if len(small) < len(piece) else (piece, 0x80000000)
        out += [(len(body) | stored).to_bytes(4, "little"), body]
        if block_checksum:
            out.append(xxh32(body).to_bytes(4, "little"))
    return b"".join([*out, b"\0\0\0\0", xxh32(data).to_bytes(4, "little")])


def frame_header(data: bytes) -> dict:
    """Flags, sizes and the dictionary id of a frame, and where its blocks begin."""
    if data[:4] != MAGIC[: len(data)]:
        raise ValueError("not an LZ4 frame")
    if len(data) < 7 or len(data) < 7 + 8 * bool(data[4] & 8) + 4 * (data[4] & 1):
        raise Truncated("truncated header")
    flags, at = data[4], 6
    if flags >> 6 != 1:
        raise ValueError("unknown frame version")
    out = {"independent": bool(flags & 0x20), "block_checksum": bool(flags & 0x10), "content_checksum": bool(flags & 4), "block": 1 << (8 + 2 * (data[5] >> 4 & 7)), "size": None, "dict_id": None}
    if flags & 8:
        out["size"] = int.from_bytes(data[at : at + 8], "little")
        at += 8
    if flags & 1:
        out["dict_id"] = int.from_bytes(data[at : at + 4], "little")
        at += 4
    if at >= len(data) or data[at] != xxh32(data[4:at]) >> 8 & 255:
        raise ValueError("header checksum mismatch")
    return out | {"at": at + 1}


def decompress_frame(data: bytes, dictionary: bytes = b"", limit: int | None = None) -> bytes:
    """All frames; skippable ones drop out."""
    out = []
    while len(data) >= 4:
        magic = int.from_bytes(data[:4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            data = data[8 + int.from_bytes(data[4:8], "little") :]
            continue
        if data[:4] != MAGIC:
            break
        piece, used = one_frame(data, dictionary, limit)
        out.append(piece)
        data = data[used:]
    if not out:
        raise ValueError("not an LZ4 frame")
    return b"".join(out)


def one_frame(data: bytes, dictionary: bytes = b"", limit: int | None = None) -> tuple[bytes, int]:
    """(plain bytes, length) of the frame in front."""
    h = frame_header(data)
    if h["dict_id"] is not None and (not dictionary or xxh32(dictionary) != h["dict_id"]):
        raise ValueError("another dictionary is needed")
    at, out = h["at"], bytearray()
    while True:
        if at + 4 > len(data):
            raise Truncated("truncated frame")
        size = int.from_bytes(data[at : at + 4], "little")
        at += 4
        if size == 0:
            break
        stored, size = size >> 31, size & 0x7FFFFFFF
        body = data[at : at + size]
        if len(body) < size:
            raise Truncated("truncated block")
        at += size
        if h["block_checksum"]:
            if at + 4 > len(data):
                raise Truncated("truncated frame")
            if int.from_bytes(data[at : at + 4], "little") != xxh32(body):
                raise ValueError("block checksum mismatch")
            at += 4
        history = b"" if h["independent"] and not h["dict_id"] and not dictionary else dictionary if h["independent"] else (dictionary + bytes(out))[-65536:]
        if stored:
            out += body
        elif history:
            out += decompress_block(body, h["block"], history)
        else:
            out += decompress_block(body, h["block"])
        if limit is not None and len(out) > limit:
            raise ValueError("output limit exceeded")
    if h["content_checksum"]:
        if at + 4 > len(data):
            raise Truncated("truncated frame")
        if int.from_bytes(data[at : at + 4], "little") != xxh32(bytes(out)):
            raise ValueError("content checksum mismatch")
        at += 4
    if h["size"] is not None and h["size"] != len(out):
        raise ValueError("wrong content size")
    return bytes(out), at


def dictionary(data: bytes) -> tuple[bytes, int]:
    """(content, id): the last 64 KiB, named by its XXH32."""
    kept = data[-65536:]
    return kept, xxh32(kept)
