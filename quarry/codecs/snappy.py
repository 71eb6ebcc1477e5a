"""Snappy blocks (library kernel), the framing format, and blocks and frames with a dictionary."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa

from quarry.codecs.checksums import CRC32C, mask

STREAM_ID = b"\xff\x06\x00\x00sNaPpY"
CHUNK = 65536
DICT_ID = b"QUARRY"  # content of the private chunk that names the dictionary


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 28:
            raise ValueError("bad length header")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def compress(data: bytes) -> bytes:
    return pa.compress(data, "snappy", asbytes=True) if data else b"\0"


def decompress(data: bytes) -> bytes:
    size, at = read_varint(data)
    if size == 0 and at == len(data):
        return b""
    return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)


def _chunk(kind: int, body: bytes) -> bytes:
    return bytes([kind]) + len(body).to_bytes(3, "little") + body


def _sum(data: bytes) -> bytes:
    return mask(CRC32C.one(data)).to_bytes(4, "little")


def frame(data: bytes) -> bytes:
    """Stream identifier, then chunks of at most 64 KiB, compressed where that is shorter."""
    out = [STREAM_ID]
    pieces = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    sums = CRC32C.many(pieces) if pieces else []
    for piece, crc in zip(pieces, sums, strict=True):
        small = compress(piece)
        head = mask(int(crc)).to_bytes(4, "little")
        out.append(_chunk(0, head + small) if len(small) < len(piece) else _chunk(1, head + piece))
    return b"".join(out)


def chunks(data: bytes):
    """(kind, body) of every chunk."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("truncated chunk header")
        size = int.from_bytes(data[at + 1 : at + 4], "little")
        if at + 4 + size > len(data):
            raise ValueError("truncated chunk")
        yield data[at], data[at + 4 : at + 4 + size]
        at += 4 + size


def stated_length(data: bytes) -> int:
    """Plain bytes that the chunks of a framed stream state."""
    return sum(len(body) - 4 if kind == 1 else read_varint(body, 4)[0] for kind, body in chunks(data) if kind in (0, 1))


def unframe(data: bytes, dictionary: bytes | None = None) -> bytes:
    if not data.startswith(STREAM_ID):
        raise ValueError("no stream identifier")
    out: list[bytes] = []
    wanted: list[int] = []
    named = None
    for kind, body in chunks(data):
        if kind in (0, 1):
            if named is not None and dictionary is None:
                raise ValueError("a dictionary is needed")
            piece = body[4:] if kind == 1 else decompress(body[4:]) if named is None else decompress_with_dictionary(body[4:], dictionary)
            wanted.append(int.from_bytes(body[:4], "little"))
            out.append(piece)
        elif kind == 0xFE and body.startswith(DICT_ID):
            named = int.from_bytes(body[len(DICT_ID) : len(DICT_ID) + 4], "little")
            if dictionary is not None and CRC32C.one(dictionary) != named:
                raise ValueError("another dictionary is needed")
        elif 2 <= kind <= 0x7F:
            raise ValueError(f"unskippable chunk {kind:#x}")
    if out and [mask(int(c)) for c in CRC32C.many(out)] != wanted:
        raise ValueError("checksum mismatch")
    return b"".join(out)


def _literal(data: bytes) -> bytes:
    """Literals of a block, of at most 64 KiB each."""
    out = []
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        n = len(part) - 1
        out += [bytes([n << 2]) if n < 60 else bytes([60 << 2, n]) if n < 256 else b"\xf4" + n.to_bytes(2, "little"), part]
    return b"".join(out)


def _behind(block: bytes, skip: int) -> bytes:
    """What the elements of a block make behind its first ``skip`` bytes, as elements: distances are relative,
    so that they hold as long as these bytes are in front."""
    _, at = read_varint(block)
    while skip:
        tag, kind = block[at], block[at] & 3
        if kind == 0:
            n, body = (tag >> 2) + 1, at + 1
            if n > 60:
                body += n - 60
                n = int.from_bytes(block[at + 1 : body], "little") + 1
            if n > skip:
                return _literal(block[body + skip : body + n]) + block[body + n :]
            at = body + n
        else:
            n = (tag >> 2 & 7) + 4 if kind == 1 else (tag >> 2) + 1
            stop = at + (2, 3, 5)[kind - 1]
            if n > skip:
                far = (tag >> 5) << 8 | block[at + 1] if kind == 1 else int.from_bytes(block[at + 1 : stop], "little")
                return bytes([n - skip - 1 << 2 | 2]) + far.to_bytes(2, "little") + block[stop:]
            at = stop
        skip -= n
    return block[at:]


@lru_cache(16)
def _noise(data: bytes) -> bool:
    return len(data) > 256 and 8 * len(compress(data)) > 7 * len(data)


def compress_with_dictionary(data: bytes, dictionary: bytes) -> bytes:
    """A block whose copies may reach into the dictionary put in front of the data."""
    base = dictionary[-CHUNK:]
    if not data:
        return varint(0)
    small = None
    if len(base) + len(data) <= CHUNK and not _noise(base):  # the library looks back so far
        small = varint(len(data)) + _behind(compress(base + data), len(base))
        if 8 * len(small) <= 7 * len(data):
            return small
    # the library skips over bytes like noise, in the dictionary too; this looks at every place
    whole, seen, at, lit = base + data, {}, len(base), len(base)
    for i in range(0, max(0, len(base) - 3)):
        seen[whole[i : i + 4]] = i
    out = bytearray(varint(len(data)))

    while at + 4 <= len(whole):
        key = whole[at : at + 4]
        where = seen.get(key)
        seen[key] = at
        if where is None or at - where > 65535:
            at += 1
            continue
        n = 4
        while at + n < len(whole) and n < 64 and whole[where + n] == whole[at + n]:
            n += 1
        out += _literal(whole[lit:at])
        out.append((n - 1) << 2 | 2)
        out.extend((at - where).to_bytes(2, "little"))
        at += n
        lit = at
    out += _literal(whole[lit:])
    return bytes(out) if small is None or len(out) < len(small) else small


def decompress_with_dictionary(data: bytes, dictionary: bytes) -> bytes:
    """The block behind the dictionary, which is put in front of it as a literal."""
    size, at = read_varint(data)
    base = dictionary[-CHUNK:]
    if size > 22 * len(data):  # a copy of 64 bytes takes 3
        raise ValueError("wrong length")
    try:
        return decompress(varint(len(base) + size) + _literal(base) + data[at:])[len(base) :]
    except OSError as error:
        raise ValueError(str(error)) from error


def frame_with_dictionary(data: bytes, dictionary: bytes) -> bytes:
    out = [STREAM_ID, _chunk(0xFE, DICT_ID + CRC32C.one(dictionary).to_bytes(4, "little"))]
    for i in range(0, len(data), CHUNK):
        piece = data[i : i + CHUNK]
        out.append(_chunk(0, _sum(piece) + compress_with_dictionary(piece, dictionary)))
    return b"".join(out)
