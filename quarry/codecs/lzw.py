"""LZW in the TIFF (MSB first, early change) and GIF (LSB first) forms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

PIECE = 4096  # codes that are packed or read at once


@dataclass(frozen=True)
class LzwConfig:
    """root: bits of a plain symbol; early: widths grow one code earlier; clear: clear codes are sent."""

    root: int = 8
    most: int = 12
    msb: bool = True
    early: bool = True
    clear: bool = True


TIFF, TIFF_NO_CLEAR = LzwConfig(), LzwConfig(clear=False)


def gif(root: int = 8) -> LzwConfig:
    return LzwConfig(root=root, msb=False, early=False)


@lru_cache
def _widths(config: LzwConfig, reading: bool) -> tuple[np.ndarray, int]:
    """(bits of each code from the first behind a clear code on, codes up to the clear code). They follow from a
    code's place alone, as every code but the first adds an entry; the last width holds for all that follow."""
    code, width, out, full = (1 << config.root) + 2 + reading, config.root + 1, [config.root + 1], 0
    while True:
        if reading and len(out) == 1:
            code -= 1  # the first code adds none; the encoder is one entry ahead
        if code < (1 << config.most) + reading:
            code += 1
        elif full or not config.clear:
            return np.array(out, np.int64), full
        if code + config.early > 1 << width and width < config.most:
            width += 1
        if not full and code + config.early >= 1 << config.most:
            full = len(out)
        out.append(width)


class _Packer:
    """Codes (256 times each) to bytes, some thousands at a time; bits that fill no byte are kept for the next ones."""

    def __init__(self, config: LzwConfig) -> None:
        self.order, self.size = "big" if config.msb else "little", 16 if config.most <= 16 else 32
        self.kind = f"{'>' if config.msb else '<'}u{self.size // 8}"
        self.left, self.out = np.empty(0, np.uint8), []

    def put(self, codes: list[int], widths: np.ndarray, last: bool = False) -> None:
        bits = np.unpackbits((np.array(codes, np.int64) >> 8).astype(self.kind).view(np.uint8).reshape(len(codes), -1), axis=1, bitorder=self.order)
        place, widths = np.arange(self.size), widths[:, None]
        bits = np.append(self.left, bits[place >= self.size - widths if self.order == "big" else place < widths])
        whole = len(bits) if last else len(bits) & ~7
        self.out.append(np.packbits(bits[:whole], bitorder=self.order).tobytes())
        self.left = bits[whole:]


def compress(data: bytes, config: LzwConfig = TIFF) -> bytes:
    """With clear codes the table starts again when it is full; without, it stays as it is."""
    clear, end = 1 << config.root, (1 << config.root) + 1
    if data and max(data) >= clear:
        raise ValueError("symbol out of range")
    widths, full = _widths(config, False)
    packer = _Packer(config)
    if config.clear:
        packer.put([clear * 256], widths[:1])
        most = full
    else:
        most = (1 << config.most) - end - 1
    codes: list[int] = []
    table: dict[int, int] = {}
    rest = iter(data)
    # codes are 256 times what is sent, so that a code and the next byte add up to the table's key
    prefix, code, limit = next(rest, -1) * 256, (end + 1) * 256, (end + 1 + most) * 256
    for b in rest:
        key = prefix + b
        hit = table.get(key)
        if hit is not None:
            prefix = hit
            continue
        codes.append(prefix)
        prefix = b << 8
        if code < limit:
            table[key] = code
            code += 256
        if code == limit and (config.clear or len(codes) >= PIECE):
            if config.clear:
                codes.append(clear * 256)
                table, code = {}, (end + 1) * 256
            packer.put(codes, widths[: len(codes)] if config.clear else _many(widths, len(codes)))
            codes = []
            if not config.clear:
                widths = widths[-1:]
    if prefix >= 0:
        codes.append(prefix)
    codes.append(end * 256)
    packer.put(codes, _many(widths, len(codes)), True)
    return b"".join(packer.out)


def _many(widths: np.ndarray, n: int) -> np.ndarray:
    return widths[:n] if n <= len(widths) else np.append(widths, np.full(n - len(widths), widths[-1]))


def _read(data: np.ndarray, at: int, widths: np.ndarray, msb: bool) -> np.ndarray:
    """Codes of these widths from a bit on; data has four bytes more than its bits need."""
    place = at + np.cumsum(widths) - widths
    byte, shift = place >> 3, place & 7
    four = [data[byte + i].astype(np.int64) for i in range(4)]
    if msb:
        value = (four[0] << 24 | four[1] << 16 | four[2] << 8 | four[3]) >> (32 - shift - widths)
    else:
        value = (four[0] | four[1] << 8 | four[2] << 16 | four[3] << 24) >> shift
    return value & ((1 << widths) - 1)


_BYTES = [bytes([i]) for i in range(256)]


def _start(clear: int) -> list[bytes]:
    return [*_BYTES[:clear], b"", b""]


def decompress(data: bytes, config: LzwConfig = TIFF, size: int | None = None) -> bytes:
    """Up to the end code, or to ``size`` bytes."""
    clear, end = 1 << config.root, (1 << config.root) + 1
    widths, _ = _widths(config, True)
    padded, bits, at = np.frombuffer(data + b"\0\0\0\0", np.uint8), 8 * len(data), 0
    out, most = bytearray(), (1 << config.most) - end - 1
    table, before, room, seen, step = _start(clear), b"", 0, 0, PIECE // 4
    while size is None or len(out) < size:
        now = _many(widths[seen:] if seen < len(widths) else widths[-1:], step)
        now = now[: np.searchsorted(np.cumsum(now), bits - at, "right")]
        if not len(now):
            break
        codes = _read(padded, at, now, config.msb)
        marks = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(marks[0]) if len(marks) else len(codes)
        entries: list[bytes] = []
        wrong = None
        for code in codes[:stop].tolist():
            try:
                entry = table[code]
            except IndexError:
                if code > len(table) or not before:
                    wrong = code
                    break
                entry = before + before[:1]
            entries.append(entry)
            if room:
                table.append(before + entry[:1])
                room -= 1
            elif not before:
                room = most
            before = entry
        out += b"".join(entries)
        if wrong is not None and (size is None or len(out) < size):
            raise ValueError(f"code {wrong} is not in the table")
        seen, at, step = seen + stop, at + int(now[:stop].sum()), PIECE
        if len(marks):
            if codes[stop] == end:
                break
            at += int(now[stop])
            table, before, room, seen, step = _start(clear), b"", 0, 0, PIECE // 4
    if size is not None and len(out) < size:
        raise ValueError("data ends early")
    return bytes(out if size is None else out[:size])
