"""Checksums that Spark has no expression for, over many byte strings at once.

Byte-wise CRCs run in lanes: strings (and pieces of long ones) advance together, one byte each a
step, and the pieces of a string are joined by the linear shift that appending zero bytes is.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

PIECE, ROW = 2048, 64


@dataclass(frozen=True)
class Crc:
    """A reflected CRC with all-ones (or zero) start and final XOR."""

    width: int
    poly: int
    ones: bool
    table: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        table = np.arange(256, dtype=np.uint64)
        for _ in range(8):
            table = np.where(table & np.uint64(1), (table >> np.uint64(1)) ^ np.uint64(self.poly), table >> np.uint64(1))
        object.__setattr__(self, "table", table)

    def _shift(self, state: np.ndarray, zeros: int) -> np.ndarray:
        """The register after that many zero bytes, for many registers, by doubling."""
        bits = np.array([self._zero(np.array([1 << b], np.uint64), 1)[0] for b in range(self.width)], np.uint64)  # one zero byte
        while zeros:
            if zeros & 1:
                state = self._apply(bits, state)
            bits = self._apply(bits, bits)
            zeros >>= 1
        return state

    def _apply(self, columns: np.ndarray, state: np.ndarray) -> np.ndarray:
        out = np.zeros_like(state)
        for b in range(self.width):
            out ^= np.where((state >> np.uint64(b)) & np.uint64(1), columns[b], np.uint64(0))
        return out

    def _zero(self, state: np.ndarray, n: int) -> np.ndarray:
        for _ in range(n):
            state = self.table[(state & np.uint64(255)).astype(np.intp)] ^ (state >> np.uint64(8))
        return state

    def _rows(self, value: bytes, now: int) -> int:
        """The register after value: the bytes of ROW at a time add up by their place, then the rows follow."""
        table, shift = self.places
        whole = len(value) // ROW * ROW
        for i in range(0, whole, 1024 * ROW):
            part = np.frombuffer(value, np.uint8, min(whole - i, 1024 * ROW), i).reshape(-1, ROW)
            for row in np.bitwise_xor.reduce(table[np.arange(ROW), part], axis=1).tolist():
                for column in shift:
                    row ^= column[now & 255]
                    now >>= 8
                now = row
        for b in value[whole:]:
            now = self.single[(now ^ b) & 255] ^ now >> 8
        return now

    @cached_property
    def single(self) -> list[int]:
        return self.table.tolist()

    @cached_property
    def places(self) -> tuple[np.ndarray, list[list[int]]]:
        """(what a byte at each place of a row adds to the register behind it; what each byte of the register
        in front of a row does)."""
        table = np.empty((ROW, 256), np.uint64)
        table[-1] = self.table
        for i in range(ROW - 1, 0, -1):
            table[i - 1] = self._zero(table[i], 1)
        every = np.arange(256, dtype=np.uint64)
        return table, [self._zero(every << np.uint64(8 * k), ROW).tolist() for k in range(self.width // 8)]

    def many(self, values: Sequence[bytes], start: Sequence[int] | None = None) -> np.ndarray:
        """CRC of each value; start continues from finished CRCs."""
        full = np.uint64((1 << self.width) - 1) if self.ones else np.uint64(0)
        state = np.full(len(values), full) if start is None else np.array(start, np.uint64) ^ full
        sizes = np.array([len(v) for v in values], np.int64)
        pieces = np.maximum(1, -(-sizes // PIECE))
        owner = np.repeat(np.arange(len(values)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(PIECE, sizes[owner] - nth * PIECE)
        data = np.frombuffer(b"".join(values), np.uint8)
        begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * PIECE
        if len(owner) < 48:  # too few lanes to be worth a step of NumPy for each byte
            return np.array([self._rows(v, now) for v, now in zip(values, state.tolist(), strict=True)], np.uint64) ^ full
        order = np.argsort(-size, kind="stable")
        begin, long = begin[order], size[order]
        lanes = np.where(nth[order] == 0, state[owner[order]], np.uint64(0))
        live = len(lanes)
        for step in range(int(long[0]) if len(long) else 0):
            while live and long[live - 1] <= step:
                live -= 1
            now = lanes[:live]
            lanes[:live] = self.table[((now ^ data[begin[:live] + step]) & np.uint64(255)).astype(np.intp)] ^ (now >> np.uint64(8))
        parts = np.empty_like(lanes)
        parts[order] = lanes
        out = parts[np.cumsum(pieces) - pieces].copy()
        for k in range(1, int(pieces.max(initial=1))):
            rows = np.flatnonzero(pieces > k)
            at = (np.cumsum(pieces) - pieces)[rows] + k
            for length in np.unique(size[at]):
                same = size[at] == length
                out[rows[same]] = self._shift(out[rows[same]], int(length)) ^ parts[at[same]]
        return out ^ full

    def one(self, value: bytes) -> int:
        return int(self.many([value])[0])


# Reflected polynomials.
CRC16 = Crc(16, 0xA001, False)
CRC32C = Crc(32, 0x82F63B78, True)
CRC64 = Crc(64, 0xC96C5795D7870F42, True)


def crc32(value: bytes, start: int = 0) -> int:
    return zlib.crc32(value, start)


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def unmask(value: int) -> int:
    rot = (value - 0xA282EAD8) & 0xFFFFFFFF
    return (rot >> 17 | rot << 15) & 0xFFFFFFFF


class RunningCrc:
    """update / value over pieces, for any CRC."""

    def __init__(self, crc: Crc) -> None:
        self.crc, self.value = crc, 0

    def update(self, piece: bytes) -> RunningCrc:
        self.value = int(self.crc.many([piece], [self.value])[0])
        return self


try:
    import xxhash as _xx

    def xxh32(value: bytes, seed: int = 0) -> int:
        return _xx.xxh32_intdigest(value, seed)

    def xxh64(value: bytes, seed: int = 0) -> int:
        return _xx.xxh64_intdigest(value, seed)

except ImportError:  # the package is optional; the same from the published algorithm

    def xxh32(value: bytes, seed: int = 0) -> int:
        return _xxh(value, seed, 32)

    def xxh64(value: bytes, seed: int = 0) -> int:
        return _xxh(value, seed, 64)


# The primes of the two hashes.
_PRIMES = {32: (2654435761, 2246822519, 3266489917, 668265263, 374761393), 64: (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)}


def _xxh(value: bytes, seed: int, bits: int) -> int:
    """XXH32 / XXH64 in plain Python, for machines without the package."""
    p1, p2, p3, p4, p5 = _PRIMES[bits]
    full, lane = (1 << bits) - 1, bits // 8
    rot = lambda x, r: (x << r | x >> (bits - r)) & full
    r_round, merge = (13, None) if bits == 32 else (31, True)
    step = lambda acc, x: rot((acc + x * p2) & full, r_round) * p1 & full
    at = 0
    if len(value) >= 4 * lane:
        acc = [(seed + p1 + p2) & full, (seed + p2) & full, seed, (seed - p1) & full]
        while at + 4 * lane <= len(value):
            for i in range(4):
                acc[i] = step(acc[i], int.from_bytes(value[at : at + lane], "little"))
                at += lane
        h = sum(rot(a, r) for a, r in zip(acc, (1, 7, 12, 18), strict=True)) & full
        if merge:
            for a in acc:
                h = ((h ^ step(0, a)) * p1 + p4) & full
    else:
        h = (seed + p5) & full
    h = (h + len(value)) & full
    if bits == 64:
        while at + 8 <= len(value):
            h = (rot(h ^ step(0, int.from_bytes(value[at : at + 8], "little")), 27) * p1 + p4) & full
            at += 8
        if at + 4 <= len(value):
            h = (rot(h ^ int.from_bytes(value[at : at + 4], "little") * p1 & full, 23) * p2 + p3) & full
            at += 4
        for b in value[at:]:
            h = rot(h ^ b * p5 & full, 11) * p1 & full
        for shift, prime in ((33, p2), (29, p3)):
            h = (h ^ h >> shift) * prime & full
        return h ^ h >> 32
    while at + 4 <= len(value):
        h = rot((h + int.from_bytes(value[at : at + 4], "little") * p3) & full, 17) * p4 & full
        at += 4
    for b in value[at:]:
        h = rot((h + b * p5) & full, 11) * p1 & full
    for shift, prime in ((15, p2), (13, p3)):
        h = (h ^ h >> shift) * prime & full
    return h ^ h >> 16


def _times(a: int, b: int, poly: int = 0xEDB88320) -> int:
    """Product of two polynomials over GF(2), bits reversed as CRC-32 has them, modulo its polynomial."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = b << 1 & 0xFFFFFFFF
        a = a >> 1 ^ (poly if a & 1 else 0)
    return out


def crc32_join(parts) -> int:
    """CRC-32 of what the parts (checksum, length) make up in order: a part's checksum moves up by the
    bytes behind it, which is a product with a power of x."""
    total = 0
    for crc, n in parts:
        shift, square, bits = 0x80000000, 0x40000000, 8 * n  # 1 and x
        while bits:
            if bits & 1:
                shift = _times(shift, square)
            square, bits = _times(square, square), bits >> 1
        total = _times(total, shift) ^ crc
    return total
