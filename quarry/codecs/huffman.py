"""Prefix codes: length-limited lengths by package-merge, canonical codes, FSE normalisation."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heapify, heappop, heapreplace


def lengths(frequencies: Sequence[int], limit: int) -> list[int]:
    """Optimal code lengths of at most ``limit`` bits (0 for absent symbols, 1 for a lone one)."""
    used = sorted((f, i) for i, f in enumerate(frequencies) if f > 0)
    out = [0] * len(frequencies)
    if len(used) < 2:
        for _, i in used:
            out[i] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for the limit")
    coins = [(f, (i,)) for f, i in used]
    row = coins
    for _ in range(limit - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2], strict=False)]
        row = sorted(coins + pairs, key=lambda c: c[0])
    for _, symbols in row[: 2 * len(used) - 2]:
        for i in symbols:
            out[i] += 1
    return out


def quick_lengths(frequencies: Sequence[int], limit: int) -> list[int]:
    """As lengths(): Huffman's own tree, which is optimal as long as it keeps the limit."""
    heap = [(f, i) for i, f in enumerate(frequencies) if f > 0]
    if len(heap) < 2:
        return lengths(frequencies, limit)
    heapify(heap)
    parent, node = {}, len(frequencies)
    while len(heap) > 1:
        f, i = heappop(heap)
        g, j = heap[0]
        heapreplace(heap, (f + g, node))
        parent[i] = parent[j] = node
        node += 1
    depth = {node - 1: 0}
    out = [0] * len(frequencies)
    for i in sorted(parent, reverse=True):  # a parent has a larger number than its children
        depth[i] = depth[parent[i]] + 1
        if i < len(out):
            out[i] = depth[i]
    return out if max(out) <= limit else lengths(frequencies, limit)


def bit_string(data: bytes) -> str:
    """The bits of data as characters, most significant first: codes are cut out and looked up as strings."""
    return f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}" if data else ""


def whole_bytes(bits: str) -> tuple[bytes, str]:
    """The complete bytes of a bit string, and the bits that are left."""
    n = len(bits) // 8
    return (int(bits[: 8 * n], 2).to_bytes(n, "big") if n else b""), bits[8 * n :]


def codes(sizes: Sequence[int]) -> list[int]:
    """Canonical codes, most significant bit first, by (length, symbol)."""
    out, code, before = [0] * len(sizes), 0, 0
    for size, i in sorted((s, i) for i, s in enumerate(sizes) if s):
        code <<= size - before
        out[i], before = code, size
        code += 1
    return out


def decode_table(sizes: Sequence[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    return {(s, c): i for i, (s, c) in enumerate(zip(sizes, codes(sizes), strict=True)) if s}


def kraft(sizes: Sequence[int]) -> float:
    return sum(2.0**-s for s in sizes if s)


def normalise(frequencies: Sequence[int], table: int) -> list[int]:
    """Shares of a table of that many cells: at least one for every symbol, the rest to the largest."""
    total = sum(frequencies)
    if not total:
        return [0] * len(frequencies)
    shares = [0 if not f else max(1, f * table // total) for f in frequencies]
    spare = table - sum(shares)
    order = sorted(range(len(shares)), key=lambda i: -frequencies[i])
    while spare:
        for i in order:
            if not spare:
                break
            if spare > 0 and shares[i]:
                shares[i], spare = shares[i] + spare, 0
            elif spare < 0 and shares[i] > 1:
                take = min(shares[i] - 1, -spare)
                shares[i], spare = shares[i] - take, spare + take
    return shares


class BitWriter:
    """Bits in either order within bytes."""

    def __init__(self, msb: bool) -> None:
        self.msb, self.value, self.count, self.out = msb, 0, 0, bytearray()

    def write(self, value: int, bits: int) -> None:
        if self.msb:
            self.value = self.value << bits | value & ((1 << bits) - 1)
            self.count += bits
            while self.count >= 8:
                self.count -= 8
                self.out.append(self.value >> self.count & 255)
            self.value &= (1 << self.count) - 1
        else:
            self.value |= (value & ((1 << bits) - 1)) << self.count
            self.count += bits
            while self.count >= 8:
                self.out.append(self.value & 255)
                self.value >>= 8
                self.count -= 8

    def align(self) -> None:
        if self.count:
            self.write(0, 8 - self.count)

    def bytes(self) -> bytes:
        self.align()
        return bytes(self.out)


class BitReader:
    """Bits in either order; reading past the end raises EOFError, peeking pads with zeros."""

    def __init__(self, data: bytes, msb: bool) -> None:
        self.data, self.msb, self.at = data, msb, 0

    def peek(self, bits: int) -> int:
        first, last = self.at >> 3, (self.at + bits + 7) >> 3
        piece = self.data[first:last].ljust(last - first, b"\0")
        if self.msb:
            return int.from_bytes(piece, "big") >> (8 * last - self.at - bits) & ((1 << bits) - 1)
        return int.from_bytes(piece, "little") >> (self.at & 7) & ((1 << bits) - 1)

    def skip(self, bits: int) -> None:
        self.at += bits

    def read(self, bits: int) -> int:
        if self.at + bits > 8 * len(self.data):
            raise EOFError("bits after the end")
        value = self.peek(bits)
        self.at += bits
        return value

    def align(self) -> None:
        self.at = (self.at + 7) & ~7

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n
