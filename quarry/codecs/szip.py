"""Extended-Rice sample coding after the CCSDS 121 recommendation: blocks of samples coded as zero
runs, second extension, k-split or uncompressed, with an optional nearest-neighbour predictor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from quarry.codecs.huffman import BitReader, BitWriter


@dataclass(frozen=True)
class Params:
    bits: int = 16
    block: int = 16
    rsi: int = 128  # blocks between reference samples
    nearest: bool = True
    msb: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= 32:
            raise ValueError("bits per sample must be 1..32")
        if self.block not in (8, 16, 32):
            raise ValueError("block must be 8, 16 or 32")

    @property
    def id_bits(self) -> int:
        return next(n for top, n in ((2, 1), (4, 2), (8, 3), (16, 4), (32, 5)) if self.bits <= top)

    @property
    def highest(self) -> int:
        return (1 << self.bits) - 1

    @property
    def width(self) -> int:
        return 1 if self.bits <= 8 else 2 if self.bits <= 16 else 4


def _map(x: int, before: int, top: int) -> int:
    """Prediction error folded so that it fits the sample's range."""
    d, theta = x - before, min(before, top - before)
    return 2 * d if 0 <= d <= theta else -2 * d - 1 if -theta <= d < 0 else theta + abs(d)


def _unmap(v: int, before: int, top: int) -> int:
    theta = min(before, top - before)
    if v <= 2 * theta:
        return before + (v // 2 if v % 2 == 0 else -((v + 1) // 2))
    return before + (v - theta) if theta == before else before - (v - theta)


def encode(samples: Sequence[int], p: Params) -> bytes:
    out, per = BitWriter(p.msb), p.rsi * p.block
    for start in range(0, len(samples), per):
        part = list(samples[start : start + per])
        if any(not 0 <= x <= p.highest for x in part):
            raise ValueError("sample out of range")
        part += part[-1:] * (-len(part) % p.block)
        if p.nearest:
            coded = [0] + [_map(x, y, p.highest) for y, x in zip(part, part[1:], strict=False)]
        else:
            coded = part
        blocks = [coded[i : i + p.block] for i in range(0, len(coded), p.block)]
        i = 0
        while i < len(blocks):
            reference = p.nearest and i == 0
            values = blocks[i][1:] if reference else blocks[i]
            if not any(values):
                # a run of zero blocks inside its segment of 64
                run = 1
                while i + run < len(blocks) and (i + run) % 64 and not any(blocks[i + run]):
                    run += 1
                rest = (i + run) % 64 == 0 or i + run == len(blocks)
                out.write(0, p.id_bits)
                out.write(0, 1)
                if reference:
                    out.write(part[0], p.bits)
                code = 5 if rest and run >= 5 else run if run < 5 else run + 1
                _unary(out, code - 1)
                i += run
                continue
            _block(out, values, part[0] if reference else None, p)
            i += 1
    return out.bytes()


def _unary(out: BitWriter, n: int) -> None:
    while n > 24:
        out.write(0, 24)
        n -= 24
    for _ in range(n):
        out.write(0, 1)
    out.write(1, 1)


def _block(out: BitWriter, values: list[int], reference: int | None, p: Params) -> None:
    raw = p.bits * len(values)
    top = (1 << p.id_bits) - 3 if p.id_bits > 1 else -1
    best, k = min(((sum(v >> k for v in values) + len(values) * (k + 1), k) for k in range(max(0, min(top, p.bits - 1)) + 1)), default=(raw + 1, 0)) if top >= 0 else (raw + 1, 0)
    pairs = ([0] if reference is not None else []) + values
    second = sum((a + b) * (a + b + 1) // 2 + b + 1 for a, b in zip(pairs[::2], pairs[1::2], strict=True)) + 1
    if second < min(best, raw) and second < 4096:
        out.write(0, p.id_bits)
        out.write(1, 1)
        if reference is not None:
            out.write(reference, p.bits)
        for a, b in zip(pairs[::2], pairs[1::2], strict=True):
            _unary(out, (a + b) * (a + b + 1) // 2 + b)
    elif best < raw:
        out.write(k + 1, p.id_bits)
        if reference is not None:
            out.write(reference, p.bits)
        for v in values:
            _unary(out, v >> k)
        for v in values:
            out.write(v, k)
    else:
        out.write((1 << p.id_bits) - 1, p.id_bits)
        if reference is not None:
            out.write(reference, p.bits)
        for v in values:
            out.write(v, p.bits)


def decode(data: bytes, count: int, p: Params) -> list[int]:
    bits, out = BitReader(data, p.msb), []
    per = p.rsi * p.block
    while len(out) < count:
        size = min(per, count - len(out))
        size += -size % p.block
        coded: list[int] = []
        reference = None
        while len(coded) < size:
            first = p.nearest and not coded
            ident = bits.read(p.id_bits)
            low = bits.read(1) if ident == 0 else 0
            if first:
                reference = bits.read(p.bits)
            n = p.block - first
            if ident == 0 and low == 0:
                code, done = bits.unary() + 1, len(coded) // p.block
                if code == 5:
                    run = min(64 - done % 64, size // p.block - done)
                else:
                    run = code if code < 5 else code - 1
                values = [0] * (run * p.block - first)
            elif ident == 0:
                values = []
                for _ in range(p.block // 2):
                    m = bits.unary()
                    s = int(((8 * m + 1) ** 0.5 - 1) / 2)
                    while (s + 1) * (s + 2) // 2 <= m:
                        s += 1
                    b = m - s * (s + 1) // 2
                    values += [s - b, b]
                values = values[first:]
            elif ident == (1 << p.id_bits) - 1:
                values = [bits.read(p.bits) for _ in range(n)]
            else:
                k = ident - 1
                high = [bits.unary() for _ in range(n)]
                values = [h << k | (bits.read(k) if k else 0) for h in high]
            coded += ([0] if first else []) + values
        if p.nearest:
            line = [reference]
            for v in coded[1:]:
                line.append(_unmap(v, line[-1], p.highest))
            coded = line
        out += coded
    return out[:count]


def to_bytes(samples: Sequence[int], p: Params) -> bytes:
    return b"".join(int(v).to_bytes(p.width, "big") for v in samples)


def from_bytes(data: bytes, p: Params) -> list[int]:
    return [int.from_bytes(data[i : i + p.width], "big") for i in range(0, len(data) - p.width + 1, p.width)]
