"""Block transforms: suffix array, Burrows-Wheeler, move-to-front, run lengths."""

from __future__ import annotations

import numpy as np


def rotation_order(data: bytes) -> np.ndarray:
    """Order of the cyclic rotations, by prefix doubling; equal rotations keep their positions."""
    n = len(data)
    rank = np.frombuffer(data, np.uint8).astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < n:
        second = np.roll(rank, -k)
        order = np.lexsort((np.arange(n), second, rank))
        a, b = rank[order], second[order]
        new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


def suffix_array(data: bytes) -> np.ndarray:
    """Order of the suffixes; a shorter one stands before its extensions."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    rank, k = np.frombuffer(data, np.uint8).astype(np.int64) + 1, 1
    while True:
        second = np.concatenate((rank[k:], np.zeros(min(k, n), np.int64)))
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.concatenate(([1], 1 + np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            return order
        k *= 2


def bwt(data: bytes) -> tuple[bytes, int]:
    """(last column of the sorted rotations, row of the original)."""
    if not data:
        return b"", 0
    order = rotation_order(data)
    column = np.frombuffer(data, np.uint8)[order - 1]
    return column.tobytes(), int(np.flatnonzero(order == 0)[0])


def inverse_bwt(column: bytes, row: int) -> bytes:
    n = len(column)
    if not n:
        return b""
    if not 0 <= row < n:
        raise ValueError("row out of range")
    last = np.frombuffer(column, np.uint8)
    follow = np.argsort(last, kind="stable").tolist()
    out, at = bytearray(n), row
    for i in range(n):
        at = follow[at]
        out[i] = column[at]
    return bytes(out)


def mtf(data: bytes, alphabet: bytes | None = None) -> bytes:
    table, out = list(alphabet if alphabet is not None else bytes(range(256))), bytearray()
    for b in data:
        i = table.index(b)
        out.append(i)
        if i:
            table.insert(0, table.pop(i))
    return bytes(out)


def inverse_mtf(data: bytes, alphabet: bytes | None = None) -> bytes:
    table, out = list(alphabet if alphabet is not None else bytes(range(256))), bytearray()
    for i in data:
        b = table.pop(i)
        table.insert(0, b)
        out.append(b)
    return bytes(out)


def rle1(data: bytes) -> bytes:
    """Runs of four to 255 equal bytes as four and a count of the rest."""
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 255 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        out += data[i : i + min(n, 4)]
        if n >= 4:
            out.append(n - 4)
        i += n
    return bytes(out)


def inverse_rle1(data: bytes) -> bytes:
    out, run, i = bytearray(), 0, 0
    while i < len(data):
        b = data[i]
        run = run + 1 if out and i and out[-1] == b and run else 1
        out.append(b)
        i += 1
        if run == 4:
            if i >= len(data):
                raise ValueError("run without a count")
            out += bytes([b]) * data[i]
            i += 1
            run = 0
    return bytes(out)


def zero_runs(data: bytes) -> list[int]:
    """Runs of zeros in bijective base 2 of symbols 0 and 1, other values one higher, then an end
    symbol one above the largest."""
    out, run = [], 0

    def flush(n: int) -> None:
        while n:
            out.append(1 - n % 2)
            n = (n - 1) // 2

    for b in data:
        if b == 0:
            run += 1
        else:
            flush(run)
            run = 0
            out.append(b + 1)
    flush(run)
    return [*out, max(data, default=0) + 2]


def inverse_zero_runs(symbols: list[int]) -> bytes:
    out, run, weight, end = bytearray(), 0, 1, symbols[-1]
    for s in symbols:
        if s < 2:
            run += weight * (s + 1)
            weight *= 2
            continue
        out += b"\0" * run
        run, weight = 0, 1
        if s == end:
            break
        out.append(s - 1)
    return bytes(out)
