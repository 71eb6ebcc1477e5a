"""NumPy kernels over whole Arrow text batches, shared by the corpus operators.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` over code points. Nulls and empty texts have no words. Batches are cut
into slices of about ``SLICE_BYTES`` of text, so memory follows the slice (or the longest single
text) and not the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_PRIME, _LOW31 = np.uint64((1 << 61) - 1), np.uint64((1 << 31) - 1)
LONG = 256  # words of more bytes than these take XXH64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def give_back() -> None:
    """Returns a worker's free memory to the system, where the C library can."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _P) -> np.ndarray:
    """Hash of the bytes data[start:end] of every span: eight bytes at a time go through the
    finaliser, all spans together; long spans take XXH64."""
    n = len(data)
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = data
    eight = np.ndarray((n + 1,), "<u8", wide, strides=(1,))
    starts, size = np.asarray(starts), np.asarray(ends) - starts
    out = mix(np.arange(LONG + 2, dtype=np.uint64) * _R + base)[np.minimum(size, LONG + 1)]
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, h = starts[live], size[live], out[live]
    while len(live):
        h = mix((h ^ (eight[at] & _HEAD[np.minimum(left, 8)])) * _Q + base)
        out[live] = h  # of longer ones the last one holds
        more = np.flatnonzero(left > 8)
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    far = np.flatnonzero(size > LONG)
    if len(far):
        raw = wide.data
        out[far] = [xxhash.xxh64_intdigest(raw[a:b], int(base)) for a, b in zip(starts[far].tolist(), (starts[far] + size[far]).tolist(), strict=True)]
    return out


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below it."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a1 * b0
    middle += a0 * b1
    out = (a1 * b1) << np.uint64(1)
    out += middle >> np.uint64(30)
    out += (middle & np.uint64((1 << 30) - 1)) << np.uint64(31)
    out += a0 * b0
    return _reduced(out)


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) modulo 2**61 - 1 for i < n at least; kept and doubled as needed."""
    key = (int(base), inverse)
    have = _powers.get(key)
    if have is None or len(have) < n:
        prime = int(_PRIME)
        step = pow(int(base) % prime, -1 if inverse else 1, prime)
        have = np.ones(1, np.uint64) if have is None else have
        while len(have) < max(n, 1 << 14):
            have = np.concatenate((have, _product(have, np.uint64(pow(step, len(have), prime)))))
        _powers[key] = have
    return have


class Spans:
    """Hashes of spans of values (unsigned integers), as polynomials modulo the prime 2**61 - 1 by one
    running sum: two different spans of n values meet by a chance of n / 2**61."""

    def __init__(self, values: np.ndarray, base: np.uint64 = _P) -> None:
        n = len(values)
        self.back = powers(base, n + 1, True)
        terms = _product(_reduced(values.astype(np.uint64, copy=False)), powers(base, n)[:n])
        self.total = np.zeros(n + 1, np.uint64)
        low, high = np.cumsum(terms & np.uint64(0xFFFFFFFF)), np.cumsum(terms >> np.uint64(32))
        high = _reduced(high)
        self.total[1:] = _reduced(_reduced(low) + _reduced((high << np.uint64(32) & _PRIME) + (high >> np.uint64(29))))

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = _product(_reduced(self.total[ends] + (_PRIME - self.total[starts])), self.back[starts])
        out += (np.asarray(ends) - starts).astype(np.uint64) * _R
        return mix(out)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _P) -> np.ndarray:
    """Hash of values[start:end] for every span."""
    return Spans(values, base).hash(starts, ends)


@dataclass
class Words:
    """The words of a slice: row i of the slice owns words first[i]:first[i + 1]."""

    data: np.ndarray  # uint8 of all texts
    offsets: np.ndarray  # of rows in data
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, base: np.uint64 = _P) -> np.ndarray:
        return byte_hash(self.data, self.starts, self.ends, base)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(all words, each with a space behind it; where each begins; where it ends)."""
        sizes = self.ends - self.starts
        ends = np.cumsum(sizes + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        starts = ends - sizes - 1
        out[np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)] = self.data[np.flatnonzero(~SPACE[self.data])]
        return out.tobytes(), starts, ends - 1

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """BLAKE2b-128 of the words first to last - 1 joined by one space, for every span: n x 2 int64."""
        raw, starts, ends = self.joined()
        spans = zip(starts[first].tolist(), ends[np.asarray(last) - 1].tolist(), strict=True)
        names = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in spans])
        return np.frombuffer(names, "<i8").reshape(-1, 2)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~SPACE[data]
    n = len(data)
    begins = np.empty(n, bool)
    stops = np.empty(n, bool)
    if n:
        begins[0], stops[-1] = solid[0], solid[-1]
        np.logical_and(solid[1:], ~solid[:-1], out=begins[1:])
        np.logical_and(solid[:-1], ~solid[1:], out=stops[:-1])
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] = solid[edge]
        stops[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of pieces of about ``limit`` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    data, offsets = text_buffers(column)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def grams(hashes: np.ndarray, first: np.ndarray, k: int, base: np.uint64 = _Q) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the k words from each word on; valid where they are of one row."""
    n = len(hashes)
    valid = np.zeros(n, bool)
    if n < k:
        return np.zeros(n, np.uint64), valid
    at = np.arange(n - k + 1)
    row_end = np.repeat(first[1:], np.diff(first))
    valid[: n - k + 1] = at + k <= row_end[: n - k + 1]
    out = np.zeros(n, np.uint64)
    out[: n - k + 1] = span_hash(hashes, at, at + k, base)
    return out, valid


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from prefix and suffix minima of blocks of w."""
    n = len(values)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def minimisers(gram: np.ndarray, valid: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Positions of the k-grams that are smallest (leftmost on ties) among some w consecutive ones
    of one row. A row with fewer than w k-grams has none: it holds no window of w + k - 1 words."""
    n = len(gram)
    if n < w:
        return np.empty(0, np.int64)
    lowest = sliding_min(gram, w)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(valid[: n - w + 1] & valid[w - 1 :] & (row[: n - w + 1] == row[w - 1 :]))
    found = np.zeros(n, bool)
    left, want = at, lowest[at]
    for step in range(w):  # the leftmost position of the window that holds its minimum
        hit = gram[left + step] == want
        found[left[hit] + step] = True
        left, want = left[~hit], want[~hit]
    return np.flatnonzero(found)
