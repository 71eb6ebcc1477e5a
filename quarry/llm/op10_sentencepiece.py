"""SentencePiece encoding and decoding in NumPy batches.

A text is cut into segments that no piece can cross: before each run of spaces and between two
characters that no piece has side by side. The distinct segments of a slice are encoded once (told
apart by their characters, not by a hash alone), and those of a task's earlier slices are kept, the
``MEMO`` last used ones at least. Segments of equal length advance together:

* Viterbi: for each end position the hashes of the substrings that end there probe the sorted keys of
  the pieces; a vectorised maximum over their starts stores score and backpointer. Of equal scores the
  longest last piece wins, as in the library.
* BPE models are defined by merges: the library merges the best adjacent pair until none is left, which
  a Viterbi over the same scores does not reproduce, so equal-length segments merge together: one step
  merges every segment's best (leftmost) pair and probes the sorted pair keys for the two new neighbours.

``load`` gives the model as its file says; ``load(unigram=True)`` reads the same pieces and scores as a
unigram model. Both keep the vocabulary in sorted arrays that travel with the closure (a few MB, fixed by
the model). Characters outside the vocabulary fall back to their bytes.

Edges: a null or empty text has no pieces and decodes to the empty text; very long segments (over
``WIDE`` characters) of BPE models merge through a heap; the visible-space character U+2581 in a text
encodes as a space, as in the library, and so does not come back; null ids decode to the empty text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import bound_batches, map_arrow, table, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE, WIDE, STEP, MEMO, SLOTS, BESIDE = 1 << 19, 48, 4, 200_000, 18, 20
SPACE_MARK = 0x2581
_LOW = np.float32(-np.inf)


@dataclass
class Keys:
    """Keys in the order of their scrambled values; their first SLOTS bits say where to look."""

    values: np.ndarray  # scrambled, with one more behind that no key has
    ids: np.ndarray
    first: np.ndarray  # of each slot, len(ids) if it is empty
    most: int  # keys in a slot


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    unigram: bool
    unknown: int
    byte_ids: np.ndarray  # 256, -1 without byte fallback
    char_ids: np.ndarray  # by code point: the piece, else -1
    letters: np.ndarray  # by code point: its number among those that pieces of several characters hold, else 0
    beside: np.ndarray  # which pairs of these some piece has side by side
    pairs: Keys
    strings: Keys
    longest: int
    pool: np.ndarray  # decoded bytes of all pieces
    pool_at: np.ndarray


def load(path: str = MODEL, unigram: bool | None = None) -> Vocabulary:
    """The model of a file; unigram: what its pieces and scores are read as (None: as the file says)."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
        raise ValueError("only models with identity normalisation and a dummy prefix are supported")
    return vocabulary([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], model.trainer_spec.model_type == 1 if unigram is None else unigram)


def vocabulary(pieces: list[str], scores: list[float], types: list[int], unigram: bool) -> Vocabulary:
    """types as in the model file: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte."""
    normal = {p: i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t in (1, 4)}
    byte_ids = np.full(256, -1, np.int64)
    for i, t in enumerate(types):
        if t == 6:
            byte_ids[int(pieces[i][1:-1], 16)] = i
    chars = np.full(0x110000, -1, np.int32)
    for p, i in normal.items():
        if len(p) == 1:
            chars[ord(p)] = i
    keys, ids = [], []
    for p, i in normal.items():
        for cut in range(1, len(p)):
            if p[:cut] in normal and p[cut:] in normal:
                keys.append((normal[p[:cut]] << 32) | normal[p[cut:]])
                ids.append(i)
    names = list(normal)
    hashes = np.empty(len(names), np.uint64)
    sizes = np.array([len(p) for p in names])
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        chars_ = np.array([[ord(c) for c in names[i]] for i in own], np.uint64)
        h = np.full(len(own), K._R)
        for c in chars_.T:
            h = _grown(h, c)
        hashes[own] = h
    plain = []
    for i, (p, t) in enumerate(zip(pieces, types, strict=True)):
        plain.append(bytes([int(p[1:-1], 16)]) if t == 6 else b"" if t == 3 else " ⁇ ".encode() if t == 2 else p.replace(chr(SPACE_MARK), " ").encode())
    return Vocabulary(
        pieces, np.array(scores, np.float32), unigram, types.index(2) if 2 in types else 0, byte_ids, chars, *_neighbours([p for p in names if len(p) > 1]),
        _keys(np.array(keys, np.int64), np.array(ids, np.int64)), _keys(hashes, np.array([normal[p] for p in names], np.int64)), max(map(len, names)),
        np.frombuffer(b"".join(plain), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in plain]))),
    )


def _grown(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of strings with one more character each."""
    h = (h ^ c) * K._Q
    return h ^ (h >> np.uint64(31))


def _neighbours(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, beside) of a vocabulary. Where many letters make two pairs share a place, a cut is left out."""
    letters, held = np.zeros(0x110000, np.uint32), np.unique([ord(c) for p in names for c in p]).astype(np.int64)
    letters[held] = np.arange(1, len(held) + 1)
    beside = np.zeros(1 << min(BESIDE, (len(held) + 1).bit_length() * 2), bool)
    beside[_beside(letters, beside, np.array([[ord(c) for c in pair] for p in names for pair in zip(p, p[1:])], np.int64).reshape(-1, 2).T)] = True
    return letters, beside


def _beside(letters: np.ndarray, beside: np.ndarray, pairs: np.ndarray | tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places of pairs of code points in the table."""
    bits = np.uint32(int(letters.max()).bit_length())
    return ((letters[pairs[0]] << bits) + letters[pairs[1]]) & np.uint32(len(beside) - 1)


def _keys(keys: np.ndarray, ids: np.ndarray) -> Keys:
    values = _scrambled(keys)
    order = np.argsort(values, kind="stable")
    slots = (values[order] >> np.uint64(64 - SLOTS)).astype(np.int64)
    first = np.full(1 << SLOTS, len(keys), np.int32)
    first[slots[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
    held = set(values.tolist())
    none = next(i for i in range(len(held) + 1) if i not in held)
    return Keys(np.append(values[order], np.uint64(none)), ids[order], first, int(np.bincount(slots).max(initial=0)))


def _scrambled(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint64, copy=False) * K._P  # odd, so no two keys meet


def _probe(keys: Keys, wanted: np.ndarray) -> np.ndarray:
    """The id of each key, or -1."""
    out = np.full(wanted.shape, -1, np.int64)
    own, flat = _scrambled(wanted).ravel(), out.reshape(-1)
    at = keys.first[own >> np.uint64(64 - SLOTS)]
    left = np.flatnonzero(at < len(keys.ids))
    own, at = own[left], at[left]
    for _ in range(keys.most):
        have = keys.values[at]
        hit = have == own
        flat[left[hit]] = keys.ids[at[hit]]
        more = np.flatnonzero(have < own)  # they are sorted, so larger ones are not it
        if not len(more):
            break
        left, own, at = left[more], own[more], np.minimum(at[more] + 1, len(keys.ids))
    return out


def _pairs(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, score) of each adjacent pair; -1 and minus infinity where it is no piece."""
    ok = (left >= 0) & (right >= 0)
    ids = np.where(ok, _probe(v.pairs, (np.where(ok, left, 0) << 32) | np.where(ok, right, 0)), -1)
    return ids, np.where(ids >= 0, v.scores[ids], _LOW)


def merge(v: Vocabulary, symbols: np.ndarray) -> list[np.ndarray] | tuple[np.ndarray, np.ndarray]:
    """BPE of segments of one length (rows of symbols): (ids padded at the end, how many)."""
    n, width = symbols.shape
    out, sizes = symbols.copy(), np.full(n, width)
    if width < 2:
        return out, sizes
    rows, ids = np.arange(n), symbols.copy()
    pair, score = _pairs(v, ids[:, :-1], ids[:, 1:])
    for live in range(width, 1, -1):
        best = np.argmax(score, axis=1)
        go = score[np.arange(len(rows)), best] > _LOW
        if not go.all():
            done = ~go
            out[rows[done], : ids.shape[1]] = ids[done]
            sizes[rows[done]] = live
            rows, ids, pair, score, best = rows[go], ids[go], pair[go], score[go], best[go]
            if not len(rows):
                return out, sizes
        k = np.arange(len(rows))
        merged = pair[k, best]
        # take symbol best + 1 out; the pair at best goes with it
        later = np.arange(live - 1)[None, :] > best[:, None]
        ids = np.where(later, ids[:, 1:], ids[:, :-1])
        ids[k, best] = merged
        if live == 2:
            break
        shift = np.arange(live - 2)[None, :] >= best[:, None]
        pair, score = np.where(shift, pair[:, 1:], pair[:, :-1]), np.where(shift, score[:, 1:], score[:, :-1])
        for side in (best - 1, best):
            held = np.flatnonzero((side >= 0) & (side < live - 2))
            p, s = _pairs(v, ids[held, side[held]], ids[held, side[held] + 1])
            pair[held, side[held]], score[held, side[held]] = p, s
    out[rows, : ids.shape[1]] = ids
    sizes[rows] = ids.shape[1]
    return out, sizes


def merge_long(v: Vocabulary, symbols: list[int]) -> list[int]:
    """BPE of one long segment: a heap of pairs over a linked list."""
    ids, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    known = {}

    def look(i: int) -> None:
        j = after[i]
        if j < len(ids):
            if (ids[i], ids[j]) not in known:
                p, s = _pairs(v, np.array([ids[i]]), np.array([ids[j]]))
                known[ids[i], ids[j]] = (int(p[0]), float(s[0]))
            p, s = known[ids[i], ids[j]]
            if p >= 0:
                heapq.heappush(heap, (-s, i, ids[i], ids[j], p))

    heap: list = []
    for i in range(len(ids) - 1):
        look(i)
    gone = [False] * len(ids)
    while heap:
        _, i, a, b, p = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
            continue
        ids[i], gone[j] = p, True
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    return [x for x, dead in zip(ids, gone, strict=True) if not dead]


def viterbi(v: Vocabulary, chars: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of segments (rows of code points; own: their lengths, if not all) by summed scores: (ids
    padded at the end, how many). A single character that is no piece costs the lowest score less 10."""
    n, width = chars.shape
    points, h = chars.astype(np.uint64), np.full((n, width + 1), K._R)
    floor = np.float32((v.scores[v.strings.ids].min() if len(v.strings.ids) else 0) - 10)
    longest = min(v.longest, width)
    # pieces[k]: the piece of k + 1 characters that begins at each place, or -1
    pieces = []
    for size in range(1, longest + 1):
        h = _grown(h[:, : width - size + 1], points[:, size - 1 :])  # of the substrings from each place on
        pieces.append(_probe(v.strings, h))
    worth = [np.where(p >= 0, v.scores[p], floor if k == 0 else _LOW) for k, p in enumerate(pieces)]
    best = np.zeros((n, width + 1))  # scores may be whole numbers far apart, whose sums single floats round
    back, piece = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
    each = np.arange(n)
    for end in range(1, width + 1):
        sizes = np.arange(min(longest, end), 0, -1)  # long pieces first: they win ties
        score = np.stack([worth[k - 1][:, end - k] + best[:, end - k] for k in sizes], 1)
        top = np.argmax(score, 1)
        best[:, end], back[:, end] = score[each, top], end - sizes[top]
        found = np.stack([pieces[k - 1][:, end - k] for k in sizes], 1)[each, top]
        piece[:, end] = np.where(found >= 0, found, -2 - chars[:, end - 1])
    out, sizes, at = np.zeros((n, width), np.int64), np.zeros(n, np.int64), np.full(n, width) if own is None else own.copy()
    while (at > 0).any():
        live = np.flatnonzero(at > 0)
        out[live, width - 1 - sizes[live]] = piece[live, at[live]]
        sizes[live] += 1
        at[live] = back[live, at[live]]
    shift = (width - sizes)[:, None] + np.arange(width)[None, :]
    return np.take_along_axis(out, np.minimum(shift, width - 1), 1), sizes


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... of all runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _segments(v: Vocabulary, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the segments of all rows of code points."""
    n = len(text)
    space = text == SPACE_MARK
    cut = np.ones(n + 1, bool)
    cut[1:n] = ~v.beside[_beside(v.letters, v.beside, (text[:-1], text[1:]))] | (space[1:] & ~space[:-1])
    cut[first] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def distinct(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each different segment, one of its places, which of them every segment is)."""
    hashes = K.byte_hash(text.view(np.uint8), starts * text.itemsize, ends * text.itemsize)
    keys, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    wrong = _unequal(text, starts, ends - starts, text, starts[one][which], (ends - starts)[one][which])
    if len(wrong):  # segments that only share their hash are told apart by their characters
        extra: dict[bytes, int] = {}
        more = []
        for i in wrong.tolist():
            name = text[starts[i] : ends[i]].tobytes()
            if name not in extra:
                extra[name] = len(one) + len(more)
                more.append(i)
            which[i] = extra[name]
        one, keys = np.append(one, more), np.append(keys, hashes[more])
    return keys, one, which


def _unequal(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Segments that are not the same as their counterparts, character by character."""
    even = np.minimum(sizes, lengths)
    differ = np.concatenate(([0], np.cumsum(text[_ragged(starts, even)] != other[_ragged(at, even)])))
    ends = np.cumsum(even)
    return np.flatnonzero((sizes != lengths) | (differ[ends] > differ[ends - even]))


class Memo:
    """Segments that a task has encoded, by hash and characters. Full, it becomes the ``older`` one of an empty
    memo, which takes over what is asked for again."""

    def __init__(self) -> None:
        self.older: Memo | None = None
        self.keys, self.at, self.size, self.chars = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.where, self.length, self.ids = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)

    def find(self, keys: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each segment, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        wrong = _unequal(text, starts[hit], sizes[hit], self.chars, self.at[at[hit]], self.size[at[hit]])
        out = np.full(len(keys), -1)
        out[hit] = at[hit]
        out[hit[wrong]] = -1
        return out

    def known(self, keys: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segments that are held, those of them that only the older memo has; ids of each: how many, and all)."""
        entry = self.find(keys, text, starts, sizes)
        here, away = np.flatnonzero(entry >= 0), np.empty(0, np.int64)
        length, ids = self.length[entry[here]], self.ids[_ragged(self.where[entry[here]], self.length[entry[here]])]
        if self.older is not None:
            rest = np.flatnonzero(entry < 0)
            past = self.older.find(keys[rest], text, starts[rest], sizes[rest])
            away, past = rest[past >= 0], past[past >= 0]
            length, ids = np.append(length, self.older.length[past]), np.append(ids, self.older.ids[_ragged(self.older.where[past], self.older.length[past])])
        return np.append(here, away), away, length, ids

    def add(self, keys: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, where: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        short = np.flatnonzero(sizes <= WIDE)  # long ones do not come back
        keys, starts, sizes, where, length = keys[short], starts[short], sizes[short], where[short], length[short]
        if len(self.keys) + len(keys) > MEMO:
            full = Memo()
            full.__dict__.update({**self.__dict__, "older": None})
            self.__init__()
            self.older = full
        at, place = len(self.chars) + np.cumsum(sizes) - sizes, len(self.ids) + np.cumsum(length) - length
        self.chars, self.ids = (np.concatenate((a, b), dtype=np.int32) for a, b in ((self.chars, text[_ragged(starts, sizes)]), (self.ids, ids[_ragged(where, length)])))
        order = np.argsort(keys, kind="stable")
        slot = np.searchsorted(self.keys, keys[order], "right")
        for name, new in (("keys", keys), ("at", at), ("size", sizes), ("where", place), ("length", length)):
            setattr(self, name, np.insert(getattr(self, name), slot, new[order]))


def split(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of UTF-8 texts: (code points; rows that are not empty; where each begins; where each segment
    begins; hash of each different one; one of its places; its length; which of them every segment is)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<i4").copy()
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    held = np.flatnonzero(np.diff(lead))
    points[points == 0x20] = SPACE_MARK
    # the dummy prefix, in front of every row that is not empty
    text = np.insert(points, lead[held], SPACE_MARK)
    first = np.append(lead[held] + np.arange(len(held)), len(text))
    starts, ends = _segments(v, text, first)
    keys, one, which = distinct(text, starts, ends)
    return text, held, first, starts, keys, starts[one], (ends - starts)[one], which


def encode(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, memo: Memo | None = None, parts: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, row bounds) of UTF-8 texts. parts: their segments, if they are known."""
    rows = len(offsets) - 1
    memo = memo if memo is not None else Memo()
    if not len(data):
        return np.empty(0, np.int64), np.zeros(rows + 1, np.int64)
    text, held, first, starts, keys, s, size, which = parts or split(v, data, offsets)
    known, away, counts, ids = memo.known(keys, text, s, size)
    # the ids that this slice needs are copied out, so that the memo may be emptied
    length, where = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    length[known], where[known] = counts, np.cumsum(counts, dtype=np.int64) - counts
    chunks = [ids]
    fresh = np.ones(len(s), bool)
    fresh[known] = False
    fresh = np.flatnonzero(fresh)
    if len(fresh):
        pool, at, n = _encoded(v, text, s[fresh], size[fresh])
        where[fresh], length[fresh] = at + len(ids), n
        chunks.append(pool)
    pool, kept = np.concatenate(chunks, dtype=np.int64), np.append(away, fresh)
    if len(kept):
        memo.add(keys[kept], text, s[kept], size[kept], where[kept], length[kept], pool)
    n = length[which]
    total = np.concatenate(([0], np.cumsum(n)))
    bounds = np.zeros(rows + 1, np.int64)
    bounds[held + 1] = np.diff(total[np.searchsorted(starts, first)])
    return pool[_ragged(where[which], n)], np.cumsum(bounds)


def _encoded(v: Vocabulary, text: np.ndarray, s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where each segment's begin, how many) of different segments."""
    chunks, where, length, at = [], np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), 0
    widths = np.where(size > WIDE, size, -(-size // STEP) * STEP)  # a few lengths go together, filled up at the end
    for width in np.unique(widths):
        mine = np.flatnonzero(widths == width)
        if width > WIDE and not v.unigram:
            for i in mine:
                symbols = _symbols(v, text[s[i] : s[i] + width])
                got = np.array(merge_long(v, symbols.tolist()), np.int64)
                chunks.append(got)
                where[i], length[i], at = at, len(got), at + len(got)
            continue
        for part in np.array_split(mine, max(1, len(mine) * int(width) // (1 << 18))):
            inside = np.arange(width) < size[part][:, None]
            chars = text[np.where(inside, s[part][:, None] + np.arange(width), s[part][:, None])]
            if v.unigram:
                got, n = viterbi(v, chars, size[part])
            else:
                got, n = merge(v, np.where(inside, _symbols(v, chars), -1))  # which no piece takes in
                n = n - (width - size[part])
            mask = np.arange(width)[None, :] < n[:, None]
            chunks.append(got[mask])
            where[part], length[part] = at + np.cumsum(n) - n, n
            at += int(n.sum())
    return _fall_back(v, np.concatenate(chunks), where, length)


def _symbols(v: Vocabulary, chars: np.ndarray) -> np.ndarray:
    ids = v.char_ids[chars].astype(np.int64)
    lone = (ids < 0) & (chars < 0x80)
    if lone.any():
        ids[lone] = v.byte_ids[chars[lone]]
    return np.where(ids < 0, -2 - chars, ids)


def _fall_back(v: Vocabulary, pool: np.ndarray, where: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters outside the vocabulary (negative) become byte pieces, or the unknown piece."""
    bad = np.flatnonzero(pool < 0)
    if not len(bad):
        return pool, where, length
    spread = [[int(x) for x in v.byte_ids[list(chr(-2 - c).encode())]] if (v.byte_ids >= 0).all() else [v.unknown] for c in pool[bad]]
    sizes = np.ones(len(pool), np.int64)
    sizes[bad] = [len(x) for x in spread]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(ends[-1], np.int64)
    good = pool >= 0
    out[ends[:-1][good]] = pool[good]
    out[_ragged(ends[:-1][bad], sizes[bad])] = np.concatenate(spread)
    return out, ends[where], ends[where + length] - ends[where]


def decode(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row offsets); the dummy prefix of each row goes."""
    sizes = np.diff(v.pool_at)[ids]
    total = np.concatenate(([0], np.cumsum(sizes)))
    data = v.pool[_ragged(v.pool_at[ids], sizes)] if len(ids) else np.empty(0, np.uint8)
    offsets = total[bounds]
    front = offsets[:-1][np.diff(offsets) > 0]
    front = front[data[front] == 0x20]
    drop = np.zeros(len(data) + 1, np.int64)
    drop[front] = 1
    return np.delete(data, front), offsets - np.concatenate(([0], np.cumsum(drop)))[offsets]


def _same(data: np.ndarray, offsets: np.ndarray, back: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows whose bytes are equal."""
    if len(back) == len(data) and (back == data).all() and (at == offsets).all():
        return np.ones(len(offsets) - 1, bool)
    return np.array([back[at[i] : at[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(offsets) - 1)])


def tokens(docs: DataFrame, v: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("ids", "n_tokens", "round_trip"), others: dict[tuple[str, str, str], Vocabulary] | None = None) -> DataFrame:
    """(keep..., ids array<int>, n_tokens, round_trip): the pieces of every whole text, and whether
    decoding them gives the text back byte for byte. others: more of the like by other vocabularies, from
    the same pass over the texts."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "_text"]
    every = {names: v, **(others or {})}
    for ids, size, same in every:
        fields += [f"`{ids}` array<int>", f"`{size}` bigint", f"`{same}` boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = {n: Memo() for n in every}
        for batch in batches:
            for rows, data, offsets in K.slices(batch, "_text", SLICE):
                columns, parts = list(rows.columns[1:]), None
                for n, vocabulary_ in every.items():
                    if len(data) and (parts is None or not (np.array_equal(vocabulary_.letters, v.letters) and np.array_equal(vocabulary_.beside, v.beside))):  # same cuts, same segments
                        parts = split(vocabulary_, data, offsets)
                    ids, bounds = encode(vocabulary_, data, offsets, memos[n], parts)
                    same = _same(data, offsets, *decode(vocabulary_, ids, bounds))
                    columns += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(bounds), pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names[1:], *(x for n in every for x in n)])

    return slim.mapInArrow(trimmed(run), ", ".join(fields)).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def texts(encoded: DataFrame, v: Vocabulary, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., text): decodes arrays of ids."""

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(0)
        column = column.fill_null([]) if column.null_count else column
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = decode(v, flat, np.concatenate(([0], np.cumsum(sizes))))
        got = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got, pa.string())], [*batch.schema.names[1:], "text"])

    slim = encoded.select(F.col(ids).alias("_ids"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "_ids")
    return map_arrow(slim, kernel, f"{fields}, text string").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def query(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """The model's own encoding, and the Viterbi over its pieces and scores."""
    best = ("viterbi_ids", "n_viterbi", "viterbi_round_trip")
    return tokens(table(spark, sf_dir, "documents"), load(model), others={best: load(model, unigram=True)})
