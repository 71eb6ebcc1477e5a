"""Repeated passages by a sparse suffix array.

1. Sparse suffixes: of each text only the suffixes at content-selected minimiser positions stay.
   Every window of ``min_words`` words holds one among its first ``w + k - 1`` words, so what two
   copies of a passage keep are the same suffixes. A suffix whose first words (as many as any such
   window still has after it) occur once in all texts is dropped by a grouped count and a join.
2. Equal contexts (all words of any window around the suffix, named by the 128-bit digest of the words
   at their place in the text) collapse to one with a count; two or more are a repeated passage as they
   stand. Only suffixes that share their head with others of different context are opened.
3. The opened suffixes are sorted globally, by range partitions: a hot head falls apart where its
   continuations differ. Each is compared with its neighbour, and the match is extended to the right
   word by word. For every left length the suffixes of one stretch of long enough right matches
   are then extended to the left by that many words: those that agree have the window in common.
   So a neighbour with a longer match on one side cannot hide one with a longer match on the other.
4. Heads at the edges of a partition may go on in the next one. For these the windows themselves are
   named by 128 bits, counted in each partition first, and counts of all partitions are added up.
5. The windows of every occurrence are put together to spans.

Every shared passage of ``min_words`` or more is found whole, and nothing shorter is reported. Spans
are [start, end) in words of the text. Neighbours compare words by 48-bit codes at aligned places.

Edges: null, empty and short texts have no spans; a repeated row is another document; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import materialise, table, trimmed
from quarry.llm.slabs import Slabs, per_slab, slabs, stored, with_texts

MIN_WORDS, SEED, CODE, CHUNK = 50, 8, 6, 16_384


def _shape(min_words: int, seed: int) -> tuple[int, int, int]:
    """(w, left words, head words) of a suffix's context; a mask has a bit for every left length."""
    w = max(1, min(63, (min_words * 2) // 3 - 1, min_words - seed + 1))
    return w, w - 1, min_words - w + 1


def suffixes(words: K.Words, min_words: int, seed: int) -> tuple[np.ndarray, ...]:
    """(word position, head, first word of the context, its end) of the sparse suffixes of a slab."""
    w, left, head = _shape(min_words, seed)
    hashes = words.hashes()
    gram, valid = K.grams(hashes, words.first, seed)
    at = K.minimisers(gram, valid, words.first, w)
    row = np.searchsorted(words.first, at, "right") - 1
    low, high = words.first[row], words.first[row + 1]
    fits = at + head <= high
    at, low, high = at[fits], low[fits], high[fits]
    return at, K.span_hash(hashes, at, at + head, K._Q), np.maximum(low, at - left), np.minimum(high, at + min_words)


def _clip(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the suffix stands in its context, which is part of the context's name."""
    return K.mix((at - a).astype(np.uint64) << np.uint64(32) | (b - at).astype(np.uint64))


def _heads(min_words: int, seed: int):
    def kernel(slab: int, words: K.Words) -> list[pa.Array]:
        at, head, a, b = suffixes(words, min_words, seed)
        context = K.span_hash(words.hashes(), a, b, K._P) ^ _clip(at, a, b)
        _, one, n = np.unique(context, return_index=True, return_counts=True)
        return [pa.array(head[one].view(np.int64)), pa.array(context[one].view(np.int64)), pa.array(n, pa.int64())]

    return kernel


def _placed(min_words: int, seed: int):
    def kernel(slab: int, words: K.Words) -> list[pa.Array]:
        at, head, a, b = suffixes(words, min_words, seed)
        name = words.digests(a, b)
        return [pa.array(np.full(len(at), slab), pa.int64()), pa.array(at, pa.int32()), pa.array(head.view(np.int64)), pa.array(name[:, 0] ^ _clip(at, a, b).view(np.int64)), pa.array(name[:, 1])]

    return kernel


def _opened(min_words: int, seed: int):
    """Sort keys: the head, the words behind it, the words in front of the suffix (nearest first)."""
    _, left, head = _shape(min_words, seed)

    def kernel(rows: pa.RecordBatch, words: K.Words, at: np.ndarray, h: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        # non-zero codes, big-endian so that bytes sort like codes; 0 is "no word"
        codes = np.append(words.hashes() >> np.uint64(64 - 8 * CODE) | np.uint64(1), np.uint64(0))
        raw = np.ascontiguousarray(codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - CODE :])
        for start in range(0, len(at), CHUNK):
            own = slice(start, start + CHUNK)
            place = at[own]
            row = np.searchsorted(words.first, place, "right") - 1
            low, high = words.first[row][:, None], words.first[row + 1][:, None]
            ahead, back = place[:, None] + np.arange(head, min_words), place[:, None] - 1 - np.arange(left)
            which = np.concatenate((np.where(ahead < high, ahead, len(codes) - 1), np.where(back >= low, back, len(codes) - 1)), 1)
            key = np.concatenate((h[own].astype(">i8").view(np.uint8).reshape(-1, 8), raw[which].reshape(len(place), -1)), 1)
            width = key.shape[1]
            keys = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer((np.arange(len(place) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(key.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(c[own], pa.int64()), pa.array(d[own], pa.int64()), keys], ["_c", "_d", "_key"])

    return kernel


def _codes(raw: np.ndarray) -> np.ndarray:
    """Codes as numbers, of rows of bytes."""
    n = raw.shape[1] // CODE
    out = np.zeros((len(raw), n, 8), np.uint8)
    out[:, :, 8 - CODE :] = raw.reshape(len(raw), n, CODE)
    return out.view(">u8").reshape(len(raw), n).astype(np.uint64)


def _running(codes: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of the first 0, 1, 2... codes of each row, one column each."""
    out = np.empty((len(codes), codes.shape[1] + 1), np.uint64)
    out[:, 0] = base
    for i in range(codes.shape[1]):
        out[:, i + 1] = K.mix((out[:, i] ^ codes[:, i]) * K._Q + base)
    return out


def _alike(key: np.ndarray, run: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places at share run and key with another of them, in the order of at."""
    order = np.lexsort((key[at], run[at]))
    k, r = key[at][order], run[at][order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(at), bool)
    out[order] = same[1:] | same[:-1]
    return out


def compared(keys: np.ndarray, left: int, head: int, min_words: int) -> np.ndarray:
    """Masks of sorted suffixes (rows of key bytes): bit a says that the window which begins a words in
    front of the suffix is that of another one, too."""
    n, behind = len(keys), min_words - head
    mask = np.zeros(n, np.int64)
    if n < 2:
        return mask
    heads = np.ascontiguousarray(keys[:, :8]).view(">i8").ravel()
    right, back = _codes(keys[:, 8 : 8 + CODE * behind]), _codes(keys[:, 8 + CODE * behind :])
    # words in common with the row before; right matches are extended to the right word by word
    differ = (right[1:] != right[:-1]) | (right[1:] == 0)
    common = np.full(n, -1)
    common[1:] = np.where(heads[1:] == heads[:-1], head + np.where(differ.any(1), differ.argmax(1), behind), -1)
    before = _running(back, K._P)
    for a in range(left + 1):
        near = common >= min_words - a
        some = near.copy()
        some[:-1] |= near[1:]
        at = np.flatnonzero(some & (back[:, a - 1] != 0 if a else True))
        if len(at) > 1:
            hit = at[_alike(before[:, a], np.cumsum(~near), at)]
            mask[hit] |= np.int64(1) << np.int64(a)
    return mask


_OUT = "_c bigint, _d bigint, _mask bigint, _w bigint, _v bigint, _n int"
_NAMES = [f.split(" ")[0] for f in _OUT.split(", ")]


def _windows(c: np.ndarray, d: np.ndarray, keys: np.ndarray, left: int, head: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """Names of all windows of suffixes at a partition's edge: of those that occur once here with
    their suffix, of the others alone."""
    behind = min_words - head
    heads = np.ascontiguousarray(keys[:, :8]).view(">i8").ravel().astype(np.int64).view(np.uint64)
    right, back = _codes(keys[:, 8 : 8 + CODE * behind]), _codes(keys[:, 8 + CODE * behind :])
    ahead, before = [_running(right, s) for s in (K._P, K._R)], [_running(back, s) for s in (K._P, K._R)]
    for a in range(left + 1):
        more = min_words - a - head
        ok = np.ones(len(c), bool)
        if a:
            ok &= back[:, a - 1] != 0
        if more > 0:
            ok &= right[:, more - 1] != 0
        at = np.flatnonzero(ok & (more >= 0))
        if not len(at):
            continue
        w, v = (K.mix(K.mix(ahead[k][at, more] ^ heads[at]) * K._Q + before[k][at, a] + np.uint64(a)) for k in (0, 1))
        both, one, n = np.unique(np.stack((w, v), 1), axis=0, return_index=True, return_counts=True)
        lone = n == 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[at[one]], pa.int64(), mask=~lone), pa.array(d[at[one]], pa.int64(), mask=~lone), pa.array(np.full(len(one), 1 << a, np.int64)), pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64)), pa.array(np.minimum(n, 2), pa.int32())], _NAMES
        )


def _neighbours(batches: Iterator[pa.RecordBatch], left: int, head: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """Masks of the sorted suffixes of a partition, and the windows at its edges. Rows of one head are
    looked at together; the heads of about CHUNK rows at a time."""
    width = 8 + CODE * (min_words - head + left)

    def arrays(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        _, off, data = both.column(2).buffers()
        start = int(np.frombuffer(off, np.int32)[both.column(2).offset])
        return both.column(0).to_numpy(), both.column(1).to_numpy(), np.frombuffer(data, np.uint8, both.num_rows * width, start).reshape(-1, width)

    def judged(c: np.ndarray, d: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        mask = compared(keys, left, head, min_words)
        hit = np.flatnonzero(mask)
        if len(hit):
            none = pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(d[hit]), pa.array(mask[hit]), none, none, pa.nulls(len(hit), pa.int32())], _NAMES)

    held: list[pa.RecordBatch] = []
    rows, opening = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        first, last = held[0].column(2)[0].as_py()[:8], batch.column(2)[batch.num_rows - 1].as_py()[:8]
        if rows < CHUNK or first == last:
            continue
        c, d, keys = arrays(held)
        heads = np.ascontiguousarray(keys[:, :8]).view(">i8").ravel()
        cut = int(np.flatnonzero(heads != heads[-1])[-1]) + 1
        opening = first if opening is None else opening
        yield from judged(c[:cut], d[:cut], keys[:cut])
        edge = np.flatnonzero(heads[:cut] == int.from_bytes(opening, "big", signed=True))
        if len(edge):
            yield from _windows(c[edge], d[edge], keys[edge], left, head, min_words)
        rest = held[-1].slice(batch.num_rows - (len(c) - cut)) if len(c) - cut <= batch.num_rows else None
        if rest is None:
            table_ = pa.Table.from_batches(held).slice(cut).combine_chunks()
            rest = table_.to_batches()[0]
        held, rows = [rest], rest.num_rows
    if held:
        c, d, keys = arrays(held)
        yield from judged(c, d, keys)
        heads = np.ascontiguousarray(keys[:, :8]).view(">i8").ravel()
        edge = heads == heads[-1]
        if opening is None or int.from_bytes(opening, "big", signed=True) == heads[0]:
            edge |= heads == heads[0]
        edge = np.flatnonzero(edge)
        for start in range(0, len(edge), CHUNK):
            own = edge[start : start + CHUNK]
            yield from _windows(c[own], d[own], keys[own], left, head, min_words)


def matches(held: Slabs, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(_slab, _at, _mask): bit a says that the min_words words from _at - a on occur elsewhere, as far as
    they lie in one text. No column holds nulls."""
    _, left, head = _shape(min_words, seed)
    seen = per_slab(held, _heads(min_words, seed), "_h bigint, _c bigint, _n bigint")
    shared = seen.groupBy("_h").agg(F.sum("_n").alias("_t"), F.min("_c").alias("_a"), F.max("_c").alias("_b")).where("_t > 1").select(F.col("_h").alias("_k"), (F.col("_a") != F.col("_b")).alias("_differ"))
    shared = materialise(shared, "suffix-heads")  # on its own, so that both sides of the join are dealt by it and a hot head can be split
    placed = per_slab(held, _placed(min_words, seed), "_slab bigint, _at int, _h bigint, _c bigint, _d bigint")
    found = materialise(placed.join(shared, F.col("_h") == F.col("_k")).drop("_k"), "suffixes")
    kinds = found.groupBy("_c", "_d").agg(F.count(F.lit(1)).alias("_n"), F.first("_slab").alias("_slab"), F.first("_at").alias("_at"), F.first("_h").alias("_h"), F.first("_differ").alias("_differ"))
    kinds = materialise(kinds, "suffix-kinds")
    opened = with_texts(held, kinds.where("_differ"), ["_at", "_h", "_c", "_d"], _opened(min_words, seed), "_c bigint, _d bigint, _key binary")
    # ranges of the key's front, as ranges are sampled, and then of the name, so that they can split any group
    order = opened.repartitionByRange(F.substring("_key", 1, 8 + 8 * CODE), "_c", "_d").sortWithinPartitions("_key")
    inside = materialise(order.mapInArrow(trimmed(lambda it: _neighbours(it, left, head, min_words)), _OUT), "suffix-neighbours")
    edge = inside.where("_w is not null")
    twice = edge.groupBy("_w", "_v").agg(F.sum("_n").alias("_t")).where("_t > 1").select(F.col("_w").alias("_w1"), F.col("_v").alias("_v1"))
    across = edge.where("_c is not null").join(twice, (F.col("_w") == F.col("_w1")) & (F.col("_v") == F.col("_v1")))
    whole = kinds.where("_n > 1").select("_c", "_d", F.lit(-1).cast("bigint").alias("_mask"))
    masks = whole.union(inside.where("_w is null").select("_c", "_d", "_mask")).union(across.select("_c", "_d", "_mask"))
    masks = materialise(masks.groupBy("_c", "_d").agg(F.bit_or("_mask").alias("_mask")), "suffix-masks").withColumnsRenamed({"_c": "_c1", "_d": "_d1"})
    return found.join(masks, (F.col("_c") == F.col("_c1")) & (F.col("_d") == F.col("_d1"))).select("_slab", "_at", "_mask")


def covered(at: np.ndarray, mask: np.ndarray, first: np.ndarray, left: int, min_words: int) -> np.ndarray:
    """Which words of a slab lie in a repeated window of their text."""
    row = np.searchsorted(first, at, "right") - 1
    step = np.zeros(int(first[-1]) + 1, np.int64)
    for a in range(left + 1):
        start = at - a
        ok = ((mask >> a) & 1 == 1) & (start >= first[row]) & (start + min_words <= first[row + 1])
        np.add.at(step, start[ok], 1)
        np.add.at(step, start[ok] + min_words, -1)
    return np.cumsum(step)[:-1] > 0


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_repeated, spans array<struct<start, end>>) for every row of docs."""
    held = stored(docs, text, key)
    _, left, _ = _shape(min_words, seed)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, rows, data, offsets in slabs(batches):
            first = K.words_of(data, offsets).first
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int64()), whole(pa.concat_arrays([rows.column(1)])), whole(pa.array(first, pa.int32()))], ["_slab", "_keys", "_first"])

    texts = held.blobs.mapInArrow(trimmed(rows_of), f"_slab bigint, _keys array<{held.kind}>, _first array<int>")
    lists = matches(held, min_words, seed).groupBy("_slab").agg(F.collect_list(F.struct("_at", "_mask")).alias("_s"))
    joined = texts.join(lists, "_slab", "left").select("_keys", "_first", F.col("_s._at").alias("_at"), F.col("_s._mask").alias("_mask"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, first = batch.column(0)[i].values, batch.column(1)[i].values.to_numpy().astype(np.int64)
                at, mask = (np.empty(0, np.int64) if batch.column(j)[i].values is None else batch.column(j)[i].values.to_numpy().astype(np.int64) for j in (2, 3))
                cover = covered(at, mask, first, left, min_words)
                total = np.concatenate(([0], np.cumsum(cover)))
                cut = np.zeros(len(cover) + 1, bool)
                cut[first] = True
                on = cover & (np.append(False, ~cover[:-1])[: len(cover)] | cut[:-1])
                off = cover & (np.append(~cover[1:], True)[: len(cover)] | cut[1:])
                start, end = np.flatnonzero(on), np.flatnonzero(off) + 1
                owner = np.searchsorted(first, start, "right") - 1
                bounds = np.searchsorted(owner, np.arange(len(keys) + 1)).astype(np.int32)
                both = pa.StructArray.from_arrays([pa.array(start - first[owner], pa.int32()), pa.array(end - first[owner], pa.int32())], ["start", "end"])
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(first), pa.int64()), pa.array(total[first[1:]] - total[first[:-1]], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), both)], ["_key", "n_words", "n_repeated", "spans"])

    out = joined.mapInArrow(merged, f"_key {held.kind}, n_words bigint, n_repeated bigint, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("_key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
