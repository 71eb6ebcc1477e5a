"""SimHash near-duplicate groups by a byte-position inverted index with count filtering.

Fingerprints within 3 bits share at least 5 of their 8 positional bytes. The index posts a fingerprint
under every choice of 4 (position, byte) entries: single bytes would make postings of a 256th of all
fingerprints. Pairs that meet have 4 bytes in common; the bytes they share are tallied, pairs that do not
reach the guaranteed 5 are dropped, and the others are verified by their bits.

Exact copies collapse first: only distinct fingerprints are indexed. A posting gives a spanning forest
(each member is linked once), never all its pairs; components follow from the links.

Edges: a null or empty text, or one of separators alone, has fingerprint zero and is linked like any
other; repeated rows are documents of their own; a null doc_id is never the smallest of its group
unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm import near_copies
from quarry.llm.common import map_arrow, materialise, table, trimmed, with_row
from quarry.llm.components import components
from quarry.llm.set_join import groups as whole_groups
from quarry.llm.slabs import Slabs, slabs

SHINGLE, BITS, SEED = 3, 3, 42
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of every row of a slice."""
    words = K.words_of(_LOWER[data], offsets)
    n_words = words.counts
    rows = len(offsets) - 1
    out = np.zeros(rows, np.uint64)
    if not len(words.starts):
        return out
    raw, starts, ends = words.joined()  # a shingle is one run of bytes
    take = np.minimum(n_words, k)
    count = np.where(n_words > 0, n_words - take + 1, 0)
    first = np.repeat(words.first[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    last = first + np.repeat(take, count) - 1
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first))
    held = np.flatnonzero(count)
    at = (np.cumsum(count) - count)[held]
    for bit in _SHIFTS:
        ones = np.add.reduceat((hashed >> bit) & np.uint64(1), at)
        out[held] |= (2 * ones.astype(np.int64) > count[held]).astype(np.uint64) << bit
    return out


def _kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in K.slices(batch, "_text"):
        yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(fingerprints(data, offsets).view(np.int64))], [*rows.schema.names[1:], "_fp"])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Equal positional bytes of pairs, from their differences."""
    return (np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that connect what is within ``bits`` in one posting: each member is linked once."""
    if len(fps) > 8192:
        return _forest_by_probes(np.sort(fps), bits)
    left, links = fps.copy(), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            diff = left ^ x
            near = _near(diff, bits)
            if near.any():
                hit = left[near]
                links += [(int(x), int(y)) for y in hit]
                queue += list(hit)
                left = left[~near]
    return links


def _forest_by_probes(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """The same for large postings: members differ in four bytes only, so the at most 5,488
    neighbours of each are looked up in the sorted posting, many members at a time."""
    spread = np.bitwise_or.reduce(fps ^ fps[0])
    free = [np.uint64(1) << b for b in _SHIFTS if spread >> b & np.uint64(1)]
    flips = np.array([np.bitwise_or.reduce(c) for n in range(1, bits + 1) for c in combinations(free, n)], np.uint64)
    parent = np.arange(len(fps))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for at in range(0, len(fps), 256):
        part = fps[at : at + 256]
        wanted = part[:, None] ^ flips[None, :]
        where = np.minimum(np.searchsorted(fps, wanted), len(fps) - 1)
        for i, j in zip(*np.nonzero(fps[where] == wanted), strict=True):
            a, b = find(at + int(i)), find(int(where[i, j]))
            if a != b:
                parent[b] = a
                links.append((int(part[i]), int(fps[where[i, j]])))
    return links


def _linked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links inside each posting; rows come sorted by posting, which may span batches."""
    for batch in whole_groups(batches):
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        cut = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
        sizes = np.diff(cut)
        two = cut[:-1][sizes == 2]
        near = _near(fps[two] ^ fps[two + 1], bits)
        links = list(zip(fps[two][near].tolist(), fps[two + 1][near].tolist(), strict=True))
        for start, size in zip(cut[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            links += forest(fps[start : start + size], bits)
        if links:
            both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _near(diff: np.ndarray, bits: int) -> np.ndarray:
    """The count filter, then the bits of what it leaves."""
    out = shared_bytes(diff) >= 8 - bits
    out[out] = popcount(diff[out]) <= bits
    return out


def near_links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): links that connect the fingerprints (_fp) within ``bits``, through the byte-position index."""
    masks = [sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(8), 7 - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posting = F.explode(F.array(*[F.xxhash64(F.col("_fp").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(signed)])).alias("_posting")
    posted = distinct.select(posting, "_fp").repartition("_posting").sortWithinPartitions("_posting")
    return posted.mapInArrow(lambda it: _linked(it, bits), "u bigint, v bigint")


def near_rows(held: Slabs, rows: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(a, b): links between those rows (_row) of stored texts whose fingerprints are within ``bits``. Rows of
    one fingerprint are linked to its first row, first rows by the links of their fingerprints."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, meta, data, offsets in slabs(batches):
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([meta.column(2)]), pa.array(fingerprints(data, offsets, shingle).view(np.int64))], ["_row", "_fp"])

    marked = held.blobs.mapInArrow(trimmed(kernel), "_row bigint, _fp bigint")
    marked = materialise(marked.join(rows.select(F.col("_row").alias("_r")), F.col("_row") == F.col("_r"), "left_semi"), "simhash-rows")
    distinct = materialise(marked.groupBy("_fp").agg(F.min("_row").alias("_first")), "simhash-first")
    one, two = (distinct.select(F.col("_fp").alias(f"_fp{k}"), F.col("_first").alias(k)) for k in "uv")
    same = marked.join(one, F.col("_fp") == F.col("_fpu")).where("_row != u").select(F.col("_row").alias("a"), F.col("u").alias("b"))
    links = near_links(distinct, bits).select(F.col("u").alias("_u"), F.col("v").alias("_v")).distinct()
    met = links.join(one, F.col("_u") == F.col("_fpu")).join(two, F.col("_v") == F.col("_fpv"))
    return same.union(met.select(F.greatest("u", "v"), F.least("u", "v"))).distinct()


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, bits: int = BITS, rows: str | None = None) -> DataFrame:
    """(_row, key, fingerprint, component_id, _part), one row per row of docs: component_id is the smallest key in reach, _part
    a number of the component that holds even where keys repeat."""
    slim = docs.select(F.col(text).alias("_text"), F.col(key).alias("_key"), *[F.col(r).alias("_row") for r in [rows] if r])
    slim = slim if rows else with_row(slim)
    kind = slim.schema["_key"].dataType.simpleString()
    kernel = _kernel if shingle == SHINGLE else _kernel_of(shingle)
    marked = materialise(map_arrow(slim, kernel, f"_key {kind}, _row bigint, _fp bigint"), "simhash")
    distinct = materialise(marked.groupBy("_fp").agg(F.min("_key").alias("_least")), "simhash-distinct")
    links = near_links(distinct, bits)
    part = components(links, "simhash-links")
    named = distinct.join(part, F.col("_fp") == F.col("node"), "left").select("_fp", "_least", F.coalesce("component", "_fp").alias("_part"))
    # the smallest key of a component: minima of minima, pre-aggregated
    least = named.groupBy("_part").agg(F.min("_least").alias("component_id"))
    of_fp = named.select("_fp", "_part").join(least, "_part").select(F.col("_fp").alias("_f"), "component_id", "_part")
    out = marked.join(of_fp, F.col("_fp") == F.col("_f"))
    return out.select("_row", F.col("_key").alias(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", "_part")


def _kernel_of(shingle: int):
    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in K.slices(batch, "_text"):
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(fingerprints(data, offsets, shingle).view(np.int64))], [*rows.schema.names[1:], "_fp"])

    return kernel


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each group of near-duplicates: texts whose sets of five-word shingles have
    a Jaccard similarity of 0.8 or more. The fingerprints' links within 3 bits come first, each checked on the
    shingles. Fingerprints cannot promise all such texts, as pairs at 0.8 differ in 4 to 14 bits and a shared
    byte is promised up to 7 only, so an exact set join adds what they leave apart."""
    return near_copies.dedup(docs, text, key, threshold, shingle, first=lambda held, rows: near_rows(held, rows, shingle))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop("_row", "_part")
