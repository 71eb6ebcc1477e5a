"""Repeated-substring removal by de Bruijn compaction in minimiser space.

The edges of the graph are the k-mers of ``WINDOW`` tokens; a window is removed where its edge occurs
anywhere else. Edges are never shuffled one by one:

1. Compaction inside documents: consecutive edges that share their minimiser (the smallest token
   ``SEED``-gram) form one path, a super-k-mer. Equal edges always have the same minimiser, so paths of
   minimisers seen once are dropped by a join.
2. Source coordinates verify: the words of each path are read at its place in the text and named by
   their 128-bit BLAKE2b digest. Paths of equal digest collapse into one with a count. One with a count
   of two or more is a repeated nonbranching path: all its edges repeat. A path seen once whose
   minimiser also begins others branches, and only branching paths are opened.
3. Opening goes back to the words at the source coordinates of one occurrence of each branching
   path and names each of its edges by two independent 64-bit hashes; edge counts come back to the
   paths as a bit mask.
4. Masks join the occurrences, return to the documents as word spans, and the spans are cut out.

Nothing is decided on what is left: all windows are judged on the input. Minima, counts and masks
are pre-aggregated before their shuffle, and the joins on minimisers, paths and edges deal both
sides by key, so that a hot passage can be split. The texts are written once as slabs.

Edges of use: null and empty texts have no words; texts under WINDOW words have no window and stay;
repeated rows are documents of their own and so repeat each other; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import materialise, table
from quarry.llm.slabs import Slabs, per_slab, stored, with_texts

WINDOW, SEED = 35, 8


def paths(words: K.Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, content, first window, number of windows) of every super-k-mer of a slab."""
    hashes = words.hashes()
    n, w = len(hashes), window - seed + 1
    none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if n < window:
        return none
    gram, valid = K.grams(hashes, words.first, seed)
    low = K.sliding_min(gram, w)
    last = np.repeat(words.first[1:], words.counts)  # end of the row of each word
    at = np.flatnonzero(np.arange(n - window + 1) + window <= last[: n - window + 1])
    if not len(at):
        return none
    m = low[at]
    new = np.append(True, (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1))
    new[1:] |= at[1:] == words.first[np.searchsorted(words.first, at[1:], "right") - 1]  # a row begins
    cut = np.flatnonzero(new)
    # A path ends with the occurrence of its minimiser: windows from there on that have an equal one
    # further right (texts with short periods) are cut by the leftmost occurrence in each of them.
    size = np.diff(np.append(cut, len(at)))
    bad = np.flatnonzero(size > _leftmost(gram, at[cut], m[cut], w) - at[cut] + 1)
    if len(bad):
        inner = np.repeat(cut[bad], size[bad]) + np.arange(size[bad].sum()) - np.repeat(np.cumsum(size[bad]) - size[bad], size[bad])
        spot = _leftmost(gram, at[inner], m[inner], w)
        new[inner[1:][spot[1:] != spot[:-1]]] = True
        cut = np.flatnonzero(new)
        size = np.diff(np.append(cut, len(at)))
    first = at[cut]
    return m[cut], K.span_hash(hashes, first, first + size + window - 1, K._Q), first, size


def _leftmost(gram: np.ndarray, at: np.ndarray, value: np.ndarray, w: int) -> np.ndarray:
    """The first position from each at on, within w, that holds the value."""
    out, left = at.copy(), np.arange(len(at))
    for step in range(w):
        left = left[gram[at[left] + step] != value[left]]
        if not len(left):
            break
        out[left] = at[left] + step + 1
    return out


def _counted(window: int, seed: int):
    def kernel(slab: int, words: K.Words) -> list[pa.Array]:
        m, c, _, _ = paths(words, window, seed)
        _, one, n = np.unique(c, return_index=True, return_counts=True)
        return [pa.array(m[one].view(np.int64)), pa.array(c[one].view(np.int64)), pa.array(n, pa.int64())]

    return kernel


def _placed(window: int, seed: int):
    def kernel(slab: int, words: K.Words) -> list[pa.Array]:
        m, _, first, size = paths(words, window, seed)
        name = words.digests(first, first + size + window - 1)
        return [pa.array(np.full(len(m), slab), pa.int64()), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(m.view(np.int64)), pa.array(name[:, 0]), pa.array(name[:, 1])]

    return kernel


def _opened(window: int):
    def kernel(rows: pa.RecordBatch, words: K.Words, at: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        bounds = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
        edges = []
        for base in (K._P, K._R):
            edge = K.span_hash(words.hashes(base), starts, starts + window, base)
            edges.append(pa.ListArray.from_arrays(bounds, pa.array(edge.view(np.int64))))
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(n, pa.int64()), *edges], ["_c", "_d", "_n", "_e1", "_e2"])

    return kernel


def repeated(held: Slabs, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(_slab, _at, _mask): bit i of the mask says that the window at word _at + i of the slab
    occurs elsewhere. No column holds nulls."""
    seen = per_slab(held, _counted(window, seed), "_m bigint, _c bigint, _n bigint")
    shared = seen.groupBy("_m").agg(F.sum("_n").alias("_t"), F.min("_c").alias("_a"), F.max("_c").alias("_b")).where("_t > 1").select(F.col("_m").alias("_k"), (F.col("_a") != F.col("_b")).alias("_branches"))
    shared = materialise(shared, "path-minimisers")  # on its own, so that both sides of the join are dealt by it and a hot minimiser can be split
    placed = per_slab(held, _placed(window, seed), "_slab bigint, _at int, _size int, _m bigint, _c bigint, _d bigint")
    found = materialise(placed.join(shared, F.col("_m") == F.col("_k")).drop("_k", "_m"), "paths")
    kinds = found.groupBy("_c", "_d").agg(F.count(F.lit(1)).alias("_n"), F.first("_slab").alias("_slab"), F.first("_at").alias("_at"), F.first("_size").alias("_size"), F.first("_branches").alias("_branches"))
    kinds = materialise(kinds, "path-kinds")
    opened = with_texts(held, kinds.where("_branches"), ["_at", "_size", "_c", "_d", "_n"], _opened(window), "_c bigint, _d bigint, _n bigint, _e1 array<bigint>, _e2 array<bigint>")
    opened = materialise(opened, "path-edges")
    edge = F.explode(F.arrays_zip("_e1", "_e2")).alias("_e")
    edges = opened.select("_n", edge).groupBy(F.col("_e._e1").alias("_p"), F.col("_e._e2").alias("_q")).agg(F.sum("_n").alias("_t")).where("_t > 1").drop("_t")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    single = opened.where("_n = 1").select("_c", "_d", F.posexplode(F.arrays_zip("_e1", "_e2")).alias("_i", "_o"))
    partial = single.join(edges, (F.col("_o._e1") == F.col("_p")) & (F.col("_o._e2") == F.col("_q"))).groupBy("_c", "_d").agg(F.bit_or(bit(F.col("_i"))).alias("_mask"))
    whole = kinds.where("_n > 1").select("_c", "_d", (bit(F.col("_size")) - 1).alias("_mask"))
    masks = materialise(whole.union(partial), "path-masks").withColumnsRenamed({"_c": "_c1", "_d": "_d1"})
    return found.join(masks, (F.col("_c") == F.col("_c1")) & (F.col("_d") == F.col("_d1"))).select("_slab", "_at", "_mask")


def covered(words: K.Words, at: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which words of a slab lie in a repeated window."""
    n = len(words.starts)
    step = np.zeros(n + 1, np.int64)
    for bit in range(64):
        hit = at[(mask >> bit) & 1 == 1] + bit
        if len(hit):
            np.add.at(step, hit, 1)
            np.add.at(step, hit + window, -1)
    return np.cumsum(step)[:n] > 0


def kept_bytes(words: K.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row joined by one space: (bytes, row offsets)."""
    chosen = np.flatnonzero(keep)
    starts, sizes = words.starts[chosen], words.ends[chosen] - words.starts[chosen]
    total = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.full(total[-1], 32, np.uint8)
    inner = np.concatenate(([0], np.cumsum(sizes)))
    step = np.arange(inner[-1])
    out[step + np.repeat(total[:-1] - inner[:-1], sizes)] = words.data[step + np.repeat(starts - inner[:-1], sizes)]
    return out, total[np.searchsorted(chosen, words.first)]


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, seed: int = SEED, texts: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept_text]) for every row of docs."""
    held = stored(docs, text, key)

    def cut(rows: pa.RecordBatch, words: K.Words, at: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        gone = covered(words, at, mask.astype(np.int64), window)
        total = np.concatenate(([0], np.cumsum(gone)))
        out, offsets = kept_bytes(words, ~gone)
        raw, ends = out.tobytes(), np.maximum(offsets[:-1], offsets[1:] - 1)
        parts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), ends.tolist(), strict=True)]
        columns = [rows.column(1), pa.array(words.counts, pa.int64()), pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
        if texts:
            columns.append(pa.array([p.decode() for p in parts], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, ["_key", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts])

    schema = f"_key {held.kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts
    return with_texts(held, repeated(held, window, seed), ["_at", "_mask"], cut, schema, "left").withColumnRenamed("_key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
e AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT e.r, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e LEFT JOIN gone ON e.r = gone.r AND e.i = gone.i WHERE gone.r IS NULL GROUP BY e.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
"""
