"""Near copies of whole texts by an exact set-similarity join over word shingles.

A text's set holds its distinct shingles: ``shingle`` consecutive words in lower case, or all its
words where it has fewer. Texts with a Jaccard similarity of ``threshold`` or more are linked; a group
is what links connect. Every such pair is found or its texts are in one group already.

1. Rarity: sets are counted in a fixed table of hashed slots (2**20, 8 MB however large the input),
   which gives one global order of shingles, rare slots first.
2. Equal sets, named by 128 bits of their shingles' hashes, collapse to their first row. The prefix of
   each set is posted under its shingles; inside a posting, pairs pass the length and the positional
   filter. Each set is paired with the first that passes, once a posting. Postings of frequent shingles
   are dealt to blocks (see set_join).
3. Pairs are verified on whole sets, read at their place in the texts, and give components. Rows that had
   more candidates, or a frequent shingle in their prefix, take a second round: candidates of other
   components, thinned out by a parity signature, are verified where they meet.

Edges: texts without words have the empty set and are copies of each other; repeated rows are texts of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm import set_join
from quarry.llm.common import forget, materialise, trimmed
from quarry.llm.components import components
from quarry.llm.set_join import EPS, across, block_of, first_round, other_parts
from quarry.llm.slabs import Slabs, slabs, stored, with_texts

SHINGLE, THRESHOLD, SLOT_BITS, PIECES, SIGNATURE = 5, 0.8, 20, 64, 16
_LOW = np.uint64((1 << (64 - SLOT_BITS)) - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, row of each, bounds by row)."""
    words = K.words_of(_LOWER[data], offsets)
    n = words.counts
    take = np.minimum(n, k)
    count = np.where(n > 0, n - take + 1, 0)
    first = np.repeat(words.first[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    token = K.span_hash(words.hashes(), first, first + np.repeat(take, count), K._Q)
    row = np.repeat(np.arange(len(n)), count)
    return _distinct(token, row, len(n))


def _distinct(token: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row = token[new], row[new]
    return token, row, np.searchsorted(row, np.arange(rows + 1))


def _slot(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def rarity(held: Slabs, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each slot, rarest first; sets that hold it, added up). Partial tables are summed piece by piece in the executors."""
    size = (1 << SLOT_BITS) // PIECES

    def rows(pieces: dict) -> Iterator[pa.RecordBatch]:
        for piece, counts in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["piece", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for _, _, data, offsets in slabs(batches):
            total += np.bincount(_slot(shingle_sets(data, offsets, shingle)[0]), minlength=1 << SLOT_BITS)
        yield from rows(dict(enumerate(total.reshape(PIECES, size))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(counts, np.int64)
        yield from rows(sums)

    schema = "piece int, counts binary"
    parts = held.blobs.mapInArrow(trimmed(count), schema).repartition(PIECES, "piece").mapInArrow(add, schema).collect()  # 64 rows of 128 KB
    total = np.zeros((PIECES, size), np.int64)
    for r in parts:
        total[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    rank = np.empty(1 << SLOT_BITS, np.int64)
    rank[np.argsort(total.ravel(), kind="stable")] = np.arange(1 << SLOT_BITS)
    return rank, total.ravel()


def sets_of(held: Slabs, rank: np.ndarray, blocks: np.ndarray, threshold: float, shingle: int) -> DataFrame:
    """(_key, _slab, _at, _row, _s1, _s2, _n, _prefix array<bigint>, _blocks array<int>) of every row."""
    shared = held.blobs.sparkSession.sparkContext.broadcast((rank.astype(np.int32), blocks.astype(np.int32)))  # 8 MB, a fixed size

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, blocks = shared.value
        for slab, rows, data, offsets in slabs(batches):
            token, row, bounds = shingle_sets(data, offsets, shingle)
            n = np.diff(bounds)
            full, name = np.flatnonzero(n), [np.zeros(len(n), np.uint64) for _ in range(2)]
            if len(full):
                for k, seed in enumerate((K._P, K._R)):
                    name[k][full] = K.mix(np.add.reduceat(K.mix(token ^ seed), bounds[:-1][full]) + n[full].astype(np.uint64))
            # the rank stands in for the slot, so that a code is as good as its hash and sorts by rarity
            code = rank[_slot(token)].astype(np.uint64) << np.uint64(64 - SLOT_BITS) | token & _LOW
            order = np.lexsort((code, row))
            prefix = np.where(n > 0, n - np.ceil(threshold * n - EPS).astype(np.int64) + 1, 0)
            ends = np.cumsum(prefix)
            take = order[np.arange(ends[-1]) + np.repeat(bounds[:-1] - (ends - prefix), prefix)]
            bounds_ = pa.array(np.append(0, ends), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds_, pa.array(x)) for x in (code[take].view(np.int64), blocks[_slot(token[take])])]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([rows.column(1)]), pa.array(np.full(len(n), slab), pa.int64()), pa.array(np.arange(len(n)), pa.int32()), pa.concat_arrays([rows.column(2)]), *(pa.array(x.view(np.int64)) for x in name), pa.array(n, pa.int32()), *lists],
                ["_key", "_slab", "_at", "_row", "_s1", "_s2", "_n", "_prefix", "_blocks"],
            )

    return held.blobs.mapInArrow(trimmed(kernel), f"_key {held.kind}, _slab bigint, _at int, _row bigint, _s1 bigint, _s2 bigint, _n int, _prefix array<bigint>, _blocks array<int>")


def _whole(shingle: int):
    """(row, its distinct shingles, their parity signature) of the wanted rows of a slab."""

    def kernel(rows: pa.RecordBatch, words: K.Words, at: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, _, bounds = shingle_sets(words.data, words.offsets, shingle)
        for i, row in zip(at.tolist(), own.tolist(), strict=True):
            part = token[bounds[i] : bounds[i + 1]]
            odd = np.bincount((part % np.uint64(64 * SIGNATURE)).astype(np.int64), minlength=64 * SIGNATURE) & 1
            sig = np.packbits(odd.astype(bool)).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (part.view(np.int64), sig)]
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *lists], ["_own", "_tokens", "_sig"])

    return kernel


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """(u, v): the pairs that reach the threshold."""
    one, two = (words.select(F.col("_own").alias(f"_own{k}"), F.col("_tokens").alias(f"_tokens{k}")) for k in (1, 2))
    both = pairs.join(one, F.col("a") == F.col("_own1")).join(two, F.col("b") == F.col("_own2"))
    common = F.size(F.array_intersect("_tokens1", "_tokens2"))
    alike = common >= F.lit(threshold) * (F.size("_tokens1") + F.size("_tokens2") - common) - F.lit(EPS)
    return both.where(alike).select(F.col("a").alias("u"), F.col("b").alias("v"))


First = Callable[[Slabs, DataFrame], DataFrame]


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    one, two = (part.select(F.col("node").alias(f"_n{k}"), F.col("component").alias(f"_c{k}")) for k in (1, 2))
    both = pairs.join(one, F.col("a") == F.col("_n1"), "left").join(two, F.col("b") == F.col("_n2"), "left")
    return both.where(F.coalesce("_c1", "a") != F.coalesce("_c2", "b")).select("a", "b")


def groups(held: Slabs, threshold: float = THRESHOLD, shingle: int = SHINGLE, block: int | None = None, first: First | None = None) -> DataFrame:
    """(_slab, _at, _row, _key, _part) of every row: _part is the first row of its group's sets. block: rows
    of a posting that stay together. first: candidates (a, b) of another method among the rows of distinct
    sets, which are verified and linked before the set join's; it need not check what they have linked."""
    spark = held.blobs.sparkSession
    rank, seen = rarity(held, shingle)
    most = block or set_join.block_size(int(seen.sum()), int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = materialise(sets_of(held, rank, -(-seen // most), threshold, shingle), "near-sets")
    sets = materialise(every.groupBy("_s1", "_s2").agg(F.min("_row").alias("_first")), "near-distinct").withColumnsRenamed({"_s1": "_t1", "_s2": "_t2"})
    same = (F.col("_s1") == F.col("_t1")) & (F.col("_s2") == F.col("_t2"))
    firsts = every.join(sets, same).where("_row = _first")
    long = firsts.select(F.posexplode(F.arrays_zip("_prefix", "_blocks")).alias("pos", "_p"), F.col("_row").alias("a"), F.col("_n").alias("n"))
    long = long.select(F.col("_p._prefix").alias("token"), F.col("_p._blocks").alias("blocks"), "pos", "a", "n")
    dealt = F.when(F.col("blocks") > 1, F.xxhash64("token", block_of(F.col("a"), F.col("blocks")))).otherwise(F.col("token")).alias("token")
    posted = long.select(dealt, "n", "pos", "a").repartition("token").sortWithinPartitions("token", "n")
    found = materialise(first_round(posted, threshold), "near-candidates")
    spread = materialise(long.where("blocks > 1"), "near-spread")
    pairs, dense = found.where("b is not null").select("a", "b").distinct(), found.where("b is null")
    guessed = materialise(first(held, firsts.select("_row")).select("a", "b"), "near-first") if first else pairs.limit(0)
    wanted = found.select(F.col("a").alias("_w")).union(pairs.select("b")).union(spread.select("a")).union(guessed.select("a")).union(guessed.select("b")).distinct()
    wanted = every.select("_slab", "_at", "_row").join(wanted, F.col("_row") == F.col("_w")).drop("_w")
    words = materialise(with_texts(held, wanted, ["_at", "_row"], _whole(shingle), "_own bigint, _tokens array<bigint>, _sig array<bigint>"), "near-words")
    if first:
        sure = materialise(_verified(guessed, words, threshold), "near-sure")
        rest = _apart(pairs, components(sure, "near-sure-parts"))
        links = materialise(sure.union(_verified(rest, words, threshold)), "near-links")
    else:
        links = materialise(_verified(pairs, words, threshold), "near-links")
    pairs = pairs.union(guessed)
    part = components(links, "near-parts")
    asked, each = found.where("b is null and open").select("a").distinct(), 4
    while True:
        named = part.select("node", F.col("component").alias("_c"))
        parted = lambda df: df.join(named, F.col("a") == F.col("node"), "left").withColumn("part", F.coalesce("_c", "a")).drop("_c", "node")  # noqa: B023, E731
        near = parted(dense.drop("b", "open")).withColumn("group", F.col("token"))
        near = near.join(asked.withColumnRenamed("a", "_x"), F.col("a") == F.col("_x"), "left").withColumn("open", F.col("_x").isNotNull())
        # links only count between parts, so the largest part of a frequent posting need not ask
        far = parted(spread)
        silent = far.groupBy("token", "part").agg(F.count(F.lit(1)).alias("_n")).groupBy("token").agg(F.max(F.struct("_n", "part"))["part"].alias("_silent")).withColumnRenamed("token", "_k")
        far_asked = far.join(silent, F.col("token") == F.col("_k")).where(F.col("part") != F.col("_silent")).drop("_k", "_silent")
        if each > 4:
            far_asked = far_asked.join(asked.withColumnRenamed("a", "_x"), F.col("a") == F.col("_x"), "left_semi")
        columns = ["group", "n", "pos", "a", "open", "part"]
        rows = materialise(near.select(columns).union(across(far, far_asked, most).select(columns)), "near-rows")
        # groups of one part have nothing to link
        mixed = rows.groupBy("group").agg(F.min("part").alias("_l"), F.max("part").alias("_h"), F.max("open").alias("_o")).where("_l != _h and _o").select(F.col("group").alias("_g"))
        rows = rows.join(mixed, F.col("group") == F.col("_g"), "left_semi").join(words.select("_own", "_sig"), F.col("a") == F.col("_own"))
        rows = rows.select(*columns, *[F.col("_sig")[k].alias(f"sig{k}") for k in range(SIGNATURE)])
        out = materialise(other_parts(rows, threshold, SIGNATURE, each), "near-more")
        tried = pairs
        pairs = materialise(tried.union(out.select(F.greatest("a", "b"), F.least("a", "b"))).distinct(), "near-pairs")
        fresh = pairs.join(tried, ["a", "b"], "left_anti")
        if fresh.isEmpty():
            break
        links = materialise(links.union(_verified(fresh, words, threshold)), "near-links")
        part = components(links, "near-parts")
        asked, each = materialise(out.where("more").select("a").distinct(), "near-asked"), each * 1024
        if asked.isEmpty():
            break
    forget(words)
    named = every.select("_slab", "_at", "_row", "_key", "_s1", "_s2").join(sets, same).join(part, F.col("_first") == F.col("node"), "left")
    return named.select("_slab", "_at", "_row", "_key", F.coalesce("component", "_first").alias("_part"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, shingle: int = SHINGLE, block: int | None = None, first: First | None = None) -> DataFrame:
    """docs with one document of each group: the one with the smallest key, the first row of equal ones."""
    held = stored(docs, text, key, docs.columns)
    found = materialise(groups(held, threshold, shingle, block, first), "near-groups")
    place = F.struct(F.col("_key").isNull(), "_key", "_row")
    first = found.groupBy("_part").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_part").alias("_p"), F.col("_first._row").alias("_stays"))
    gone = materialise(found.join(first, F.col("_part") == F.col("_p")).where("_row != _stays").select("_slab", "_at"), "near-gone")

    def left(rows: pa.RecordBatch, words: K.Words, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        stays = np.ones(rows.num_rows, bool)
        stays[at] = False
        yield pa.RecordBatch.from_arrays(list(rows.columns[3:]), rows.schema.names[3:]).filter(pa.array(stays))

    out = with_texts(held, gone, ["_at"], left, ", ".join(held.fields), "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
