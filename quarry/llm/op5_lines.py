"""Near-duplicate line removal by an exact set-similarity join.

A line's tokens are the distinct words in it. A line is removed if an earlier line, by (document
key, row, line), has a Jaccard similarity of ``threshold`` or more to it; equal sets are the case of
similarity 1. Lines without a word stay.

1. A first pass names the set of each line by 128 bits of its tokens' hashes; equal sets collapse to their
   earliest line by a grouped minimum. Sets are numbered in the order of these lines. The same pass counts
   the words of all texts in a fixed table of hashed slots (2**18, 2 MB however large the input), which
   gives one global order, rare slots first.
2. A second pass reads the earliest line of each set and puts its tokens in that order.
3. The prefix of each set is posted under its tokens. Inside a posting, sets pass the length filter,
   the positional filter and a parity signature (a bound on the symmetric difference). A set is
   paired with the earliest that passes, once a posting, so pairs grow with the postings. The postings
   of frequent words are dealt to blocks (see set_join).
4. Pairs are verified on the words at their source coordinates. Sets that are still unmatched but had
   more candidates in some posting, or a frequent word in their prefix, take a second round in which
   candidates are verified where they meet.

Edges: null or empty texts have no lines with words; repeated rows are later documents; null keys
come last; an empty table gives none; very long lines are sets like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm import set_join
from quarry.llm.common import forget, materialise, table, trimmed
from quarry.llm.set_join import EPS, across, block_of, first_round, second_round
from quarry.llm.slabs import Slabs, opened, sealed, slabs, stored, with_texts

THRESHOLD, SLOT_BITS, PIECES, PASSES = 0.8, 18, 64, 2
POSTINGS = 1 << 15  # rows of a batch: postings are narrow, and each step of the first round takes a batch
POSTED = [f"_{c}{k}" for k in range(PASSES) for c in ("tokens", "pos")] + ["_far", "_fpos", "_blocks"]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def named(held: Slabs) -> DataFrame:
    """(_key, _slab, _line, _s1, _s2, _piece, _counts): the lines with words and the names of their sets, and,
    from the same pass, rows of counts alone: the words that a task has met in each slot, in pieces."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_order = np.zeros(1 << SLOT_BITS, np.int64), np.arange(1 << SLOT_BITS)
        for slab, rows, data, offsets in slabs(batches):
            words = K.words_of(data, offsets)
            hashes, (_, row) = words.hashes(), line_bounds(words)
            total += np.bincount(_slot(hashes), minlength=1 << SLOT_BITS)
            token, bounds = line_sets(words, any_order, hashes)
            n = np.diff(bounds)
            line = np.flatnonzero(n)
            size, at = n[line], bounds[:-1][line]
            # the name does not depend on the order, which differs between inputs
            name = [K.mix(np.add.reduceat(x, at) + size.astype(np.uint64)) if len(line) else np.empty(0, np.uint64) for x in (token, K.mix(token ^ K._R))]
            yield pa.RecordBatch.from_arrays(
                [rows.column(1).take(pa.array(row[line])), pa.array(np.full(len(line), slab), pa.int64()), pa.array(line, pa.int32()), *(pa.array(x.view(np.int64)) for x in name), pa.nulls(len(line), pa.int32()), pa.nulls(len(line), pa.binary())], names
            )
            kind = rows.schema.field(1).type
        if total.any():
            counts = pa.array([x.tobytes() for x in total.reshape(PIECES, -1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(PIECES, t) for t in (kind, pa.int64(), pa.int32(), pa.int64(), pa.int64())), pa.array(np.arange(PIECES), pa.int32()), counts], names)

    names = ["_key", "_slab", "_line", "_s1", "_s2", "_piece", "_counts"]
    return held.blobs.mapInArrow(trimmed(kernel), f"_key {held.kind}, _slab bigint, _line int, _s1 bigint, _s2 bigint, _piece int, _counts binary")


def rarity(held: Slabs, counted: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each slot, rarest first; words in each). Partial tables are summed piece by piece in the executors.
    counted: what named() gives, if it is there."""
    size = (1 << SLOT_BITS) // PIECES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(counts, np.int64)
        for piece, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["piece", "counts"])

    counts = (named(held) if counted is None else counted).where("_piece is not null").select("_piece", "_counts")
    parts = counts.repartition(PIECES, "_piece").mapInArrow(add, "piece int, counts binary").collect()  # 64 rows of 32 KB
    total = np.zeros((PIECES, size), np.int64)
    for r in parts:
        total[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    rank = np.empty(1 << SLOT_BITS, np.int64)
    rank[np.argsort(total.ravel(), kind="stable")] = np.arange(1 << SLOT_BITS)
    return rank, total.ravel()


def line_bounds(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes at which lines begin, row of each); lines are cut at \\n, every row has one at least."""
    return _bounds(words.data, words.offsets)


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1))
    begin = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((begin, row))
    return begin[order], row[order]


def line_sets(words: K.Words, rank: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens by line, rarest slot first; bounds by line). A token is the hash of a word, and the
    order is that of (rank of the slot, low bits, hash) in all lines. hashes: those of the words, if known."""
    begin, _ = line_bounds(words)
    hashes = words.hashes() if hashes is None else hashes
    line = np.repeat(np.arange(len(begin)), np.diff(np.searchsorted(words.starts, begin), append=len(words.starts)))
    place, low = rank[_slot(hashes)].astype(np.uint64), hashes & np.uint64((1 << 26) - 1)
    token = None
    if len(begin) < 1 << 20:  # all in one number
        key = line.astype(np.uint64) << np.uint64(44) | place << np.uint64(26) | low
        order = np.argsort(key)
        ranked, token = key[order], hashes[order]
        new = np.ones(len(token), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if (new[1:] != (token[1:] != token[:-1]))[~new[1:]].any():
            token = None  # two words share a place
        else:
            line = (ranked[new] >> np.uint64(44)).astype(np.int64)
    if token is None:
        order = np.lexsort((hashes, low, place, line))
        line, token = line[order], hashes[order]
        new = np.ones(len(token), bool)
        new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
        line = line[new]
    token = token[new]
    return token, np.searchsorted(line, np.arange(len(begin) + 1))


def picked(data: np.ndarray, offsets: np.ndarray, line: np.ndarray) -> K.Words:
    """The words of some lines, in ascending order, each of which is a row of its own."""
    begin, _ = _bounds(data, offsets)
    size, keep = np.diff(begin, append=len(data)), np.zeros(len(begin), bool)
    keep[line] = True
    size[:-1] -= data[begin[1:] - 1] == 10 if len(data) else 0  # without line breaks
    keep = np.repeat(keep, np.diff(begin, append=len(data)))
    keep &= data != 10
    return K.words_of(data[keep], np.append(0, np.cumsum(np.maximum(size[line], 0))))


def lines(held: Slabs, rank: np.ndarray, blocks: np.ndarray, threshold: float = THRESHOLD, wanted: DataFrame | None = None) -> DataFrame:
    """(a, _n, _sig0, _sig1, _tokens0, _pos0, ..., _far, _fpos, _blocks) of all lines with words, a being their place
    in the slab: number of tokens, a parity signature of 128 bits; posted tokens and their places, those of
    each pass apart, and those whose postings are dealt to blocks, with the blocks. wanted: only these lines
    (_slab, _line, a), those of a slab sealed as one _rows, which long() takes."""
    shared = held.blobs.sparkSession.sparkContext.broadcast((rank, blocks.astype(np.int32)))  # 3 MB, a fixed size

    def posted(words: K.Words, own: np.ndarray | None) -> pa.RecordBatch:
        rank, blocks = shared.value
        token, bounds = line_sets(words, rank)
        n = np.diff(bounds)
        line = np.flatnonzero(n)
        size, at = n[line], bounds[:-1][line]
        bit, side = np.uint64(1) << (token & np.uint64(63)), (token >> np.uint64(6)) & np.uint64(1)
        half = [bit * (side ^ np.uint64(1)), bit * side]
        parity = [np.bitwise_xor.reduceat(h, at) if len(line) else h for h in half]
        prefix = size - np.ceil(threshold * size - EPS).astype(np.int64) + 1
        ends = np.cumsum(prefix)
        take = token[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - prefix), prefix)]
        codes = (K.mix(take) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        owner, dealt = np.repeat(np.arange(len(line)), prefix), blocks[_slot(take)]
        pos = (np.arange(len(take)) - (ends - prefix)[owner]).astype(np.int32)
        part, lists = np.where(dealt > 1, PASSES, np.mod(codes, PASSES)), []
        for k in range(PASSES + 1):
            mine = np.flatnonzero(part == k)
            cuts = pa.array(np.append(0, np.cumsum(np.bincount(owner[mine], minlength=len(line)))), pa.int32())
            lists += [pa.ListArray.from_arrays(cuts, pa.array(x[mine])) for x in (codes, pos, dealt)[: 3 if k == PASSES else 2]]
        return pa.RecordBatch.from_arrays([pa.array(line if own is None else own[line], pa.int64()), pa.array(size, pa.int32()), *(pa.array(x.view(np.int64)) for x in parity), *lists], ["a", "_n", "_sig0", "_sig1", *POSTED])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data, offsets in slabs(batches):
            yield posted(K.words_of(data, offsets), None)

    def some(rows: pa.RecordBatch, texts: tuple[np.ndarray, np.ndarray], line: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(line)
        found = posted(picked(*texts, line[order]), own[order])
        yield pa.RecordBatch.from_arrays([pa.array([sealed(found, 1)], pa.binary())], ["_rows"])

    if wanted is not None:
        return with_texts(held, wanted, ["_line", "a"], some, "_rows binary", cut=lambda *texts: texts)
    return held.blobs.mapInArrow(trimmed(whole), "a bigint, _n int, _sig0 bigint, _sig1 bigint, " + ", ".join(f"{c} array<int>" for c in POSTED))


def long(posted: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """(columns..., a, n, sig0, sig1): a row for each item of the lists of these names. posted: sealed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows = opened(blob)
                lists = [rows.column(name) for name in names]
                each = pa.array(np.repeat(np.arange(rows.num_rows), lists[0].value_lengths().to_numpy(zero_copy_only=False)))
                if len(each):
                    yield pa.RecordBatch.from_arrays([*(x.flatten() for x in lists), *(rows.column(c).take(each) for c in ("a", "_n", "_sig0", "_sig1"))], [*columns, "a", "n", "sig0", "sig1"])

    return posted.mapInArrow(trimmed(run), ", ".join(f"{c} int" for c in columns) + ", a bigint, n int, sig0 bigint, sig1 bigint")


def _tokens(rows: pa.RecordBatch, texts: tuple[np.ndarray, np.ndarray], line: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(set, its distinct tokens) of the wanted lines, read at their place in the text."""
    order = np.argsort(line)
    line, own = line[order], own[order]
    chosen = picked(*texts, line)
    token = chosen.hashes()
    owner = np.repeat(np.arange(len(line)), chosen.counts)
    by = np.lexsort((token, owner))
    token, owner = token[by], owner[by]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    bounds = np.searchsorted(owner[new], np.arange(len(line) + 1)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(token[new].view(np.int64)))], ["_set", "_tokens"])


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Sets (a) with a set (b) at threshold or more among the pairs. words: (_set, _tokens)."""
    one, two = (words.select(*[F.col(c).alias(f"{c}{k}") for c in words.columns]) for k in (1, 2))
    both = pairs.join(one, F.col("a") == F.col("_set1")).join(two, F.col("b") == F.col("_set2"))
    common = F.size(F.array_intersect("_tokens1", "_tokens2"))
    alike = common >= F.lit(threshold) * (F.size("_tokens1") + F.size("_tokens2") - common) - F.lit(EPS)
    return both.where(alike).select("a").distinct()


def removed(held: Slabs, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """(_slab, _line) of the lines to remove, without nulls. block: rows of a posting that stay together."""
    spark = held.blobs.sparkSession
    every = materialise(named(held), "lines")
    rank, words = rarity(held, every)
    every = every.where("_piece is null").drop("_piece", "_counts")
    # a word is in no more lines than it is in the texts, so this bounds its posting
    most = block or set_join.block_size(int(words.sum()), int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.struct(F.col("_key").isNull().alias("_none"), "_key", "_slab", "_line")
    least = materialise(every.groupBy("_s1", "_s2").agg(F.min(place).alias("_first")), "line-firsts")
    # numbers in the order of the first lines: an earlier set has a smaller number
    order = [F.col("_first._key").asc_nulls_last(), F.col("_first._slab"), F.col("_first._line")]  # that of the struct
    sets = least.repartitionByRange(*order).sortWithinPartitions(*order)
    sets = materialise(sets.select("_s1", "_s2", F.col("_first._slab").alias("_fs"), F.col("_first._line").alias("_fl"), F.monotonically_increasing_id().alias("a")), "line-sets")
    forget(least)
    # only the earliest line of each set is posted
    firsts = lines(held, rank, -(-words // most), threshold, sets.select(F.col("_fs").alias("_slab"), F.col("_fl").alias("_line"), "a"))
    firsts = materialise(firsts, "line-posted")
    spread = long(firsts, ["_far", "_fpos", "_blocks"], ["token", "pos", "blocks"]).withColumn("token", F.col("token").cast("bigint"))
    spread = materialise(spread, "line-spread")
    found = None
    for part in range(PASSES):  # some of the tokens at a time: the postings on disk are several times the sets
        own = F.pmod("token", F.lit(PASSES)) == part
        dealt = spread.where(own).withColumn("token", F.hash("token", block_of(F.col("a"), F.col("blocks"))))
        columns = ["token", "n", "pos", "a", "sig0", "sig1"]
        posted = long(firsts, [f"_tokens{part}", f"_pos{part}"], ["token", "pos"]).select(columns).union(dealt.select(columns)).repartition("token")
        # one number as the sort key: Spark sorts it by radix
        posted = posted.sortWithinPartitions(F.shiftleft(F.col("token").cast("bigint"), 32).bitwiseOR(F.col("n").cast("bigint")))
        some = materialise(first_round(posted, threshold, 2), "line-candidates", batch=POSTINGS)
        found = some if found is None else found.union(some)
    pairs, dense = found.where("b is not null").select("a", "b"), found.where("b is null")
    # the words of all sets that either round may ask for, in one pass over the texts
    wanted = found.select(F.col("a").alias("_w")).union(pairs.select("b")).union(spread.select("a")).distinct().join(sets, F.col("_w") == F.col("a"))
    texts = with_texts(held, wanted.select(F.col("_fs").alias("_slab"), F.col("_fl").alias("_line"), F.col("a").alias("_set")), ["_line", "_set"], _tokens, "_set bigint, _tokens array<bigint>", cut=lambda *texts: texts)
    texts = materialise(texts, "line-words")
    # the candidate that most postings name first, then the others of what is left
    votes = materialise(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "line-votes")
    likely = votes.groupBy("a").agg(F.max(F.struct("n", "b")).alias("_best")).select("a", F.col("_best.b").alias("b"))
    gone = materialise(_verified(likely, texts, threshold), "line-matches")
    others = votes.select("a", "b").join(gone, "a", "left_anti").join(likely, ["a", "b"], "left_anti")
    gone = materialise(gone.union(_verified(others, texts, threshold)), "line-matches")
    forget(votes)
    still = dense.where("open").select("a").union(spread.select("a")).distinct().join(gone, "a", "left_anti").select(F.col("a").alias("still"))
    still = materialise(still, "line-open")
    if not still.isEmpty():
        marked = dense.join(still, F.col("a") == F.col("still"), "left").withColumn("open", F.col("still").isNotNull())
        asked = marked.where("open").select(F.col("token").alias("_t")).distinct()
        near = marked.join(asked, F.col("token") == F.col("_t"), "left_semi").withColumn("group", F.col("token"))
        columns = ["group", "n", "pos", "a", "open", "sig0", "sig1"]
        rows = near.select(columns).union(across(spread, spread.join(still, F.col("a") == F.col("still"), "left_semi"), most).select(columns)).join(texts, F.col("a") == F.col("_set"))
        rows = rows.select("group", "n", "pos", "a", "open", F.col("_tokens").alias("tokens"), "sig0", "sig1")
        gone = materialise(gone.union(second_round(rows, threshold, 2).select("a")).distinct(), "line-matches")
    state = materialise(sets.join(gone.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a"), "left").select(F.col("_s1").alias("_t1"), F.col("_s2").alias("_t2"), "_fs", "_fl", F.col("_a").isNotNull().alias("_gone")), "line-states")
    judged = every.select("_slab", "_line", "_s1", "_s2").join(state, (F.col("_s1") == F.col("_t1")) & (F.col("_s2") == F.col("_t2")))
    return judged.where(F.col("_gone") | (F.col("_slab") != F.col("_fs")) | (F.col("_line") != F.col("_fl"))).select("_slab", "_line")


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """(key, n_lines, n_removed, removed array<int>): the removed lines of every row, from 0."""
    held = stored(docs, text, key)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, rows, data, offsets in slabs(batches):
            _, row = _bounds(data, offsets)
            n = np.bincount(row, minlength=rows.num_rows)
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int64()), whole(pa.concat_arrays([rows.column(1)])), whole(pa.array(n, pa.int32()))], ["_slab", "_keys", "_counts"])

    texts = held.blobs.mapInArrow(trimmed(rows_of), f"_slab bigint, _keys array<{held.kind}>, _counts array<int>")
    gone = removed(held, threshold, block).groupBy("_slab").agg(F.collect_list("_line").alias("_lines"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, n = batch.column(0)[i].values, batch.column(1)[i].values.to_numpy().astype(np.int64)
                line = batch.column(2)[i].values
                line = np.sort(np.empty(0, np.int64) if line is None else line.to_numpy().astype(np.int64))
                first = np.concatenate(([0], np.cumsum(n)))
                bounds = np.searchsorted(line, first)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(line - np.repeat(first[:-1], np.diff(bounds)), pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(np.diff(bounds), pa.int64()), lists], ["_key", "n_lines", "n_removed", "removed"])

    out = texts.join(gone, "_slab", "left").select("_keys", "_counts", "_lines").mapInArrow(merged, f"_key {held.kind}, n_lines bigint, n_removed bigint, removed array<int>")
    return out.withColumnRenamed("_key", key)


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the removed lines; documents that had words and lose them all go. Columns stay."""
    held = stored(docs, text, key, docs.columns)
    at = docs.columns.index(text)

    def cut(rows: pa.RecordBatch, words: K.Words, line: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin, row = line_bounds(words)
        gone = np.zeros(len(begin), bool)
        gone[line] = True
        stop = np.append(begin[1:], len(words.data))  # a line holds its line break, if it has one
        keep = np.repeat(~gone, stop - begin)
        # where the last lines of a row go, the break before them goes too
        last = np.full(rows.num_rows, -1)
        np.maximum.at(last, row[~gone], np.flatnonzero(~gone))
        end = np.searchsorted(row, np.arange(rows.num_rows), "right") - 1
        cut_short = last[(last >= 0) & (last < end)]
        keep[stop[cut_short] - 1] = False
        total = np.concatenate(([0], np.cumsum(keep)))[words.offsets]
        left = np.concatenate(([0], np.cumsum(~gone[np.searchsorted(begin, words.starts, "right") - 1])))
        alive = (left[words.first[1:]] > left[words.first[:-1]]) | (words.counts == 0)
        texts = pa.Array.from_buffers(pa.string(), rows.num_rows, [None, pa.py_buffer(total.astype(np.int32).tobytes()), pa.py_buffer(words.data[keep].tobytes())])
        nulls = rows.column(0).is_valid()
        columns = list(rows.columns[3:])
        columns[at] = pa.compute.if_else(nulls, texts, pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays(columns, rows.schema.names[3:]).filter(pa.array(alive))

    out = with_texts(held, removed(held, threshold), ["_line"], cut, ", ".join(held.fields), "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
