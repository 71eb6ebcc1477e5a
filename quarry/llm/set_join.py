"""Both rounds of an exact set-similarity join over postings, shared by lines and whole texts.

First round: inside a posting (sets that hold one token in their prefix) pairs pass the length and
the positional filter and, where there are signatures, a bound on the symmetric difference. Each set is
paired with the earliest that passes. Second round: what may still have a partner (open rows) meets all
rows of its postings. ``second_round`` verifies candidates on whole sets where they meet, and one link
for each open row leaves. ``other_parts``, for groups of sets too large to travel with their postings,
gives each open row's nearest candidates in every other part, and says where there are more.

A posting that may be long is dealt to ``blocks`` by a hash of the set, so that no task gets it whole:
the first round pairs inside blocks, which settles copies, and only rows that are then still open
travel to the other blocks of their posting, dealt to blocks themselves if they are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import trimmed

EPS, LEAST_BLOCK, MOST_BLOCK, PAIRS = 1e-9, 512, 1 << 16, 1 << 20
HEAD = "a bigint, b bigint, token bigint, n int, pos int"


def block_size(postings: int, partitions: int) -> int:
    """Rows of a posting that stay together: a small part of a partition's share, within bounds."""
    return min(MOST_BLOCK, max(LEAST_BLOCK, postings // (64 * partitions)))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole postings; rows come sorted by the first column, over batch ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = batch.column(0).to_numpy()
        if held and held[0].column(0)[0].as_py() == tokens[0] == tokens[-1]:
            held.append(batch)  # in the middle of a long posting
            continue
        cut = int(np.searchsorted(tokens, tokens[-1]))
        if cut or held:
            front = batch.slice(0, cut) if cut else batch.slice(0, 0)
            if held and tokens[0] != held[0].column(0)[0].as_py() or cut:
                yield pa.Table.from_batches([*held, front]).combine_chunks().to_batches()[0]
                held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def passing(i: np.ndarray, j: np.ndarray, n: np.ndarray, pos: np.ndarray, sig: list[np.ndarray], threshold: float) -> np.ndarray:
    """Positional filter and signature bound of pairs; lengths are compatible already."""
    both = n[i] + n[j]
    need = np.ceil(threshold / (1 + threshold) * both - EPS).astype(np.int64)
    ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
    if sig:
        ok &= sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int64) for s in sig) <= both - 2 * need
    return ok


def _first(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Over (token, n, pos, a, signature...): each set with the earliest that passes, and, of postings in
    which some set had more, the rows that passed with any; open: those that had more."""
    for batch in groups(batches):
        token, n, pos, own, *sig = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        n, pos, sig = n.astype(np.int64), pos.astype(np.int64), [s.view(np.uint64) for s in sig]  # bits of negative numbers are counted of their absolute value
        size = len(token)
        best, several, involved = own.copy(), np.zeros(size, np.int64), np.zeros(size, bool)
        i, step = np.arange(1, size), 1
        while len(i):
            j = i - step
            ok = (token[j] == token[i]) & (n[j] >= threshold * n[i] - EPS)  # shorter rows are further off still
            i, j = i[ok], j[ok]
            hit = passing(i, j, n, pos, sig, threshold)
            x, y = i[hit], j[hit]
            if len(x):
                involved[x] = involved[y] = True
                later, earlier = np.where(own[x] > own[y], x, y), np.minimum(own[x], own[y])
                np.add.at(several, later, 1)
                np.minimum.at(best, later, earlier)
            step += 1
            i = i[i >= step]
        names = [f.split(" ")[0] for f in HEAD.split(", ")] + [f"sig{k}" for k in range(len(sig))] + ["open"]
        at = np.flatnonzero(best < own)
        if len(at):
            none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * len(sig), pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(best[at]), *none], names)
        if (several > 1).any():
            at = np.flatnonzero(involved & np.isin(token, token[several > 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[at]), pa.nulls(len(at), pa.int64()), pa.array(token[at].astype(np.int64)), pa.array(n[at], pa.int32()), pa.array(pos[at], pa.int32()), *(pa.array(s[at].view(np.int64)) for s in sig), pa.array(several[at] > 1)], names
            )


def first_round(posted: DataFrame, threshold: float, signatures: int = 0) -> DataFrame:
    """posted: (token, n, pos, a, sig...), partitioned by token and sorted by (token, n)."""
    schema = HEAD + "".join(f", sig{k} bigint" for k in range(signatures)) + ", open boolean"
    return posted.mapInArrow(trimmed(lambda it: _first(it, threshold)), schema)


def common(i: np.ndarray, j: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens in common of pairs of rows; flat holds each row's tokens, bounds their places."""
    _, code = np.unique(flat, return_inverse=True)
    width = np.int64(len(flat) + 1)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    have = np.sort(row * width + code)
    out = np.zeros(len(i), np.int64)
    size = np.diff(bounds)
    for at in range(0, len(i), PAIRS // 16):
        a, b = i[at : at + PAIRS // 16], j[at : at + PAIRS // 16]
        swap = size[a] > size[b]  # the smaller one is looked up
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        ends = np.cumsum(size[a])
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[:-1][a] - (ends - size[a]), size[a])
        want = np.repeat(b, size[a]) * width + code[take]
        where = np.minimum(np.searchsorted(have, want), len(have) - 1)
        out[at : at + len(a)] = np.bincount(np.repeat(np.arange(len(a)), size[a]), have[where] == want, len(a)).astype(np.int64)
    return out


def _candidates(n: np.ndarray, threshold: float, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asked row, any row) of compatible lengths, in pieces; rows are sorted by n."""
    low = np.searchsorted(n, np.ceil(threshold * n[asked] - EPS))
    high = np.searchsorted(n, np.floor(n[asked] / threshold + EPS), "right")
    size, at = high - low, 0
    while at < len(asked):
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), PAIRS, "right")) + at)
        k = np.arange(at, to)
        total = np.cumsum(size[k])
        yield np.repeat(asked[k], size[k]), np.arange(total[-1]) + np.repeat(low[k] - (total - size[k]), size[k])
        at = to


def _runs(batch: pa.RecordBatch, mark: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, open ones among them) of every group that has any."""
    group = batch.column(0).to_numpy()
    cut = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    for start, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        asked = np.flatnonzero(mark[start:end])
        if len(asked) and end - start > 1:
            yield slice(start, end), asked


def _second(batches: Iterator[pa.RecordBatch], threshold: float, signatures: int) -> Iterator[pa.RecordBatch]:
    for batch in groups(batches):
        n, pos, own, mark = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:5])
        lists, sig = batch.column(5), [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns[6 : 6 + signatures]]
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat, bounds = lists.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0]
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        for here, asked in _runs(batch, mark):
            links = _settled(n[here], pos[here], own[here], asked, flat[bounds[here.start] : bounds[here.stop]], bounds[here.start : here.stop + 1] - bounds[here.start], [s[here] for s in sig], threshold)
            if links:
                both = np.concatenate(links, 1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _settled(n: np.ndarray, pos: np.ndarray, own: np.ndarray, asked: np.ndarray, flat: np.ndarray, bounds: np.ndarray, sig: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    links: list[np.ndarray] = []
    for i, j in _candidates(n, threshold, asked):
        ok = own[j] < own[i]
        i, j = i[ok], j[ok]
        ok = passing(i, j, n, pos, sig, threshold)
        i, j, some = i[ok], j[ok], 1
        while len(i):  # a few candidates of each open row at a time, until one holds
            now = np.arange(len(i)) - np.searchsorted(i, i) < some
            x, y = i[now], j[now]
            both = common(x, y, flat, bounds)
            good = both >= threshold * (n[x] + n[y] - both) - EPS
            hit, first = np.unique(x[good], return_index=True)
            links.append(np.stack((own[hit], own[y[good][first]])))
            left = ~now & ~np.isin(i, hit)
            i, j, some = i[left], j[left], some * 4
    return links


def second_round(rows: DataFrame, threshold: float, signatures: int = 0) -> DataFrame:
    """(a, b): verified links of open rows to an earlier one, one in each group. rows: (group, n, pos, a,
    open, tokens array<bigint>, sig...)."""
    dealt = rows.repartition("group").sortWithinPartitions("group", "n")
    return dealt.mapInArrow(trimmed(lambda it: _second(it, threshold, signatures)), "a bigint, b bigint")


def _others(batches: Iterator[pa.RecordBatch], threshold: float, signatures: int, each: int) -> Iterator[pa.RecordBatch]:
    for batch in groups(batches):
        n, pos, own, mark, part = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:6])
        sig = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns[6 : 6 + signatures]]
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        for here, asked in _runs(batch, mark):
            length, place, name, label, own_sig = n[here], pos[here], own[here], part[here], [s[here] for s in sig]
            for i, j in _candidates(length, threshold, asked):
                ok = label[i] != label[j]
                i, j = i[ok], j[ok]
                ok = passing(i, j, length, place, own_sig, threshold)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                far = sum((np.bitwise_count(s[i] ^ s[j]).astype(np.int64) for s in own_sig), np.zeros(len(i), np.int64))
                order = np.lexsort((name[j], far, label[j], i))
                i, j = i[order], j[order]
                new = np.append(True, (i[1:] != i[:-1]) | (label[j[1:]] != label[j[:-1]]))
                rank = np.arange(len(i)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                more = np.isin(name[i], name[i[rank >= each]])
                i, j, more = i[rank < each], j[rank < each], more[rank < each]
                yield pa.RecordBatch.from_arrays([pa.array(name[i]), pa.array(name[j]), pa.array(more)], ["a", "b", "more"])


def other_parts(rows: DataFrame, threshold: float, signatures: int, each: int) -> DataFrame:
    """(a, b, more): of every open row the ``each`` nearest candidates in each other part of each group; more:
    the row has further ones. rows: (group, n, pos, a, open, part, sig...)."""
    dealt = rows.repartition("group").sortWithinPartitions("group", "n")
    return dealt.mapInArrow(trimmed(lambda it: _others(it, threshold, signatures, each)), "a bigint, b bigint, more boolean")


def block_of(row: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(row), blocks.cast("bigint"))


def across(long: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """The second round's rows of postings that are dealt to blocks. long: (token, blocks, a, ...), their
    rows; asked: those that are open. Open rows go to every block of their posting; where a posting has
    more than ``most`` of them they are dealt to blocks too, and its rows go to each of these."""
    block = block_of(F.col("a"), F.col("blocks"))
    many = asked.groupBy("token", "blocks").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("_asked"))
    # by block, so that a long posting's rows are dealt to many tasks here, too
    many = many.select(F.col("token").alias("_t"), "_asked", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)).alias("_b"))
    here = (F.col("token") == F.col("_t")) & (F.col("_block") == F.col("_b"))
    group = lambda i, j: F.xxhash64(F.lit(1), "token", i, j)
    home = long.withColumn("_block", block).join(many, here).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_asked") - 1)))
    home = home.withColumn("group", group(F.col("_block"), F.col("_j").cast("bigint"))).withColumn("open", F.lit(False))
    out = asked.withColumn("_block", block).join(many, here).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.withColumn("group", group(F.col("_i").cast("bigint"), block_of(F.col("a"), F.col("_asked")))).withColumn("open", F.lit(True))
    return home.drop("_j", "_t", "_asked", "_block", "_b").unionByName(out.drop("_i", "_t", "_asked", "_block", "_b"))
