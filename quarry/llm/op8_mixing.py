"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every document is hashed to a block of its source; (source, block) totals are one grouped
   aggregation. The number of blocks grows with the documents, so a block does not.
2. A source's target turns into whole passes over all its blocks and one partial pass that draws
   permuted blocks until the rest of the target is met. Only the block in which it is met is
   ordered document by document.
3. The drawn block slots are shared among the output shards by a splitting tree: each node splits its
   exact quotas between its halves by one multivariate-hypergeometric draw. The top of the tree, of
   ``TOP`` groups of sources and ``TOP`` subtrees at most, is drawn on the driver; the sources of a
   group and the shards of a subtree are drawn in tasks of their own. A shard takes a run of
   consecutive slots of each source's permutation, so draws are disjoint.
4. Rows are put in a hashed order inside their shard.

Sources, targets and quotas are distributed tables: the driver holds group totals and a few sums.

Edges: a null or empty text has size 0 and is never taken, nor is it in the mixed corpus, as it has
no words to mix; a null source is a source of its own, ordered last; repeated rows are separate
documents; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import map_arrow, materialise, table, trimmed, with_row
from quarry.llm.slabs import slabs, stored, with_texts

SEED, DOCS_PER_SHARD, DOCS_PER_BLOCK, LEAST_BLOCKS, TOP = 20240, 4096, 1024, 4096, 1024
LARGE = 1_000_000_000  # numpy's hypergeometric draws end here


def _sum(df: DataFrame, *columns: Column) -> tuple:
    return tuple(float(x or 0) for x in df.agg(*columns).first())


def cyclic_weights(sources: DataFrame, cycle: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """sources (source, size) with a weight each, by code-point order, null last, repeating."""
    ordered = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ordered = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()), "mix-ordered")
    part = F.shiftright("_id", 33)
    # where the numbers of each partition begin: one row for each partition
    starts = ordered.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    weights = F.array(*[F.lit(float(x)) for x in cycle])
    return ordered.join(starts, part == F.col("_p")).withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(cycle))).cast("int"))).drop("_id", "_p", "_start")


def water_fill(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """sources (source, size, weight) with targets: share of all sizes dealt by weight; what is above cap
    times a size is dealt again by weight, until none is above."""
    total = share * _sum(sources, F.sum("size"))[0]
    level, full = None, F.col("size") * F.lit(cap)
    while True:
        # a source stops where its weight's due reaches its cap; the level only rises
        stopped = (F.col("size") == 0) if level is None else (F.col("size") == 0) | (F.col("weight") * F.lit(level) > full)
        free, taken, count = _sum(sources, F.sum(F.when(~stopped, F.col("weight"))), F.sum(F.when(stopped, full)), F.sum(stopped.cast("int")))
        now = (total - taken) / free if free else 0.0
        if level is not None and (not free or count == before):
            break
        level, before = now, count
    return sources.withColumn("target", F.when(stopped, full).otherwise(F.lit(now) * F.col("weight")).cast("double"))


def cyclic(share: float = 1.5, cap: float = 2.0) -> Callable[[DataFrame], DataFrame]:
    return lambda sources: water_fill(cyclic_weights(sources), share, cap)


def tempered(sources: DataFrame, power: float = 0.7, cap: float = 2.0) -> DataFrame:
    """Targets in proportion to size**power, scaled so that no source falls under its own size
    and none is above cap times it: every document stays, small sources repeat."""
    scale = _sum(sources, F.max(F.when(F.col("size") > 0, F.pow("size", F.lit(1 - power)))))[0]
    due = F.greatest(F.col("size").cast("double"), F.lit(scale) * F.pow("size", F.lit(power)))
    return sources.withColumn("target", F.when(F.col("size") > 0, F.least(F.lit(cap) * F.col("size"), due)).otherwise(F.lit(0.0)))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, wanted: int) -> int:
    """How many good ones are among wanted draws. Populations beyond numpy's limit are drawn from
    their distribution around its mode, as far as it is not zero in double precision."""
    if not good or not wanted:
        return 0
    if not bad or wanted == good + bad:
        return min(good, wanted)
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, wanted))
    n = good + bad
    mode = (wanted + 1) * (good + 1) // (n + 2)
    reach = 40 + int(12 * np.sqrt(wanted / n * good * (bad / n) * ((n - wanted) / max(1, n - 1))))
    x = np.arange(max(0, wanted - bad, mode - reach), min(good, wanted, mode + reach) + 1, dtype=np.float64)
    steps = np.log(good - x[:-1]) + np.log(wanted - x[:-1]) - np.log(x[:-1] + 1) - np.log(bad - wanted + x[:-1] + 1)
    logs = np.append(0, np.cumsum(steps))
    total = np.cumsum(np.exp(logs - logs.max()))
    return int(x[np.searchsorted(total, rng.random() * total[-1], "right")])


def draw(rng: np.random.Generator, have: np.ndarray, wanted: int) -> np.ndarray:
    """A multivariate-hypergeometric draw of wanted slots from have of each kind."""
    rest = int(have.sum())
    if rest < LARGE:
        return rng.multivariate_hypergeometric(have, wanted, method="marginals").astype(np.int64)
    out = np.zeros(len(have), np.int64)
    for i, good in enumerate(have.tolist()):
        out[i] = hypergeometric(rng, good, rest - good, wanted)
        rest, wanted = rest - good, wanted - int(out[i])
    return out


def splitting_tree(quotas: np.ndarray, weights: np.ndarray, seed: int) -> np.ndarray:
    """Quotas (integers) of each kind to a table of exact shares, a row for each leaf. Leaves of equal
    weight get equal totals, as near as whole numbers come."""
    out = np.zeros((len(weights), len(quotas)), np.int64)
    upto = np.concatenate(([0], np.cumsum(weights.astype(np.int64))))

    def split(node: int, low: int, high: int, have: np.ndarray) -> None:
        if high - low == 1:
            out[low] = have
            return
        mid = (low + high) // 2
        wanted = int(have.sum()) * int(upto[mid] - upto[low]) // max(1, int(upto[high] - upto[low]))
        left = draw(np.random.Generator(np.random.Philox(key=[seed, node])), have, wanted)
        split(2 * node, low, mid, left)
        split(2 * node + 1, mid, high, have - left)

    split(1, 0, len(weights), quotas.astype(np.int64))
    return out


def shares(quota: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, n): quota (source, n), the slots of each source, shared among the shards."""
    trees = min(shards, TOP)
    # shards of subtree t: t, t + trees, ...
    weights = np.array([len(range(t, shards, trees)) for t in range(trees)])
    grouped = quota.where("n > 0").withColumn("_g", F.pmod(F.xxhash64("source"), F.lit(TOP)).cast("int"))
    groups = grouped.groupBy("_g").agg(F.sum("n").alias("n")).collect()  # TOP rows at most
    groups = sorted((r["_g"], int(r["n"])) for r in groups)
    top = splitting_tree(np.array([n for _, n in groups], np.int64), weights, seed) if groups else np.zeros((trees, 0), np.int64)
    column = {g: np.ascontiguousarray(top[:, i]) for i, (g, _) in enumerate(groups)}
    held = quota.sparkSession.sparkContext.broadcast(column)  # TOP x TOP numbers at most

    def rows(batches: Iterator[pa.RecordBatch], each: Callable) -> Iterator[pa.RecordBatch]:
        """each(key, its sources and quotas), over rows sorted by key."""
        key, sources, counts = None, [], []
        for batch in batches:
            for k, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and sources:
                    yield from each(key, sources, np.array(counts, np.int64))
                    sources, counts = [], []
                key = k
                sources.append(s)
                counts.append(n)
        if sources:
            yield from each(key, sources, np.array(counts, np.int64))

    def out(sources: list, which: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sources[i] for i in which.tolist()], pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["source", "at", "n"])

    def to_trees(g: int, sources: list, have: np.ndarray) -> Iterator[pa.RecordBatch]:
        have = have.copy()
        for t, wanted in enumerate(held.value[g].tolist()):
            got = draw(np.random.Generator(np.random.Philox(key=[seed + 10, g * TOP + t])), have, wanted)
            have -= got
            hit = np.flatnonzero(got)
            if len(hit):
                yield out(sources, hit, np.full(len(hit), t), got[hit])

    def to_shards(t: int, sources: list, have: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = np.arange(t, shards, trees)
        table_ = splitting_tree(have, np.ones(len(own), np.int64), seed + 20 + t)
        leaf, which = np.nonzero(table_)
        yield out(sources, which, own[leaf], table_[leaf, which])

    schema = "source string, at bigint, n bigint"
    order = F.col("source").asc_nulls_last()
    by_tree = grouped.select("_g", "source", "n").repartition("_g").sortWithinPartitions("_g", order).mapInArrow(lambda it: rows(it, to_trees), schema)
    by_tree = by_tree.select("at", "source", "n").repartition("at").sortWithinPartitions("at", order)
    return by_tree.mapInArrow(lambda it: rows(it, to_shards), schema).withColumnRenamed("at", "shard")


def _before(df: DataFrame, by: list[str], order: Column, sums: dict[str, Column]) -> DataFrame:
    """df with the sums of all rows before each one, in the given 64-bit order inside by. Rows are dealt by
    the order's leading bits first, so that a large group is many tasks'."""
    lead = F.shiftright(order, 54)
    parted = df.withColumn("_lead", lead)
    outer = parted.groupBy(*by, "_lead").agg(*[F.sum(c).alias(f"_all_{k}") for k, c in sums.items()])
    ahead = Window.partitionBy(*by).orderBy("_lead")  # 1,024 rows at most
    outer = outer.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_lead").alias("_l"), *[(F.sum(f"_all_{k}").over(ahead) - F.col(f"_all_{k}")).alias(f"_out_{k}") for k in sums])
    inner = Window.partitionBy(*by, "_lead").orderBy(order, *[c for c in df.columns if c not in by])
    same = F.col("_lead") == F.col("_l")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    near = parted.withColumns({f"_in_{k}": F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - c for k, c in sums.items()})
    return near.join(outer, same).select(*df.columns, *[(F.col(f"_in_{k}") + F.col(f"_out_{k}")).alias(k) for k in sums])


def _sizes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in K.slices(batch, "_text"):
        counts = K.words_of(data, offsets).counts
        yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(counts, pa.int64())], [*rows.schema.names[1:], "size"])


def plan(
    docs: DataFrame,
    targets: Callable[[DataFrame], DataFrame],
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = ("doc_id",),
    cap: int = 2,
    shards: int | None = None,
    cut: bool = True,
    seed: int = SEED,
    row: str | None = None,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """(keep..., _row, source, size, source_size, target, taken, copies array<struct<shard, words>>).

    targets: (source, size) to the same with a target. cut: the last document of a partial pass gives
    only its first words, so that each source meets its target to the word; else it is taken whole if
    that comes nearer. row: a column that numbers the rows. by: the kept columns that the draw hangs on
    (all, unless named)."""
    names = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{source}`").cast("string").alias("source"), *[F.col(f"`{c}`").alias(k) for k, c in zip(names, keep, strict=True)], *[F.col(row).alias("_row") for _ in [row] if row])
    slim = slim if row else with_row(slim)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "_text")
    sized = materialise(map_arrow(slim, _sizes, f"{kept}, size bigint"), "mix-sizes")
    n_docs = sized.count()
    shards = shards or max(64, -(-n_docs // DOCS_PER_SHARD))  # a shard is one task: it must not grow with the input
    blocks = max(LEAST_BLOCKS, n_docs // DOCS_PER_BLOCK)
    own = [k for k, c in zip(names, keep, strict=True) if by is None or c in by]
    key = F.xxhash64(F.lit(seed), *own, "size")
    blocked = sized.withColumn("_block", F.pmod(key, F.lit(blocks)))
    totals = materialise(blocked.groupBy("source", "_block").agg(F.sum("size").alias("words")), "mix-blocks")
    sources = materialise(totals.groupBy("source").agg(F.sum("words").alias("size"), F.count_if(F.col("words") > 0).alias("_n")), "mix-sources")
    goal = materialise(targets(sources.select("source", "size")), "mix-targets")
    whole = F.when(F.col("size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("size")))).otherwise(F.lit(0)).cast("int")
    info = goal.withColumn("_whole", whole).withColumn("_rest", F.when(F.col("_whole") < cap, F.round(F.col("target") - F.col("_whole") * F.col("size"))).otherwise(F.lit(0)).cast("bigint"))
    info = materialise(info.join(sources.select(F.col("source").alias("_x"), "_n"), F.col("source").eqNullSafe(F.col("_x"))).select(F.col("source").alias("_s"), F.col("size").alias("source_size"), "target", "_whole", "_rest", "_n"), "mix-info")
    # permuted rank of each block with words, and the words before it in the partial pass
    ranked = _before(totals.where("words > 0"), ["source"], F.xxhash64(F.lit(seed + 1), "_block"), {"_rank": F.lit(1).cast("bigint"), "_ahead": F.col("words")})
    ranked = ranked.join(info.select("_s", "_whole", "_rest", "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ranked = materialise(ranked.withColumn("_extra", F.greatest(F.lit(0), F.least("words", F.col("_rest") - F.col("_ahead")))), "mix-ranked")
    quota = ranked.groupBy("source").agg(F.sum(F.col("_whole") + (F.col("_extra") > 0).cast("int")).alias("n"))
    dealt = materialise(shares(quota, shards, seed), "mix-shares")
    # slots of a source in a row: its first pass, the next, the partial one. A shard takes a run of them
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("shard"))
    runs = dealt.withColumn("_upto", upto)
    placed = runs.select(F.col("source").alias("_ps"), "shard", F.explode(F.sequence(F.col("_upto") - F.col("n"), F.col("_upto") - 1)).alias("_slot"))
    passes = F.sequence(F.lit(0), F.col("_whole") + (F.col("_extra") > 0).cast("int") - 1)
    slots = ranked.where("_whole > 0 or _extra > 0").select("source", "_block", "_whole", "_extra", "words", F.explode(passes).alias("_pass"), "_rank", "_n")
    slots = slots.withColumn("_at", F.col("_rank") + F.col("_pass") * F.col("_n"))
    # only the first blocks of the permutation have a partial pass, so slots are numbered without gaps
    met = slots.join(placed, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_at") == F.col("_slot")))
    block = met.groupBy(F.col("source").alias("_bs"), F.col("_block").alias("_b")).agg(
        F.max("_extra").alias("_extra"), F.max("words").alias("words"), F.collect_list(F.when(F.col("_pass") < F.col("_whole"), F.col("shard"))).alias("_shards"), F.max(F.when(F.col("_pass") == F.col("_whole"), F.col("shard"))).alias("_last"),
    )
    block = materialise(block, "mix-drawn")
    # the blocks' file is small for its rows, and its size no bound for a broadcast
    out = blocked.join(block.hint("merge"), F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_b")) & (F.col("size") > 0), "left").drop("_bs", "_b")
    # documents of the block in which the target is met are ordered; other blocks are whole
    partial = (F.col("_extra") > 0) & (F.col("_extra") < F.col("words"))
    ordered = _before(out.where(F.coalesce(partial, F.lit(False))), ["source", "_block"], F.xxhash64(F.lit(seed + 2), *own, "size", "_row"), {"_running": F.col("size")})
    wanted = F.greatest(F.lit(0), F.least("size", F.col("_extra") - F.col("_running")))
    if not cut:
        wanted = F.when(F.col("_extra") - F.col("_running") >= F.col("size") / 2, F.col("size")).otherwise(F.lit(0))
    ordered = ordered.withColumn("_more", wanted).drop("_running")
    others = out.where(~F.coalesce(partial, F.lit(False))).withColumn("_more", F.when(F.col("_extra") == F.col("words"), F.col("size")).otherwise(F.lit(0)))
    out = ordered.unionByName(others)
    pair = "array<struct<shard:bigint,words:bigint>>"
    every = F.transform(F.coalesce("_shards", F.array().cast("array<bigint>")), lambda s: F.struct(s.alias("shard"), F.col("size").alias("words")))
    last = F.when(F.col("_more") > 0, F.array(F.struct(F.col("_last").alias("shard"), F.col("_more").alias("words")))).otherwise(F.array().cast(pair))
    out = out.withColumn("copies", F.array_sort(F.concat(every.cast(pair), last.cast(pair))))
    out = out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]))
    out = out.join(info.select("_s", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keep, strict=True)], "_row", "source", "size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, targets: Callable[[DataFrame], DataFrame], text: str = "text", source: str = "source", shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of docs: whole documents, as often as they are drawn, dealt
    to their shards and put in hashed order inside each. The draw works on slim rows and comes back to the
    documents as places in their slabs; a slab's documents for one shard travel as one compressed row."""
    names = docs.columns
    # the draw hangs on what a row holds, not on where it stands
    held = stored(docs.withColumn("_mix_hash", F.xxhash64(*[F.col(f"`{c}`") for c in names])), text, source, [*names, "_mix_hash"])

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, rows, _, _ in slabs(batches):
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, slab), pa.int64()), pa.array(np.arange(n), pa.int32()), rows.column(0), rows.column(1), rows.column(2), rows.column(3 + len(names))], ["_slab", "_at", "_text", "_key", "_row", "_hash"])

    rows = held.blobs.mapInArrow(trimmed(slim), f"_slab bigint, _at int, _text string, _key {held.kind}, _row bigint, _hash bigint")
    shards = shards or max(64, -(-docs.count() // DOCS_PER_SHARD))  # a shard is one task: it must not grow with the input
    drawn = plan(rows, targets, "_text", "_key", keep=("_slab", "_at", "_hash"), cut=False, shards=shards, seed=seed, row="_row", by=("_hash",))
    picks = drawn.select("_slab", "_at", "_hash", F.posexplode("copies").alias("_copy", "_c")).select("_slab", "_at", F.col("_c.shard").alias("_shard"), F.xxhash64(F.lit(seed + 3), "_hash", "_copy").alias("_order"))
    picks = materialise(picks, "mix-picks")

    def taken(rows: pa.RecordBatch, words: K.Words, at: np.ndarray, shard: np.ndarray, order: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = pa.RecordBatch.from_arrays(rows.columns[3:-1], rows.schema.names[3:-1])
        by = np.argsort(shard, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1):
            part = kept.take(pa.array(at[own])).append_column("_order", pa.array(order[own], pa.int64()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[own[0]])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_shard", "_blob"])

    dealt = with_texts(held, picks, ["_at", "_shard", "_order"], taken, "_shard bigint, _blob binary")
    dealt = dealt.repartition(shards, "_shard").sortWithinPartitions("_shard")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = pa.Table.from_batches(parts).sort_by("_order").drop_columns(["_order"])
            yield from both.combine_chunks().to_batches(max_chunksize=512)

        own, parts = None, []
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != own and parts:
                    yield from whole(parts)
                    parts = []
                own = shard
                with pa.ipc.open_stream(pa.py_buffer(blob.as_buffer())) as reader:
                    parts.append(reader.read_next_batch())
        if parts:
            yield from whole(parts)

    out = dealt.mapInArrow(trimmed(unpacked), ", ".join(held.fields[:-1]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = plan(table(spark, sf_dir, "documents"), cyclic())
    return drawn.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each source, beside the source's target."""
    by_source = query(spark, sf_dir).groupBy("source", "source_size", F.round("target", 3).alias("target"))
    met = by_source.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("taken").alias("_taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("_over"))
    return met.select("source", "source_size", "target", "n_docs", (F.abs(F.col("_taken") - F.col("target")) <= 1).alias("is_met"), (F.col("_over") <= 0).alias("within_twice"))


#: The level of the targets: sources stop in the order of size by weight, so the first level that stops no other is it.
SQL = r"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS size, count(*) AS n_docs FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY size / weight, source) AS k, sum(size) OVER () AS total FROM w),
l AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM o
),
f AS (SELECT min_by((1.5 * total - 2 * stopped) / free, k) AS level FROM l WHERE size > 0 AND (1.5 * total - 2 * stopped) / free * weight <= 2 * size)
SELECT source, size AS source_size, round(least(2.0 * size, level * weight), 3) AS target, n_docs, true AS is_met, true AS within_twice FROM w, f
"""
