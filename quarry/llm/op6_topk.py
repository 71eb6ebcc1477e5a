"""Exact top-k inner-product search by MaxScore over shards of postings.

Vectors are quantised to whole numbers, floor(scale * x). The terms of a query are its non-zero
dimensions; a dimension's posting in a shard holds the vectors that are not zero there, with their values.
A term's bound is the largest contribution that any vector of the shard gets from it, 0 at least.

1. Each query block meets one shard first, another one for each block. The k-th best score there is a
   floor that every shard starts from.
2. In a shard, a query's terms are split: the non-essential ones are those of smallest bounds that
   together stay under the threshold, so that no vector gets there by them alone. The postings of the
   essential terms are traversed. What they touch is probed for the other terms, in order of falling
   bounds, while partial score and remaining bounds are competitive; the threshold rises on the way.
3. Each shard returns its own top k of each query; shards merge by rank.

Query blocks meet every shard block: a stated query set against all rows, in blocks. The blocks
are packed to binary first, so the exchange moves blocks and not rows.

Sums are exact: a pair of blocks computes in the first of float32, float64, int64 and Python's integers
that holds its largest sum. A score outside of 64 bits is an OverflowError.

Edges: null vectors and vectors with null or non-finite components take no part; empty vectors neither;
vectors of different length never meet; equal scores go to the smaller id, null ids last; fewer than k
candidates give all of them. A row is never its own candidate, other rows of the same id are; repeated
rows of the query set are queries of their own. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, table, trimmed

SHARD, QUERIES, STEP = 16_384, 512, 16


def _quantised(batch: pa.RecordBatch, scale: float) -> Iterator[tuple]:
    """(row, id, asks, whole numbers as doubles) of every vector that takes part."""
    row, ids, asks, vectors = batch.columns
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
    ends = np.cumsum(lengths)
    for i, (r, x, q) in enumerate(zip(row.to_pylist(), ids.to_pylist(), asks.to_pylist(), strict=True)):
        v = flat[ends[i] - lengths[i] : ends[i]]
        if len(v) and np.isfinite(v).all():
            yield r, x, bool(q), np.floor(scale * v)


_BLOCK = "asks boolean, dim int, rows binary, ids binary, vecs binary"


def _pack(batches: Iterator[pa.RecordBatch], scale: float, shard: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length: shards of all of them, and blocks of queries."""
    held: dict[tuple[bool, int], list] = {}

    def out(asks: bool, dim: int) -> pa.RecordBatch:
        rows, ids, vecs = zip(*held.pop((asks, dim)), strict=True)
        both = np.array([(x is None, x or 0) for x in ids], "<i8")
        data = (np.array(rows, "<i8").tobytes(), both.tobytes(), np.concatenate(vecs).astype("<f8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([asks]), pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], [f.split(" ")[0] for f in _BLOCK.split(", ")])

    for batch in batches:
        for r, x, q, v in _quantised(batch, scale):
            for asks, size in ((False, shard), (True, block))[: 1 + q]:
                held.setdefault((asks, len(v)), []).append((r, x, v))
                if len(held[asks, len(v)]) >= size:
                    yield out(asks, len(v))
    for asks, dim in list(held):
        yield out(asks, dim)


def exact_type(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The first type in which every sum of products of the two blocks is exact."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    return next((t for t, bits in ((np.float32, 24), (np.float64, 53), (np.int64, 63)) if most < 1 << bits), object)


def _as(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return values.astype(kind)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


class Postings:
    """A shard by dimension: the vectors that are not zero there, and the largest and least values. A posting
    with more than a quarter of the vectors is kept as the whole column (None), zeros and all."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, kind: type) -> None:
        self.values = np.ascontiguousarray(_as(vectors, kind).T)
        self.ids, self.rows, self.kind = ids, rows, kind
        self.high, self.low = self.values.max(1), self.values.min(1)
        self.held = [None if 4 * np.count_nonzero(v) > len(v) else np.flatnonzero(v != 0) for v in self.values]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score down, null ids last, id up)."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near, 1], ids[near, 0], -scores[near]))[:k]]


def maxscore(shard: Postings, query: np.ndarray, own: int, k: int, floor: object = None) -> tuple[np.ndarray, np.ndarray]:
    """Top k (positions, scores) of one query in one shard. floor: a score that k candidates are known
    to reach; candidates below it are not wanted."""
    n = shard.values.shape[1]
    zero = query.dtype.type(0) if query.dtype != object else 0
    most, least = np.maximum(query * shard.low, query * shard.high), np.minimum(query * shard.low, query * shard.high)
    terms = np.flatnonzero(query != 0)
    most, least = np.maximum(most, zero), np.minimum(least, zero)
    terms = terms[np.argsort(-most[terms], kind="stable")]
    rest = np.append(np.cumsum(most[terms][::-1])[::-1], zero)  # of the terms from each place on
    worst = np.append(np.cumsum(least[terms][::-1])[::-1], zero)
    # essential: all terms but the last ones whose bounds together stay under the threshold
    split = len(terms) if floor is None else int(np.argmax(rest < floor)) if (rest < floor).any() else len(terms)
    partial = np.zeros(n, shard.values.dtype)
    alive = None
    if floor is not None and zero < floor:
        # a vector that no essential posting holds cannot reach the threshold
        if all(shard.held[d] is not None for d in terms[:split]):
            touched = np.zeros(n, bool)
            for d in terms[:split]:
                touched[shard.held[d]] = True
            alive = np.flatnonzero(touched)
            partial = partial[alive]
    at, mine = 0, shard.rows != own
    while True:
        upto = min(split, at + STEP) if at < split else min(len(terms), at + STEP)
        chunk = terms[at:upto]
        full = [d for d in chunk if shard.held[d] is None or alive is not None]
        if full:
            block = shard.values[full] if alive is None else shard.values[np.ix_(full, alive)]
            partial = partial + query[full] @ block
        for d in chunk:
            if shard.held[d] is not None and alive is None:
                partial[shard.held[d]] += query[d] * shard.values[d, shard.held[d]]
        at = upto
        if at >= len(terms):
            break
        ok = mine if alive is None else mine[alive]
        if (floor is None or 2 * at >= len(terms)) and int(ok.sum()) > k:  # k candidates reach at least this, whatever the other terms add
            sure = np.partition(partial[ok], int(ok.sum()) - k)[int(ok.sum()) - k] + worst[at]
            floor = sure if floor is None else max(floor, sure)
        if floor is not None:
            stay = partial + rest[at] >= floor
            if stay.sum() < 0.7 * len(stay):
                alive = np.flatnonzero(stay) if alive is None else alive[stay]
                partial = partial[stay]
    alive = np.arange(n) if alive is None else alive
    ok = mine[alive]
    alive, partial = alive[ok], partial[ok]
    top = best(partial, shard.ids[alive], k)
    return alive[top], partial[top]


def _searched(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
    """(block, rows and ids of its queries, floors, shard, (positions, scores) of each query)."""
    seen: dict[tuple, Postings] = {}
    for b, dim, q_rows, q_ids, q_vecs, floors, s_rows, s_ids, s_vecs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        vectors, queries = np.frombuffer(s_vecs, "<f8").reshape(-1, dim), np.frombuffer(q_vecs, "<f8").reshape(-1, dim)
        kind = exact_type(queries, vectors)
        rows = np.frombuffer(s_rows, "<i8")
        name = (int(rows[0]), kind)
        if name not in seen:
            seen.clear()
            seen[name] = Postings(vectors, np.frombuffer(s_ids, "<i8").reshape(-1, 2), rows, kind)
        floors = [None] * len(queries) if floors is None else [None if x == "" else int(x) for x in floors.split(",")]
        own = np.frombuffer(q_rows, "<i8")
        yield b, own, np.frombuffer(q_ids, "<i8").reshape(-1, 2), seen[name], [maxscore(seen[name], _as(q, kind), int(r), k, f) for q, r, f in zip(queries, own, floors, strict=True)]


def _floors(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    for b, _, _, _, found in _searched(batch, k):
        kth = ",".join(str(int(s[-1])) if len(s) == k else "" for _, s in found)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([kth], pa.string())], ["_b", "floors"])


def _found(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    limit = 1 << 63
    for _, own, ids, shard, found in _searched(batch, k):
        size = [len(s) for _, s in found]
        scores = [int(x) for _, s in found for x in s]
        if any(not -limit <= x < limit for x in scores):
            raise OverflowError("a score does not fit in 64 bits")
        got = shard.ids[np.concatenate([p for p, _ in found])] if sum(size) else np.empty((0, 2), np.int64)
        asked = np.repeat(ids, size, 0)
        name = lambda x: pa.array(x[:, 1], pa.int64(), mask=x[:, 0] == 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, size)), name(asked), name(got), pa.array(scores, pa.int64())], ["_row", "query_id", "vec_id", "score"])


def search(vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: float = 64.0, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which asks is true."""
    slim = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(f"`{vector}`").alias("vec"))
    packed = slim.mapInArrow(trimmed(lambda it: _pack(it, scale, shard, block)), _BLOCK).withColumn("_s", F.monotonically_increasing_id())
    packed = materialise(packed, "topk-blocks", options={"parquet.block.size": str(16 << 20)})
    shards = packed.where("not asks").select("_s", F.col("rows").alias("s_rows"), F.col("ids").alias("s_ids"), F.col("vecs").alias("s_vecs"))
    queries = packed.where("asks").select(F.col("_s").alias("_b"), "dim", F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    columns = ["_b", "dim", "q_rows", "q_ids", "q_vecs", "floors", "s_rows", "s_ids", "s_vecs"]
    # numbers of the shards of each length: a few bytes for 16,384 vectors
    places = packed.where("not asks").select(F.col("dim").alias("_d"), "_s", (F.row_number().over(Window.partitionBy("dim").orderBy("_s")) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy("dim")).alias("_n"))
    places = materialise(places, "topk-places")
    start = places.where("_i = 0").select(F.col("_d").alias("_d0"), F.col("_n").alias("_n0"))
    first = queries.join(start, F.col("dim") == F.col("_d0")).withColumn("_at", F.pmod(F.xxhash64("_b"), F.col("_n0")))
    first = first.join(places, (F.col("dim") == F.col("_d")) & (F.col("_at") == F.col("_i"))).withColumn("floors", F.lit(None).cast("string")).join(shards, "_s").select(columns)
    floors = materialise(first.mapInArrow(trimmed(lambda it: (x for b in it if b.num_rows for x in _floors(b, k))), "_b bigint, floors string"), "topk-floors")
    # every query block goes to the shards of its dimension; a shard keeps one place, so blocks travel to it
    met = queries.join(floors, "_b").join(places.select("_d", "_s"), F.col("dim") == F.col("_d")).join(shards, "_s").select(columns)
    found = met.mapInArrow(trimmed(lambda it: (x for b in it if b.num_rows for x in _found(b, k))), "_row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH q AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT a.r AS r, a.id AS query_id, b.id AS vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE a.id % 20 = 0
), t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 20
"""
