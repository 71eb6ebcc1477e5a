"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round rewires edges to the smallest neighbour and is written to the shared checkpoint folder,
so lineage stays flat. Joins have both sides hash-dealt by node, which lets adaptive execution split
a node that has very many edges; minima are pre-aggregated before they are shuffled. Nothing but two
numbers a round (edge count and checksum) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import forget, materialise


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return int(row["n"]), int(row["s"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    up = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("k"))
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (u bigint, v bigint). Result: (node, component), component the smallest node that can
    be reached; nodes without an edge to another do not appear. Rounds go on until one changes nothing,
    which takes as many as the logarithm of the longest path, about."""
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, f"{name}-0")
    seen, turn = _digest(edges), 0
    while seen[0]:
        turn += 1
        after = materialise(_small_star(_large_star(edges)), f"{name}-{turn}")
        forget(edges)
        edges, now = after, _digest(after)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
