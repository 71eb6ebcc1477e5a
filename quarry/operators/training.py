"""Training aggregates: symbol histograms, code lengths, n-gram dictionaries, chunked compression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.codecs import huffman, registry


def histogram(df: DataFrame, content: str, *by: str) -> DataFrame:
    """(by..., byte, n): byte frequencies. Each batch counts by itself, so that at most 256 rows a
    group and batch are shuffled, whatever the sizes."""
    from pyspark.sql.types import LongType, StructField, StructType

    slim = df.select(*[F.col(c) for c in by], F.col(content).cast("binary").alias("_data"))
    schema = StructType([*slim.schema.fields[:-1], StructField("byte", LongType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, np.ndarray] = {}
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)) or [()] * batch.num_rows
            for key, data in zip(keys, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if data:
                    seen[key] = seen.get(key, 0) + np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            rows = [(*k, int(b), int(c[b])) for k, c in seen.items() for b in np.flatnonzero(c)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.fields]
            types = [batch.schema.field(i).type for i in range(len(by))] + [pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

    return slim.mapInArrow(run, schema).groupBy(*by, "byte").agg(F.sum("n").alias("n"))


def code_lengths(counts: DataFrame, *by: str, symbol: str = "byte", n: str = "n", limit: int = 15) -> DataFrame:
    """(by..., symbol, bits): optimal length-limited code of each group's histogram (an alphabet, so a
    group is small)."""
    lists = counts.groupBy(*by).agg(F.collect_list(F.struct(symbol, n)).alias("_l"))
    size = counts.schema[symbol].dataType.simpleString()

    @F.arrow_udf(f"array<struct<symbol:{size},bits:int>>")
    def fit(values: pa.Array) -> pa.Array:
        out = []
        for row in values.to_pylist():
            row = sorted(row, key=lambda r: r[symbol])
            bits = huffman.lengths([r[n] for r in row], limit)
            out.append([{"symbol": r[symbol], "bits": b} for r, b in zip(row, bits, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("symbol", pa.int64()), ("bits", pa.int32())])))

    return lists.select(*by, F.explode(fit(F.col("_l"))).alias("_c")).select(*by, F.col("_c.symbol").alias(symbol), F.col("_c.bits").alias("bits"))


def canonical_codes(lengths: DataFrame, *by: str, symbol: str = "byte") -> DataFrame:
    """(by..., symbol, bits, code) by the canonical rule: codes count up by (length, symbol). With
    lengths from a full code, the code is the sum of 2**-bits of those before it."""
    w = Window.partitionBy(*by).orderBy("bits", symbol).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("bits"))).over(w), F.lit(0.0))
    return lengths.filter("bits > 0").withColumn("code", (before * F.pow(F.lit(2.0), F.col("bits"))).cast("bigint"))


def table_shares(counts: DataFrame, *by: str, symbol: str = "byte", n: str = "n", accuracy: int = 9) -> DataFrame:
    """(by..., symbol, share): counts scaled to a table of 2**accuracy cells, at least one for each."""
    lists = counts.groupBy(*by).agg(F.collect_list(F.struct(symbol, n)).alias("_l"))

    @F.arrow_udf("array<struct<symbol:bigint,share:int>>")
    def fit(values: pa.Array) -> pa.Array:
        out = []
        for row in values.to_pylist():
            row = sorted(row, key=lambda r: r[symbol])
            out.append([{"symbol": r[symbol], "share": s} for r, s in zip(row, huffman.normalise([r[n] for r in row], 1 << accuracy), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("symbol", pa.int64()), ("share", pa.int32())])))

    return lists.select(*by, F.explode(fit(F.col("_l"))).alias("_c")).select(*by, F.col("_c.symbol").alias(symbol), F.col("_c.share").alias("share"))


def coded_size(counts: DataFrame, lengths: DataFrame, *by: str, symbol: str = "byte") -> DataFrame:
    """(by..., coded_bits): what the histogram takes in the code."""
    return counts.join(lengths, [*by, symbol]).groupBy(*by).agg(F.sum(F.col("n") * F.col("bits")).cast("bigint").alias("coded_bits"))


def fixed_length(symbol: Column) -> Column:
    """Bits of a literal or length symbol in DEFLATE's fixed code."""
    return F.when(symbol <= 143, 8).when(symbol <= 255, 9).when(symbol <= 279, 7).otherwise(8)


def ngrams(df: DataFrame, content: Column, least: int = 4, most: int = 16, seen: int = 2) -> DataFrame:
    """(ngram, length, n, score): substrings of least..most characters found ``seen`` times or more.
    The substrings are generated lazily by nested explodes and counted with map-side combining."""
    text = df.select(content.alias("_t")).where(F.length("_t") >= least)
    sizes = text.select("_t", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.length("_t")))).alias("length"))
    grams = sizes.select("length", F.explode(F.transform(F.sequence(F.lit(1), F.length("_t") - F.col("length") + 1), lambda i: F.substring(F.col("_t"), i, F.col("length")))).alias("ngram"))
    counted = grams.groupBy("ngram", "length").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= seen)
    return counted.withColumn("score", F.col("n") * F.col("length"))


def train_dictionary(df: DataFrame, content: Column, size: int = 4096, candidates: int = 4096) -> bytes:
    """A raw dictionary of the best n-grams by count times length, longer ones first on ties, without
    those that are part of one taken before. Only the best ``candidates`` reach the driver: the
    greedy choice stops long before, as a dictionary of ``size`` bytes holds size / 4 of them at most."""
    best = ngrams(df, content).orderBy(F.desc("score"), F.desc("length"), "ngram").limit(max(candidates, size // 4)).collect()
    out = b""
    taken: list[bytes] = []
    for r in best:
        g = r["ngram"].encode()
        if len(out) + len(g) > size:
            if len(out) >= size:
                break
            continue
        if any(g in t for t in taken):
            continue
        out += g
        taken.append(g)
    if not out:
        for r in df.select(content.alias("_t")).where("_t is not null").limit(1024).collect():
            out = (out + r["_t"].encode())[:size]
            if len(out) == size:
                break
    return out


def chunked(df: DataFrame, content: str, size: int = 512 << 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., chunk, content): blobs cut into chunks, so that one large blob uses many tasks."""
    data = F.col(content).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    return df.select(*keep, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))).alias("chunk", content))


def join_bytes(lists: Column) -> Column:
    """The elements of each list of binaries as one, copied once."""

    @F.arrow_udf("binary")
    def joined(v: pa.Array) -> pa.Array:
        # row by row: all rows as lists would be a second copy of the batch
        return pa.array([None if row is None else b"".join(x or b"" for x in row) for row in (x.as_py() for x in v)], pa.binary())

    return joined(lists)


def compress_chunked(df: DataFrame, content: str, codec: str = "gzip", key: str = "id", size: int = 512 << 10, level: int | None = None) -> DataFrame:
    """(key, content): chunks compressed apart and joined in order. Members, frames and streams of
    gzip, bzip2, xz, zstd, lz4 and snappy may follow one another; raw deflate chunks end in a sync
    flush, so that the whole is one stream."""
    from quarry.functions.codecs import bound_batches, compress

    bound_batches(df.sparkSession)
    parts = chunked(df, content, size, (key,))
    if codec == "deflate":
        import zlib

        last = F.max("chunk").over(Window.partitionBy(key))

        @F.arrow_udf("binary")
        def piece(v: pa.Array, end: pa.Array) -> pa.Array:
            out = []
            for b, e in zip(v.to_pylist(), end.to_pylist(), strict=True):
                c = zlib.compressobj(6 if level is None else level, zlib.DEFLATED, -15)
                out.append(c.compress(b) + c.flush(zlib.Z_FINISH if e else zlib.Z_FULL_FLUSH))
            return pa.array(out, pa.binary())

        packed = parts.withColumn(content, piece(F.col(content), F.col("chunk") == last))
    elif codec == "lzma2":
        last = F.max("chunk").over(Window.partitionBy(key))

        @F.arrow_udf("binary")
        def chunks(v: pa.Array, end: pa.Array) -> pa.Array:
            # each chunk resets the dictionary; only the last keeps the end mark
            out = [registry.lzma2_compress(b, 6 if level is None else level)[: None if e else -1] for b, e in zip(v.to_pylist(), end.to_pylist(), strict=True)]
            return pa.array(out, pa.binary())

        packed = parts.withColumn(content, chunks(F.col(content), F.col("chunk") == last))
    elif codec in ("gzip", "bzip2", "xz", "zstd", "lz4", "snappy"):
        packed = parts.withColumn(content, compress(F.col(content), codec, level))
    else:
        raise ValueError(f"{codec} streams cannot be joined; compress chunk rows instead")
    whole = packed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk", content))).alias("_c"))
    return whole.select(key, join_bytes(F.col(f"_c.{content}")).alias(content))


def frame_table(df: DataFrame, content: str, key: str, size: int = 256 << 10, quality: int = 6) -> DataFrame:
    """Brotli chunks as rows (key, chunk, plain_size, content): its streams cannot be joined, so the
    table of chunks takes the place of a private frame."""
    from quarry.functions.codecs import bound_batches, compress

    bound_batches(df.sparkSession)
    parts = chunked(df, content, size, (key,)).withColumn("plain_size", F.octet_length(content))
    return parts.withColumn(content, compress(F.col(content), "brotli", quality))


def unframe_table(frames: DataFrame, content: str, key: str) -> DataFrame:
    from quarry.functions.codecs import bound_batches, decompress

    bound_batches(frames.sparkSession)
    plain = frames.withColumn(content, decompress(F.col(content), "brotli"))
    whole = plain.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk", content))).alias("_c"))
    return whole.select(key, join_bytes(F.col(f"_c.{content}")).alias(content))


def running_crc32(parts: DataFrame, key: str, seq: str, content: str) -> DataFrame:
    """(key, crc32) over parts in order. Each part's checksum is Spark's own, wherever the part is; only
    (seq, checksum, length) of the parts meet, and are joined as the checksum of the whole."""
    from quarry.codecs.checksums import crc32_join

    data = F.col(content).cast("binary")
    one = F.struct(F.col(seq).alias("seq"), F.coalesce(F.crc32(data), F.lit(0)).alias("crc"), F.coalesce(F.octet_length(data), F.lit(0)).cast("bigint").alias("n"))
    whole = parts.select(key, one.alias("_p")).groupBy(key).agg(F.sort_array(F.collect_list("_p")).alias("_l"))

    @F.arrow_udf("bigint")
    def joined(values: pa.Array) -> pa.Array:
        return pa.array([crc32_join((r["crc"], r["n"]) for r in row) for row in values.to_pylist()], pa.int64())

    return whole.select(key, joined(F.col("_l")).alias("crc32"))


__all__ = ["canonical_codes", "chunked", "code_lengths", "coded_size", "compress_chunked", "fixed_length", "frame_table", "histogram", "ngrams", "registry", "running_crc32", "table_shares", "train_dictionary", "unframe_table"]
