"""Slabs: runs of whole documents as one compressed row, for operators that come back to the texts.

``stored`` cuts the documents into slabs of about ``SLAB_BYTES`` of text (one document at least),
names each by a number of its first row, and writes them to the shared folder once. Every pass reads
that table, so a word's place (slab, word position in the slab) means the same in all of them, however
the files are split and whichever executors are left. What other stages find out about words of a slab
is keyed by its place, and comes back to the texts by a join on the slab: the exchange then moves
compressed megabytes and not rows, a slab is never split, and none is hot.

A null text is an empty one in the slab's bytes and stays null in its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import bound_batches, materialise, trimmed

SLAB_BYTES = 1 << 19


@dataclass
class Slabs:
    """(_slab, _blob) as written; kind is the key's type, fields those of the columns kept as c0, c1..."""

    blobs: DataFrame
    kind: str
    fields: list[str]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slabs over the batches of a partition; one is complete when the next row no longer fits."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(held.columns, batch.columns, strict=True)], schema=batch.schema)
        pieces = [rows for rows, _, _ in K.slices(batch, "_text", SLAB_BYTES)]
        yield from pieces[:-1]
        held = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in pieces[-1].columns], schema=batch.schema)
    if held is not None:
        yield held


def numbered(docs: DataFrame, text: str, key: str, keep: list[str] | None = None) -> DataFrame:
    """(_text, _key, _row, c0, c1...) with row numbers that hold in every later pass, as they are written
    with the rows; c0... are the columns to keep."""
    slim = docs.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{key}`").alias("_key"), F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep or [])])
    return materialise(slim, "numbered")


def stored(docs: DataFrame, text: str, key: str, keep: list[str] | None = None) -> Slabs:
    """docs as slabs: rows of (_text, _key, _row, c0, c1...), c0... the columns to keep. _row is a number
    of the row, the slab's number that of its first one."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{key}`").alias("_key"), F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep or [])])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cut(batches):
            # the slice is copied out: an IPC stream of a slice would keep its parent's buffers
            rows = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in rows.columns], rows.schema.names)
            yield pa.RecordBatch.from_arrays([rows.column(2).slice(0, 1), pa.array([sealed(rows)], pa.binary())], ["_slab", "_blob"])

    # small row groups: a reader holds a whole one
    blobs = materialise(slim.mapInArrow(trimmed(pack), "_slab bigint, _blob binary"), "slabs", options={"parquet.block.size": str(16 << 20), "compression": "none"})
    return Slabs(blobs, slim.schema["_key"].dataType.simpleString(), [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[3:]])


def sealed(rows: pa.RecordBatch, level: int = 3) -> bytes:
    """Rows as one compressed value; opened() gives them back."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def opened(blob: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob.as_buffer())) as reader:
        return reader.read_next_batch()


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slab, rows, bytes, offsets) of a partition of blobs."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = opened(batch.column(1)[i])
            data, offsets = K.text_buffers(rows.column(0))
            yield batch.column(0)[i].as_py(), rows, data, offsets


def per_slab(held: Slabs, kernel: Callable[[int, K.Words], list[pa.Array]], schema: str) -> DataFrame:
    """kernel(slab, words) -> columns, over all slabs."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, _, data, offsets in slabs(batches):
            yield pa.RecordBatch.from_arrays(kernel(slab, K.words_of(data, offsets)), names)

    return held.blobs.mapInArrow(trimmed(run), schema)


def with_texts(held: Slabs, found: DataFrame, columns: list[str], kernel: Callable, schema: str, how: str = "inner", cut: Callable = K.words_of) -> DataFrame:
    """kernel(rows, cut(bytes, offsets), columns...) -> record batches, for every slab and what was found in it
    (arrays of the given columns; empty arrays where how is "left" and nothing was). No column may hold
    nulls."""
    lists = found.groupBy("_slab").agg(F.collect_list(F.struct(*columns)).alias("_l"))
    joined = held.blobs.join(lists, "_slab", how).select("_blob", *[F.col(f"_l.{c}").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = opened(batch.column(0)[i])
                data, offsets = K.text_buffers(rows.column(0))
                own = [batch.column(j + 1)[i].values for j in range(len(columns))]
                own = [np.empty(0, np.int64) if x is None else x.to_numpy(zero_copy_only=False) for x in own]
                yield from kernel(rows, cut(data, offsets), *own)

    return joined.mapInArrow(trimmed(run), schema)
