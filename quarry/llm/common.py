"""What the corpus operators share: tables, materialisation and row identity."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.kernels import give_back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of its own in
    local mode, which has one machine, and a ValueError on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


#: Removes the shuffle files of a query when it ends (off by default in Spark).
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"  # texts are long: smaller batches than the default
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_made: dict[str, list[str]] = {}


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """From now on the session's Arrow batches end at that many bytes, too: texts are long, and a batch is
    held by the executor and by its Python worker."""
    spark.conf.set(_BYTES, size)


def materialise(df: DataFrame, name: str, keep: bool = False, options: dict[str, str] | None = None, batch: int = 2000) -> DataFrame:
    """Cuts the lineage: writes a slim intermediate as Parquet to the shared folder and reads it
    back, so that a lost executor costs no recomputation and no second scan of the texts. The shuffle
    files behind it go at once, as nothing reads them again. keep: release() leaves it; batch: rows of an
    Arrow batch."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    if not keep:
        _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    settings = {_CLEANUP: "true", _BATCH: str(batch)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Deletes the intermediates made so far, on whatever file system they are. Only for when every
    result that reads them has been written."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def forget(*frames: DataFrame) -> None:
    """Deletes intermediates that nothing reads any more; each frame as materialise() gave it."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quarry-" in path:
                _delete(df.sparkSession, path)


def with_row(df: DataFrame, row: str = "_row") -> DataFrame:
    """A number for each row. Only stable once materialised; doc_id may repeat or be null."""
    return df.withColumn(row, F.monotonically_increasing_id())


def trimmed(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """kernel, and at the end of a partition the worker's free memory goes back to the system:
    workers live on, and what one stage has used would add to the next one's need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        give_back()

    return run


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """kernel over every Arrow batch, empty ones left out; nulls reach the kernel as they are. Nothing but
    what the kernel yields leaves a batch."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from kernel(batch)

    return df.mapInArrow(trimmed(run), schema)


def key_order(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]
