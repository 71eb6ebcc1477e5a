"""Archives as DataFrames: scan, pack, list, totals, test, tree, convert, add, extract, repair.

A blob is one row, an entry is one row; entries never need the blob again. An archive is packed in
volumes of bounded size, each a blob of its own with the archive's name: rows are dealt by archive and a
hash of the entry's name, so that neither a task nor a blob holds a large archive whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.containers import archive
from quarry.containers.model import ENTRIES, arrow_schema
from quarry.functions import entries as E
from quarry.functions import paths as P
from quarry.functions.codecs import bound_batches
from quarry.sources.archive import batched

VOLUME_BYTES = 64 << 20
REPAIR = "archive string, kind string, start bigint, stop bigint, name string, method string, size bigint, status string, content binary, crc32 bigint"


def scan(
    blobs: DataFrame, content: str = "content", name: str = "archive", format: str | None = None, mode: str = "auto", lenient: bool = False, with_content: bool = False, with_raw: bool = False,
    verify: bool = False, password: bytes | None = None, memory_limit: int | None = None, max_ratio: float | None = None, names: Iterable[str] | None = None, prefixes: Iterable[str] = (),
) -> DataFrame:
    """Entry rows (containers.model.ENTRIES) of a column of archives. Payloads are decoded only with
    with_content or verify; names and prefixes pick entries before that. Entries are decoded one by one
    and leave in batches of about 32 MB of payload."""
    schema, keep = arrow_schema(), None if names is None else set(names)
    options = {"format": format, "mode": mode, "lenient": lenient, "content": with_content, "raw": with_raw, "verify": verify, "password": password, "memory_limit": memory_limit, "max_ratio": max_ratio, "names": keep, "prefixes": tuple(prefixes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for held in batched(archive.iter_rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or "", **options)):
                    yield pa.RecordBatch.from_pylist(held, schema)

    bound_batches(blobs.sparkSession)
    return blobs.select(F.col(content), F.col(name).cast("string")).mapInArrow(run, ENTRIES)


def read(spark, path: str, **options: object) -> DataFrame:
    """Entries of the archive files under a path, through Spark's own file reader (any file system)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"), "content")
    return scan(files, **options)


def pack(rows: DataFrame, format: str, by: str = "archive", order: str = "entry_index", level: int = 6, store_below: int = 0, password: bytes | None = None, encryption: str = "aes256", method: str = "Deflate", sanitise: bool = True, most: int = VOLUME_BYTES, sizes: DataFrame | None = None) -> DataFrame:
    """(by, content): archive blobs for each value of ``by``, one unless its payload is over ``most`` bytes:
    then volumes of about that size, rows of the same ``by``. sizes (by, size): payload bytes, where they are
    known more cheaply than by a second pass over the rows. Rows need name and content and may have any other
    column of the entry relation. Names are made safe unless told otherwise."""
    known = [c for c in rows.columns if c in ENTRIES.names and c not in (by, order)]
    slim = rows.select(F.col(by), F.col(order), *[P.sanitise_path(F.col("name")).alias("name") if c == "name" and sanitise else F.col(c) for c in known])
    kind = slim.schema[by].dataType.simpleString()
    payload = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("content", "raw_content") if c in known]
    dealt = volumes(slim, by, most, sum(payload[1:], payload[0]), sizes)

    def run(group: pa.Table) -> pa.Table:
        at = pa.compute.sort_indices(group, [(order, "ascending"), ("name", "ascending")])
        each = (r for i in range(0, len(at), 64) for r in group.take(at[i : i + 64]).to_pylist())
        blob = archive.pack(each, format, level, store_below, password, encryption, method)
        return pa.table({by: group.column(by).slice(0, 1), "content": pa.array([blob], pa.binary())})

    # a number of its own, which adaptive execution keeps: packing is work for the processor, not for the disk
    dealt = dealt.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by, "volume")
    return dealt.groupBy(by, "volume").applyInArrow(run, f"`{by}` {kind}, content binary")


def volumes(rows: DataFrame, by: str, most: int, size: Column | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """rows with a column ``volume``: archives of more than ``most`` payload bytes fall into several
    of about that size, by a hash of the name. Totals are summed before they are shuffled."""
    size = F.octet_length("content") if size is None else size
    each, size = (rows, size) if sizes is None else (sizes, F.col("size"))
    totals = each.groupBy(by).agg(F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(size), F.lit(0)) / most)).cast("int").alias("_n")).withColumnRenamed(by, "_by")
    out = rows.join(totals, F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn("volume", F.pmod(F.xxhash64("name"), F.col("_n")).cast("int")).drop("_by", "_n")


def filtered(entries: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), files: Iterable[str] = ()) -> DataFrame:
    return entries.filter(P.matches_filters(F.col("name"), include, exclude) & P.in_file_list(F.col("name"), files))


SORTS = {
    "name": lambda: F.col("name"),
    "size": lambda: F.col("size"),
    "date": lambda: F.col("modified"),
    "ratio": lambda: E.sort_ratio(F.col("size"), F.col("compressed_size")),
}


def order_of(sort: str = "name", reverse: bool = False) -> list[Column]:
    """Sort keys; missing dates come first. Reversing turns the whole list, ties included."""
    key = SORTS[sort]()
    return [key.desc_nulls_last(), F.col("entry_index").desc()] if reverse else [key.asc_nulls_first(), F.col("entry_index").asc()]


def listing(entries: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), sort: str = "name", reverse: bool = False) -> DataFrame:
    """Filtered and sorted entries, each archive by itself: ``position`` from 1."""
    rank = F.row_number().over(Window.partitionBy("archive").orderBy(*order_of(sort, reverse)))
    return filtered(entries, include, exclude).withColumn("position", rank)


def listing_json(entries: DataFrame) -> DataFrame:
    """(archive, position, json) of the listing's objects."""
    c = F.col
    return entries.select("archive", "entry_index", E.json_entry(c("name"), c("size"), c("compressed_size"), c("method"), c("crc32"), c("modified"), c("entry_type")).alias("json"))


def totals(entries: DataFrame, *by: str) -> DataFrame:
    """Files, directories, sizes and ratio by archive (or other columns)."""
    by = by or ("archive",)
    files, dirs = F.count_if(~E.is_dir(F.col("entry_type"))), F.count_if(E.is_dir(F.col("entry_type")))
    out = entries.groupBy(*by).agg(files.alias("files"), dirs.alias("dirs"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("compressed_size"))
    return out.withColumn("ratio", E.compression_ratio(F.col("size"), F.col("compressed_size")))


def test(blobs: DataFrame, **options: object) -> DataFrame:
    """Integrity by archive: total, ok, failed and the names that failed."""
    entries = scan(blobs, verify=True, **options)
    failed = F.col("status") != "OK"
    return entries.groupBy("archive").agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"), F.sort_array(F.collect_list(F.when(failed, F.concat_ws(": ", "name", "status")))).alias("errors"))


def tree(entries: DataFrame) -> DataFrame:
    """(archive, path, name, depth, is_dir, size): every entry and every directory that names imply."""
    prefixes = P.tree_prefixes(F.col("name"))
    nodes = entries.select("archive", "entry_type", "size", F.size(prefixes).alias("_n"), F.posexplode(prefixes).alias("_i", "path"))
    last = F.col("_i") == F.col("_n") - 1
    own_dir = F.when(last, E.is_dir(F.col("entry_type"))).otherwise(True)
    out = nodes.groupBy("archive", "path").agg(F.max(own_dir).alias("is_dir"), F.max(F.when(last & ~E.is_dir(F.col("entry_type")), F.col("size"))).alias("size"))
    return out.select("archive", "path", F.substring_index("path", "/", -1).alias("name"), F.size(F.split("path", "/")).alias("depth"), "is_dir", "size")


def tree_lines(entries: DataFrame) -> DataFrame:
    """(archive, position, line): the drawn tree; directories first, the first level without glyphs."""
    nodes = tree(entries).withColumn("_parent", F.when(F.col("depth") > 1, F.expr("substring(path, 1, length(path) - length(name) - 1)")).otherwise(F.lit("")))
    within = Window.partitionBy("archive", "_parent").orderBy(F.col("is_dir").desc(), F.col("name"))
    nodes = nodes.withColumn("_last", F.lead("path").over(within).isNull()).withColumn("_rank", F.row_number().over(within))
    # a node's place and prefix come from the ranks and ends of its ancestors
    steps = nodes.select("archive", F.col("path").alias("_p"), F.col("_rank").alias("_r"), F.col("_last").alias("_e"), F.col("depth").alias("_d"))
    lines = nodes.select("archive", "path", "name", "is_dir", "depth", F.explode(P.tree_prefixes(F.col("path"))).alias("_p")).join(steps, ["archive", "_p"])
    lines = lines.groupBy("archive", "path", "name", "is_dir", "depth").agg(F.sort_array(F.collect_list(F.struct("_d", "_r", "_e"))).alias("_way"))
    middle = F.array_join(F.transform(F.expr("slice(_way, 2, greatest(size(_way) - 2, 0))"), lambda s: F.when(s["_e"], F.lit("    ")).otherwise(F.lit("│   "))), "")
    glyph = F.when(F.col("depth") == 1, F.lit("")).otherwise(F.concat(middle, F.when(F.element_at("_way", -1)["_e"], F.lit("└── ")).otherwise(F.lit("├── "))))
    line = F.concat(glyph, F.col("name"), F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")))
    at = F.row_number().over(Window.partitionBy("archive").orderBy(F.transform("_way", lambda s: s["_r"])))
    return lines.select("archive", at.alias("position"), line.alias("line"))


def convert(blobs: DataFrame, to: str, password: bytes | None = None, **options: object) -> DataFrame:
    """Archives of any readable format as ``to``; all entry columns travel along. An archive with an
    entry that cannot be decoded is an error."""
    read_ = scan(blobs, with_content=True, password=password)
    checked = read_.withColumn("content", F.when(F.col("status") == "OK", F.col("content")).otherwise(F.raise_error(F.concat_ws(": ", F.lit("cannot convert"), "archive", "name", "status")).cast("binary")))
    if to not in ("zip", "tar", "lzh"):
        checked = checked.filter(~E.is_dir(F.col("entry_type")))
    return pack(checked, to, sizes=scan(blobs, password=password).select("archive", "size"), **options)


def add(blobs: DataFrame, rows: DataFrame, format: str, **options: object) -> DataFrame:
    """Archives with rows (archive, name, content, ...) appended; old payloads are taken as they are
    where the format can (ZIP and LZH), encrypted ZIP entries are an error."""
    if format not in ("zip", "tar", "lzh"):
        raise ValueError(f"cannot add to {format}")
    old = scan(blobs, with_content=format == "tar", with_raw=format != "tar")
    old = old.withColumn("name", F.when(F.col("encrypted"), F.raise_error(F.concat(F.lit("encrypted entry: "), F.col("name")))).otherwise(F.col("name")))
    new = rows.withColumn("entry_index", F.coalesce(F.col("entry_index"), F.lit(0)) + (1 << 30)) if "entry_index" in rows.columns else rows.withColumn("entry_index", (F.lit(1 << 30) + F.row_number().over(Window.partitionBy("archive").orderBy("name"))).cast("int"))
    both = old.select(*[c for c in old.columns if c not in ("warnings", "extra", "name_raw")]).unionByName(new.withColumn("entry_index", F.col("entry_index").cast("int")), allowMissingColumns=True)
    sizes = scan(blobs).select("archive", "size").union(rows.select("archive", F.octet_length("content").cast("bigint")))
    return pack(both, format, sizes=sizes, **options)


def single_stream(rows: DataFrame, codec: str, content: str = "content", level: int | None = None) -> DataFrame:
    from quarry.functions.codecs import compress

    bound_batches(rows.sparkSession)
    return rows.withColumn(content, compress(F.col(content), codec, level))


def extracted(entries: DataFrame, root: str = "", strict_names: bool = False) -> DataFrame:
    """(path, content, size) of files to write: safe, with reserved names rewritten."""
    safe = P.rewrite_path(P.sanitise_path(F.col("name")), strict_names)
    target = F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.col("archive"), F.lit("/"), safe) if root else safe
    return entries.filter((F.col("status") == "OK") & E.is_file(F.col("entry_type"))).select("archive", target.alias("path"), "content", "size")


def to_write(files: DataFrame, existing: DataFrame, overwrite: str = "always") -> DataFrame:
    """Files that the overwrite policy lets through: always, or never over what exists (path)."""
    if overwrite == "always":
        return files
    if overwrite == "never":
        return files.join(existing.select("path"), "path", "left_anti")
    raise ValueError("policy is always or never")


def repair(blobs: DataFrame, content: str = "content", name: str = "archive", format: str | None = None, max_size: int = 64 << 20) -> DataFrame:
    """Recovered entries and skipped ranges of damaged ZIP and TAR blobs, as rows with a kind. A payload
    that would decode to more than ``max_size`` bytes is not decoded: its row is RawOnly, without content."""
    names = [f.split(" ")[0] for f in REPAIR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("archive", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("name", pa.string()), ("method", pa.string()), ("size", pa.int64()), ("status", pa.string()), ("content", pa.binary()), ("crc32", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                found = archive.recover(data, format, max_size) if data is not None else []
                if found:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} | {"archive": batch.column(1)[i].as_py()} for r in found], kinds)

    return blobs.select(F.col(content), F.col(name).cast("string")).mapInArrow(run, REPAIR)


def skipped_ranges(recovered: DataFrame) -> DataFrame:
    """Half-open gaps between recovered spans (archive, start, stop), by a window instead of the scan."""
    w = Window.partitionBy("archive").orderBy("start")
    before = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return recovered.withColumn("_from", before).filter(F.col("start") > F.col("_from")).select("archive", F.col("_from").alias("start"), F.col("start").alias("stop"))
