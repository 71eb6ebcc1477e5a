"""Queries of archive operators: archives are built from table rows inside Spark and read back, so
that the oracle is plain SQL over the base table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import archives as A
from quarry.plans.scalars import table

TURN_BYTES = 1 << 17
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: one archive a language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("archive"), F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("entry_index"))


def placed(entries: DataFrame) -> DataFrame:
    """entries of files() with their place in the whole archive: a volume only numbers its own."""
    return entries.withColumn("entry_index", F.regexp_extract("name", r"/(\d+)\.txt$", 1).cast("bigint"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as small files: one archive a role."""
    d = table(spark, sf_dir, "conversations")
    return d.select(F.col("role").alias("archive"), F.format_string("c%d/t%d.txt", "conv_id", "turn").alias("name"), F.col("text").cast("binary").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).alias("entry_index"))


def packed(spark: SparkSession, sf_dir: str, format: str, **options: object) -> DataFrame:
    """The files packed in volumes small enough for every core to have some."""
    return A.pack(files(spark, sf_dir), format, most=2 << 20, **options)


def packed_turns(spark: SparkSession, sf_dir: str, format: str, **options: object) -> DataFrame:
    """The turns packed in small volumes: an entry costs a key or a code of its own, however
    short it is, so three archives of 64 MB volumes would be work for a few cores only."""
    return A.pack(turns(spark, sf_dir), format, **{"most": TURN_BYTES, **options})


def broken_heads(blobs: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """TAR blobs with a wrong byte in front. first (archive, name): only the volume that begins with that
    file, so that an archive has one broken header however many volumes it takes."""
    broken = F.concat(F.lit(b"x"), F.expr("substring(content, 2)"))
    if first is None:
        return blobs.select("archive", broken.alias("content"))
    head = F.concat(F.col("_name").cast("binary"), F.lit(b"\0"))
    known = F.broadcast(first.select(F.col("archive").alias("_archive"), F.col("name").alias("_name")))  # a row for each archive
    begins = F.substring(F.col("content"), F.lit(1), F.octet_length(head)) == head
    return blobs.join(known, F.col("archive").eqNullSafe(F.col("_archive"))).select("archive", F.when(begins, broken).otherwise(F.col("content")).alias("content"))


def first_files(rows: DataFrame) -> DataFrame:
    """(archive, name) of the file that comes first in each archive."""
    return rows.groupBy("archive").agg(F.min(F.struct("entry_index", "name"))["name"].alias("name"))


FILES_SQL = "(SELECT lang AS archive, 'src/' || source || '/' || doc_id || '.txt' AS name, text, doc_id FROM documents)"
TURNS_SQL = "(SELECT role AS archive, 'c' || conv_id || '/t' || turn || '.txt' AS name, text FROM conversations)"


def digest(entries: DataFrame) -> DataFrame:
    return entries.select("archive", "name", "size", F.sha2("content", 256).alias("digest"), "status")


ENTRY_SQL = "SELECT archive, name, strlen(text) AS size, sha256(text) AS digest, 'OK' AS status FROM "


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack one ZIP a language, read it back, verify every checksum, total it."""
    entries = A.scan(packed(spark, sf_dir, "zip"), verify=True)
    return entries.groupBy("archive").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.count_if(F.col("status") == "OK").alias("ok"))


query("zip_round_trip_totals", f"SELECT archive, count(*) AS files, sum(strlen(text))::BIGINT AS size, count(*) AS ok FROM {FILES_SQL} GROUP BY archive")(flagship)
query("zip_round_trip_entries", ENTRY_SQL + FILES_SQL)(lambda s, d: digest(A.scan(packed(s, d, "zip"), with_content=True)))
query("tar_round_trip_entries", ENTRY_SQL + FILES_SQL)(lambda s, d: digest(A.scan(packed(s, d, "tar"), with_content=True)))
query("lzh_round_trip_entries", ENTRY_SQL + TURNS_SQL)(lambda s, d: digest(A.scan(packed_turns(s, d, "lzh"), with_content=True)))
for _m in ("Stored", "LZMA", "Bzip2", "Zstd"):
    query(f"zip_method_{_m.lower()}", ENTRY_SQL + TURNS_SQL)(lambda s, d, m=_m: digest(A.scan(packed_turns(s, d, "zip", method=m), with_content=True)))
for _e in ("aes256", "traditional"):
    query(f"zip_encrypted_{_e}", ENTRY_SQL + TURNS_SQL)(lambda s, d, e=_e: digest(A.scan(packed_turns(s, d, "zip", password=b"secret", encryption=e), with_content=True, password=b"secret")))
query("zip_wrong_password", "SELECT archive, count(*) AS entries, 0::BIGINT AS opened FROM " + TURNS_SQL + " GROUP BY archive")(lambda s, d: A.scan(packed_turns(s, d, "zip", password=b"secret"), with_content=True, password=b"guess").groupBy("archive").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("status") == "OK").alias("opened")))
query("zip_store_threshold", f"SELECT archive, name, CASE WHEN strlen(text) < 1024 THEN 'Stored' ELSE 'Deflate' END AS method FROM {FILES_SQL}")(lambda s, d: A.scan(packed(s, d, "zip", store_below=1024)).select("archive", "name", "method"))
query("zip_local_headers", f"SELECT archive, name, strlen(text) AS size FROM {FILES_SQL}")(lambda s, d: A.scan(packed(s, d, "zip"), mode="local_headers").select("archive", "name", "size"))
query("zip_lookup", f"SELECT archive, name, sha256(text) AS digest FROM {FILES_SQL} WHERE name LIKE 'src/src1/%'")(lambda s, d: A.scan(packed(s, d, "zip"), with_content=True, prefixes=["src/src1/"]).select("archive", "name", F.sha2("content", 256).alias("digest")))
query("listing_sorted", f"SELECT archive, name, row_number() OVER (PARTITION BY archive ORDER BY strlen(text) DESC, doc_id DESC) AS position FROM {FILES_SQL} WHERE name LIKE 'src/src1%' AND name NOT LIKE '%5.txt'")(
    lambda s, d: A.listing(placed(A.scan(packed(s, d, "tar"))), ["src/src1*"], ["*5.txt"], "size", True).select("archive", "name", F.col("position").cast("bigint").alias("position"))
)
query("listing_json", f"SELECT archive, '{{\"name\":\"' || name || '\",\"size\":' || strlen(text) || ',\"compressed_size\":' || strlen(text) || ',\"ratio\":1.0,\"method\":\"Stored\",\"mtime\":0,\"is_dir\":false}}' AS json FROM {FILES_SQL}")(lambda s, d: A.listing_json(A.scan(packed(s, d, "tar"))).select("archive", "json"))
query("archive_totals", f"SELECT archive, count(*) AS files, 0::BIGINT AS dirs, sum(strlen(text))::BIGINT AS size, sum(strlen(text))::BIGINT AS compressed_size, 1.0::DOUBLE AS ratio FROM {FILES_SQL} GROUP BY archive")(lambda s, d: A.totals(A.scan(packed(s, d, "tar"))))
query("integrity_test", f"SELECT archive, count(*) AS total, count(*) AS ok, 0::BIGINT AS failed FROM {FILES_SQL} GROUP BY archive")(lambda s, d: A.test(packed(s, d, "zip")).drop("errors"))
query("tree_nodes", f"SELECT archive, 'src' AS path, 1 AS depth, true AS is_dir FROM {FILES_SQL} GROUP BY archive UNION ALL SELECT archive, 'src/' || split_part(name, '/', 2), 2, true FROM {FILES_SQL} GROUP BY ALL UNION ALL SELECT archive, name, 3, false FROM {FILES_SQL}")(lambda s, d: A.tree(A.scan(packed(s, d, "zip"))).select("archive", "path", "depth", "is_dir"))
query("tree_lines", f"""WITH f AS (SELECT archive, split_part(name, '/', 2) AS dir, split_part(name, '/', 3) AS leaf FROM {FILES_SQL}), dirs AS (SELECT DISTINCT archive, dir FROM f), lastd AS (SELECT archive, max(dir) AS dir FROM dirs GROUP BY archive), lastf AS (SELECT archive, dir, max(leaf) AS leaf FROM f GROUP BY ALL),
lines AS (SELECT DISTINCT archive, '' AS dir, '' AS leaf, 'src/' AS line FROM f UNION ALL SELECT d.archive, d.dir, '', CASE WHEN l.dir IS NOT NULL THEN '└── ' ELSE '├── ' END || d.dir || '/' FROM dirs d LEFT JOIN lastd l ON d.archive = l.archive AND d.dir = l.dir UNION ALL
SELECT f.archive, f.dir, f.leaf, CASE WHEN l.dir IS NOT NULL THEN '    ' ELSE '│   ' END || CASE WHEN e.leaf IS NOT NULL THEN '└── ' ELSE '├── ' END || f.leaf FROM f LEFT JOIN lastd l ON f.archive = l.archive AND f.dir = l.dir LEFT JOIN lastf e ON f.archive = e.archive AND f.dir = e.dir AND f.leaf = e.leaf)
SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY dir, leaf) AS position, line FROM lines""")(lambda s, d: A.tree_lines(A.scan(packed(s, d, "zip"))).select("archive", F.col("position").cast("bigint").alias("position"), "line"))
query("convert_zip_tar", ENTRY_SQL + FILES_SQL)(lambda s, d: digest(A.scan(A.convert(packed(s, d, "zip"), "tar", most=2 << 20), with_content=True)))
query("convert_tar_lzh", ENTRY_SQL + TURNS_SQL)(lambda s, d: digest(A.scan(A.convert(packed_turns(s, d, "tar"), "lzh", most=TURN_BYTES), with_content=True)))
for _f in ("zip", "tar", "lzh"):
    query(f"add_{_f}", f"{ENTRY_SQL} {TURNS_SQL} UNION ALL SELECT archive, 'extra.txt', 5, sha256('hello'), 'OK' FROM {TURNS_SQL} GROUP BY archive")(
        lambda s, d, f=_f: digest(A.scan(A.add(packed_turns(s, d, f), turns(s, d).select("archive").distinct().select("archive", F.lit("extra.txt").alias("name"), F.lit(b"hello").alias("content")), f, most=TURN_BYTES), with_content=True))
    )
for _f, _codec in (("GZIP", "gzip"), ("XZ", "xz"), ("Bzip2", "bzip2"), ("Zstandard", "zstd"), ("LZ4", "lz4"), ("Brotli", "brotli"), ("Snappy", "snappy")):
    query(f"stream_scan_{_codec}", f"SELECT doc_id::VARCHAR AS archive, '{_f}' AS format, strlen(text) AS size, sha256(text) AS digest FROM documents")(
        lambda s, d, f=_f, c=_codec: A.scan(A.single_stream(table(s, d, "documents").select(F.col("doc_id").alias("archive"), F.col("text").cast("binary").alias("content")), c), format=f, with_content=True).select("archive", "format", "size", F.sha2("content", 256).alias("digest"))
    )
query("extract_plan", f"SELECT archive, 'out/' || archive || '/' || name AS path, sha256(text) AS digest FROM {FILES_SQL}")(lambda s, d: A.extracted(A.scan(packed(s, d, "zip"), with_content=True), "out").select("archive", "path", F.sha2("content", 256).alias("digest")))
query("extract_never_overwrite", f"SELECT name AS path FROM {FILES_SQL} WHERE doc_id % 3 <> 0")(lambda s, d: A.to_write(files(s, d).select(F.col("name").alias("path")), files(s, d).filter("entry_index % 3 = 0").select(F.col("name").alias("path")), "never"))
query("create_dry_run", "SELECT count(*) AS files, sum(strlen(text))::BIGINT AS size FROM documents")(lambda s, d: files(s, d).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("size")))
query("archive_volumes", f"SELECT archive, count(*) AS files, sum(strlen(text))::BIGINT AS size FROM {FILES_SQL} GROUP BY archive")(
    lambda s, d: A.scan(A.pack(A.volumes(files(s, d), "archive", 256 << 10).withColumn("archive", F.concat_ws("#", "archive", "volume")), "zip")).groupBy(F.substring_index("archive", "#", 1).alias("archive")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))
)


def _broken(s: SparkSession, d: str, format: str) -> DataFrame:
    """Archives without their directory: cut after the payloads, and with junk in front."""
    whole = packed_turns(s, d, format)
    return whole.select("archive", F.concat(F.lit(b"junk" * (4 if format == "zip" else 128)), "content").alias("content"))


query("repair_zip", f"SELECT archive, name, 'Verified' AS status, sha256(text) AS digest FROM {TURNS_SQL}")(lambda s, d: A.repair(_broken(s, d, "zip")).filter("kind = 'entry'").select("archive", "name", "status", F.sha2("content", 256).alias("digest")))
query("repair_tar", f"SELECT archive, name, 'Recovered' AS status, sha256(text) AS digest FROM {TURNS_SQL}")(lambda s, d: A.repair(_broken(s, d, "tar"), format="TAR").filter("kind = 'entry'").select("archive", "name", "status", F.sha2("content", 256).alias("digest")))
query("repair_skipped_ranges", f"SELECT archive, 0::BIGINT AS start, 16::BIGINT AS stop FROM {TURNS_SQL} GROUP BY archive")(lambda s, d: A.skipped_ranges(A.repair(_broken(s, d, "zip")).filter("kind = 'entry'").select("archive", "start", "stop")))
query("lenient_tar", f"SELECT archive, count(*) - 1 AS entries, 2::BIGINT AS warnings FROM {TURNS_SQL} GROUP BY archive")(
    lambda s, d: A.scan(broken_heads(packed_turns(s, d, "tar"), first_files(turns(s, d))), lenient=True).groupBy("archive").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size("warnings")).alias("warnings"))
)
query("corrupt_archives", f"SELECT archive, 'CORRUPT' AS status FROM {TURNS_SQL} GROUP BY archive")(lambda s, d: A.scan(broken_heads(packed_turns(s, d, "tar"))).select("archive", "status").distinct())
query("detect_archives", f"SELECT archive, 'ZIP' AS zip, 'TAR' AS tar FROM {TURNS_SQL} GROUP BY archive")(lambda s, d: _detected(s, d))


def _detected(s: SparkSession, d: str) -> DataFrame:
    from quarry.functions.detect import detect

    # an archive may take several volumes, which are of one format
    z, t = (packed_turns(s, d, f).select("archive", detect(F.col("content")).alias(f)).distinct() for f in ("zip", "tar"))
    return z.join(t, "archive")
