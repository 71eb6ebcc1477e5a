"""Queries of scalar functions and aggregates over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.codecs import szip
from quarry.codecs.lzw import TIFF_NO_CLEAR, gif
from quarry.functions import bits as B
from quarry.functions import codecs as C
from quarry.functions import detect as D
from quarry.functions import entries as E
from quarry.functions import paths as P
from quarry.functions import times as T
from quarry.operators import training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, source: str, sql: str | None = None):
    """Registers f(table) under a name."""

    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(table(spark, sf_dir, source))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files give fewer splits than that, in bounded batches: codecs are work for
    the processor."""
    C.bound_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


CHUNK = 4096
_CHUNKS = f"(SELECT doc_id, i AS chunk, substr(text, i * {CHUNK} + 1, {CHUNK}) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) + {CHUNK - 1}) // {CHUNK}, 1))) AS i FROM documents WHERE text IS NOT NULL))"


def chunks(df: DataFrame) -> DataFrame:
    """(doc_id, chunk, text): texts in pieces of CHUNK characters, for kernels that take a value whole."""
    last = F.greatest(F.ceil(F.length("text") / CHUNK).cast("int") - 1, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr("text", i * CHUNK + 1, F.lit(CHUNK)))
    return spread(df.select("doc_id", F.posexplode(pieces).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("bigint")))


def _round_trip(name: str, there: Callable[[Column], Column], back: Callable[[Column], Column], head: str | None = None, coded: bool = True, pieces: bool = False) -> None:
    """Texts through a codec and back. head: the bytes, in hex, that its streams begin with; coded: what is
    stored differs from the text, if there is any."""
    keys, rows, source = (["doc_id", "chunk"], chunks, _CHUNKS) if pieces else (["doc_id"], spread, "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)")
    def run(df: DataFrame) -> DataFrame:
        begins = F.hex(F.substring("packed", 1, len(head) // 2)).alias("head") if head else ((F.col("packed") != F.col("text").cast("binary")) | (F.col("text") == "")).alias("coded")
        packed = rows(df.select("doc_id", "text").where("text is not null")).withColumn("packed", there(F.col("text").cast("binary")))
        # a condition between both ways: codecs right behind one another are run as one, and packing a second time for ``packed``
        plain = packed.withColumn("plain", back(F.when(F.col("packed").isNotNull(), F.col("packed"))))
        return plain.select(*keys, F.octet_length("plain").cast("bigint").alias("n_bytes"), F.sha2("plain", 256).alias("digest"), *[begins for _ in [0] if head or coded])

    more = f", '{head}' AS head" if head else ", true AS coded" if coded else ""
    query(name, "documents", f"SELECT {', '.join(keys)}, strlen(text) AS n_bytes, sha256(text) AS digest{more} FROM {source}")(run)


#: What streams begin with, from the formats' own descriptions.
HEADS = {"zlib": "78", "gzip": "1F8B08", "lzma": "5D", "xz": "FD377A585A00", "bzip2": "425A68", "zstd": "28B52FFD", "lz4": "04224D18", "snappy": "FF060000734E61507059"}
for _codec in ("deflate", "zlib", "gzip", "lzma", "lzma2", "xz", "bzip2", "zstd", "lz4", "brotli", "snappy", "snappy_raw", "stored"):
    _round_trip(f"codec_{_codec}", lambda c, k=_codec: C.compress(c, k), lambda c, k=_codec: C.decompress(c, k), HEADS.get(_codec), _codec != "stored")
_round_trip("codec_deflate_level_1", lambda c: C.compress(c, "deflate", 1), lambda c: C.decompress(c, "deflate"))
_round_trip("codec_zstd_level_19", lambda c: C.compress(c, "zstd", 19), lambda c: C.decompress(c, "zstd"), HEADS["zstd"])
_DICT = b"the and of to that with for was his her they this from have not are but had"
_round_trip("dict_deflate", lambda c: C.deflate_with_dictionary(c, _DICT), lambda c: C.inflate_with_dictionary(c, _DICT))
_round_trip("dict_zlib", lambda c: C.zlib_with_dictionary(c, _DICT), lambda c: C.unzlib_with_dictionary(c, _DICT), "78")
_round_trip("dict_zstd", lambda c: C.zstd_with_dictionary(c, _DICT), lambda c: C.unzstd_with_dictionary(c, _DICT), HEADS["zstd"])
_round_trip("dict_lz4", lambda c: C.lz4_with_dictionary(c, _DICT), lambda c: C.unlz4_with_dictionary(c, _DICT), HEADS["lz4"], pieces=True)
_round_trip("dict_snappy", lambda c: C.snappy_with_dictionary(c, _DICT), lambda c: C.unsnappy_with_dictionary(c, _DICT), HEADS["snappy"], pieces=True)
_round_trip("lzw_tiff", C.lzw, C.unlzw, pieces=True)
_round_trip("lzw_tiff_no_clear", lambda c: C.lzw(c, TIFF_NO_CLEAR), lambda c: C.unlzw(c, TIFF_NO_CLEAR), pieces=True)
_round_trip("lzw_gif", lambda c: C.lzw(c, gif(8)), lambda c: C.unlzw(c, gif(8)), pieces=True)
for _m in ("lh0", "lh4", "lh5", "lh6", "lh7"):
    _round_trip(f"lzh_{_m}", lambda c, m=_m: C.lzh_pack(c, m), lambda c, m=_m: C.lzh_unpack(c, m), coded=False, pieces=True)
_round_trip("lzh_dictionary", lambda c: C.lzh_pack(c, "lh5", _DICT), lambda c: C.lzh_unpack(c, "lh5", _DICT), coded=False, pieces=True)
_round_trip("lz4_block_fast", lambda c: C.lz4_block(c, step=2), C.lz4_unblock, pieces=True)
_round_trip("lz4_block_hc", lambda c: C.lz4_block(c, 9, _DICT), lambda c: C.lz4_unblock(c, _DICT), pieces=True)
_round_trip("bwt_inverse", C.bwt, C.inverse_bwt, pieces=True)
_round_trip("mtf_inverse", C.mtf, C.inverse_mtf, coded=False, pieces=True)
_round_trip("rle1_inverse", C.rle1, C.inverse_rle1, coded=False, pieces=True)
_round_trip("zipcrypto", lambda c: C.zipcrypto_encrypt(c, b"secret"), lambda c: C.zipcrypto_decrypt(c, b"secret"), pieces=True)
_round_trip("ae2_aes256", lambda c: C.ae2_encrypt(c, b"secret", 3), lambda c: C.ae2_decrypt(c, b"secret", 3), pieces=True)
_round_trip("ae2_aes128", lambda c: C.ae2_encrypt(c, b"secret", 1), lambda c: C.ae2_decrypt(c, b"secret", 1), pieces=True)

# ---- checksums ----

_BYTES = "list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex({0}), 2 * i - 1, 2))::{1})"


def _crc_sql(column: str, poly: int, ones: int, final: int, kind: str = "BIGINT") -> str:
    """Bitwise CRC: eight shifts for each byte."""
    step = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::{kind}[], lambda r, z: xor(r >> 1, {poly}::{kind} * (r & 1::{kind})))"
    return f"xor(list_reduce(list_concat([{ones}]::{kind}[], {_BYTES.format(column, kind)}), lambda c, b: {step}), {final}::{kind})"


query("crc32_names", "customer", f"SELECT c_custkey, {_crc_sql('c_name', 0xEDB88320, 0xFFFFFFFF, 0xFFFFFFFF)} AS crc FROM customer")(lambda df: df.select("c_custkey", F.crc32(F.col("c_name").cast("binary")).alias("crc")))
query("crc16_names", "customer", f"SELECT c_custkey, {_crc_sql('c_name', 0xA001, 0, 0)} AS crc FROM customer")(lambda df: df.select("c_custkey", C.crc16(F.col("c_name")).alias("crc")))
query("crc32c_names", "customer", f"SELECT c_custkey, {_crc_sql('c_name', 0x82F63B78, 0xFFFFFFFF, 0xFFFFFFFF)} AS crc FROM customer")(lambda df: df.select("c_custkey", C.crc32c(F.col("c_name")).alias("crc")))
query("crc64_names", "customer", f"SELECT c_custkey, lower(lpad(to_hex({_crc_sql('c_name', 0xC96C5795D7870F42, (1 << 64) - 1, (1 << 64) - 1, 'UBIGINT')}), 16, '0')) AS crc FROM customer")(lambda df: df.select("c_custkey", C.crc64(F.col("c_name")).alias("crc")))
query("dual_crc", "supplier", f"SELECT s_suppkey, {_crc_sql('s_name', 0xEDB88320, 0xFFFFFFFF, 0xFFFFFFFF)} AS crc32, {_crc_sql('s_name', 0xA001, 0, 0)} AS crc16 FROM supplier")(lambda df: df.select("s_suppkey", C.dual_crc(F.col("s_name")).alias("d")).select("s_suppkey", "d.crc32", "d.crc16"))
_A = f"list_sum({_BYTES.format('p_name', 'BIGINT')})"
_B = f"list_sum(list_transform({_BYTES.format('p_name', 'BIGINT')}, lambda b, i: b * (strlen(p_name) - i + 1)))"
_ADLER = f"SELECT p_partkey, ((((strlen(p_name) + {_B}) % 65521) * 65536) + ((1 + {_A}) % 65521))::BIGINT AS adler FROM part"
query("adler32_udf", "part", _ADLER)(lambda df: df.select("p_partkey", C.adler32(F.col("p_name")).alias("adler")))
query("adler32_expression", "part", _ADLER)(lambda df: df.select("p_partkey", C.adler32_expr(F.col("p_name")).alias("adler")))
query("sha256_documents", "documents", "SELECT doc_id, sha256(text) AS digest FROM documents")(lambda df: df.select("doc_id", C.sha256(F.col("text")).alias("digest")))
query("crc_mask", "orders", "SELECT o_orderkey, (((((o_orderkey * 2654435761) & 4294967295) >> 15) | ((((o_orderkey * 2654435761) & 4294967295) << 17) & 4294967295)) + 2726488792) & 4294967295 AS masked, (o_orderkey * 2654435761) & 4294967295 AS unmasked FROM orders")(
    lambda df: df.select("o_orderkey", B.mask_crc((F.col("o_orderkey") * 2654435761).bitwiseAND(F.lit(B.MASK32))).alias("masked")).select("o_orderkey", "masked", B.unmask_crc(F.col("masked")).alias("unmasked"))
)
query("running_crc32", "conversations", f"WITH whole AS (SELECT conv_id, string_agg(role, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, {_crc_sql('t', 0xEDB88320, 0xFFFFFFFF, 0xFFFFFFFF)} AS crc32 FROM whole")(lambda df: training.running_crc32(df, "conv_id", "turn", "role"))
_NATIONS = [f"NATION_{i}" for i in range(25)]


def _vectors(f: Callable[[bytes], object]) -> str:
    """Known values by name, from Python's own libraries."""
    return "CASE n_name " + " ".join(f"WHEN '{n}' THEN {f(n.encode())!r}" for n in _NATIONS) + " END"


def _mac(name: bytes) -> str:
    return hmac.new(b"key", name, "sha1").hexdigest().upper()


def _derived(name: bytes) -> str:
    return hashlib.pbkdf2_hmac("sha1", name, b"salt", 1000, 32).hex().upper()


query("xxh_documents", "documents")(lambda df: df.select("doc_id", C.xxh32(F.col("text")).alias("xxh32"), C.xxh64(F.col("text")).alias("xxh64"), C.xxh64_low(F.col("text")).alias("xxh64_low")))
query("xxh_nations", "nation", f"SELECT n_nationkey, {_vectors(lambda b: xxhash.xxh32_intdigest(b))}::BIGINT AS xxh32, {_vectors(lambda b: xxhash.xxh64_hexdigest(b))} AS xxh64 FROM nation")(lambda df: df.select("n_nationkey", C.xxh32(F.col("n_name")).alias("xxh32"), C.xxh64(F.col("n_name")).alias("xxh64")))
query("hmac_pbkdf2", "nation", f"SELECT n_nationkey, {_vectors(_mac)} AS mac FROM nation")(lambda df: df.select("n_nationkey", F.hex(C.hmac_sha1(F.col("n_name"), b"key")).alias("mac")))
query("pbkdf2_nations", "nation", f"SELECT n_nationkey, {_vectors(_derived)} AS derived FROM nation")(lambda df: df.select("n_nationkey", F.hex(C.pbkdf2_sha1(F.col("n_name"), b"salt")).alias("derived")))

# ---- names and paths ----

query("glob_filter", "pages", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://.*/en/.*$') AND NOT regexp_matches(url, '^.*[?]page=.$')")(lambda df: df.select("page_id", "url").filter(P.matches_filters(F.col("url"), ["http*://*/en/*", "[bad"], ["*[?]page=?"])))
query("file_list", "pages", "SELECT page_id FROM pages WHERE split_part(url, '/', 4) IN ('en', 'de') AND (split_part(url, '/', 4) || '/' || split_part(url, '/', 5)) LIKE 'en/%'")(
    lambda df: df.select("page_id", F.concat_ws("/", F.element_at(F.split("url", "/"), 4), F.coalesce(F.try_element_at(F.split("url", "/"), F.lit(5)), F.lit(""))).alias("name")).filter(P.in_file_list(F.col("name"), ["en"]) & (F.col("name") != "en")).select("page_id")
)
_PATH = "CASE page_id % 4 WHEN 0 THEN '/' || url WHEN 1 THEN '../' || url || '/./x' WHEN 2 THEN url || '/..' ELSE url END"


def _path() -> Column:
    return F.expr(_PATH)


query("path_sanitise", "pages", f"SELECT page_id, array_to_string(list_filter(string_split({_PATH}, '/'), lambda p: p NOT IN ('', '.', '..')), '/') AS safe, NOT regexp_matches({_PATH}, '^/|(^|/)\\.\\.(/|$)') AS is_safe FROM pages")(lambda df: df.select("page_id", P.sanitise_path(_path()).alias("safe"), P.is_safe_path(_path()).alias("is_safe")))
_NAME = "CASE p_partkey % 6 WHEN 0 THEN 'con.txt' WHEN 1 THEN 'COM' || (p_partkey % 12)::VARCHAR WHEN 2 THEN 'nul' WHEN 3 THEN 'LPT1.tar.gz' ELSE p_name END"


def _name() -> Column:
    return F.expr(_NAME.replace("::VARCHAR", "").replace("(p_partkey % 12)", "cast(p_partkey % 12 as string)"))


query("reserved_names", "part", f"SELECT p_partkey, CASE WHEN regexp_matches(split_part({_NAME}, '.', 1), '(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN split_part({_NAME}, '.', 1) || '_' || substr({_NAME}, strlen(split_part({_NAME}, '.', 1)) + 1) ELSE {_NAME} END AS name FROM part")(lambda df: df.select("p_partkey", P.rewrite_reserved(_name()).alias("name")))
query("reserved_paths", "part", f"SELECT p_partkey, 'aux_/' || CASE WHEN regexp_matches(split_part({_NAME}, '.', 1), '(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN split_part({_NAME}, '.', 1) || '_' || substr({_NAME}, strlen(split_part({_NAME}, '.', 1)) + 1) ELSE {_NAME} END || '/' AS path FROM part")(lambda df: df.select("p_partkey", P.rewrite_path(F.concat(F.lit("aux/"), _name(), F.lit("/"))).alias("path")))
query("parse_size", "part", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT * 1000 WHEN 1 THEN p_size::BIGINT * 1000000 WHEN 2 THEN p_size::BIGINT END AS bytes FROM part")(
    lambda df: df.select("p_partkey", P.parse_size(F.concat(F.col("p_size").cast("string"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'k' WHEN 1 THEN 'M' WHEN 2 THEN '' ELSE 'x' END"))).alias("bytes"))
)
query("format_size", "orders", "SELECT o_orderkey, CASE WHEN s >= 1073741824 THEN printf('%.1f GB', s / 1073741824.0) WHEN s >= 1048576 THEN printf('%.1f MB', s / 1048576.0) WHEN s >= 1024 THEN printf('%.1f KB', s / 1024.0) ELSE s || ' B' END AS size FROM (SELECT o_orderkey, o_orderkey * o_custkey AS s FROM orders)")(lambda df: df.select("o_orderkey", P.format_size(F.col("o_orderkey") * F.col("o_custkey")).alias("size")))

# ---- entries ----

query("entry_ratios", "lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE ELSE l_quantity::BIGINT::DOUBLE / (l_linenumber - 1) END AS ratio, CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE ELSE (1.0::DOUBLE - l_quantity::BIGINT::DOUBLE / (l_linenumber - 1)) * 100.0::DOUBLE END AS savings FROM lineitem")(
    lambda df: df.select("l_orderkey", "l_linenumber", E.compression_ratio(F.col("l_linenumber").cast("bigint") - 1, F.col("l_quantity").cast("bigint")).alias("ratio"), E.space_savings(F.col("l_linenumber").cast("bigint") - 1, F.col("l_quantity").cast("bigint")).alias("savings"))
)
query("entry_attributes", "part", "SELECT p_partkey, coalesce((d & 1) <> 0, (p_partkey & 146) = 0, false) AS readonly, coalesce((d & 2) <> 0, false) AS hidden, coalesce((d & 4) <> 0, false) AS system FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size END AS d FROM part)")(
    lambda df: df.select("p_partkey", F.expr("CASE WHEN p_size % 3 <> 0 THEN p_size END").alias("d")).select("p_partkey", E.is_readonly(F.col("d"), F.col("p_partkey")).alias("readonly"), E.is_hidden(F.col("d")).alias("hidden"), E.is_system(F.col("d")).alias("system"))
)
query("entry_types", "part", "SELECT p_partkey, p_size % 4 = 0 AS is_file, p_size % 4 = 1 AS is_dir, p_size % 4 = 2 AS is_symlink, p_size % 3 = 0 AS is_stored, CASE p_size WHEN 8 THEN 'Deflate' WHEN 12 THEN 'Bzip2' WHEN 14 THEN 'LZMA' WHEN 0 THEN 'Stored' WHEN 93 THEN 'Zstd' ELSE 'Unknown' END AS method FROM part")(
    lambda df: df.withColumn("t", F.expr("element_at(array('File', 'Directory', 'Symlink', 'Hardlink'), p_size % 4 + 1)")).withColumn("m", F.expr("element_at(array('lh0', 'Deflate', 'lh5'), p_size % 3 + 1)")).select("p_partkey", E.is_file(F.col("t")).alias("is_file"), E.is_dir(F.col("t")).alias("is_dir"), E.is_symlink(F.col("t")).alias("is_symlink"), E.is_stored(F.col("m")).alias("is_stored"), E.method_name(F.col("p_size")).alias("method"))
)
query("store_threshold", "documents", "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN 'Stored' ELSE 'Deflate' END AS method FROM documents")(lambda df: df.select("doc_id", E.storage_choice(F.octet_length("text"), 1024).alias("method")))
query("memory_limit", "documents", "SELECT doc_id, strlen(text) AS size FROM documents")(lambda df: df.select("doc_id", E.within_limit(F.octet_length("text").cast("bigint"), 1 << 30, F.col("doc_id").cast("string")).alias("size")))
query("ratio_sort", "lineitem", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity > 25 THEN l_discount / l_quantity ELSE 0.0 END DESC, l_linenumber DESC) AS position FROM lineitem")(
    lambda df: df.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.when(F.col("l_quantity") > 25, F.col("l_discount") / F.col("l_quantity")).otherwise(0.0).desc(), F.col("l_linenumber").desc())).cast("bigint").alias("position"))
)
query("detect_magic", "part", "SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'ZIP' WHEN 1 THEN 'GZIP' WHEN 2 THEN '7-Zip' WHEN 3 THEN 'XZ' WHEN 4 THEN 'Bzip2' WHEN 5 THEN 'Zstandard' WHEN 6 THEN 'LZ4' WHEN 7 THEN 'LZH' WHEN 8 THEN 'CAB' ELSE 'Unknown' END AS format, CASE p_partkey % 10 WHEN 0 THEN 'zip' WHEN 1 THEN 'gz' WHEN 2 THEN '7z' WHEN 3 THEN 'xz' WHEN 4 THEN 'bz2' WHEN 5 THEN 'zst' WHEN 6 THEN 'lz4' WHEN 7 THEN 'lzh' WHEN 8 THEN 'cab' ELSE '' END AS extension, p_partkey % 10 IN (0, 2, 7, 8) AS is_archive, p_partkey % 10 IN (1, 3, 4, 5, 6) AS is_stream FROM part")(
    lambda df: df.select("p_partkey", D.detect(F.concat(F.unhex(F.expr("element_at(array('504B0304', '1F8B0800', '377ABCAF271C', 'FD377A585A00', '425A6839', '28B52FFD', '04224D18', '20202D6C68352D', '4D534346', '0000'), cast(p_partkey % 10 as int) + 1)")), F.col("p_name").cast("binary"))).alias("format")).select("p_partkey", "format", D.extension(F.col("format")).alias("extension"), D.is_archive(F.col("format")).alias("is_archive"), D.is_compression_only(F.col("format")).alias("is_stream"))
)
query("format_mime", "nation", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'application/zstd' ELSE 'application/octet-stream' END AS mime FROM nation")(lambda df: df.select("n_nationkey", D.mime_type(F.expr("element_at(array('ZIP', 'Zstandard', 'none'), cast(n_nationkey % 3 as int) + 1)")).alias("mime")))

# ---- times and numbers ----

query("dos_time_round_trip", "orders", "SELECT o_orderkey, make_timestamp((epoch_us(o_orderdate) // 2000000) * 2000000) AS stamp FROM orders")(lambda df: df.select("o_orderkey", T.dos_timestamp(T.to_dos_date(F.col("o_orderdate")), T.to_dos_time(F.col("o_orderdate"))).alias("stamp")))
query("dos_time_approximate", "orders", "SELECT o_orderkey, (((year(o_orderdate) - 1970) * 365 + (year(o_orderdate) - 1969) // 4 + (month(o_orderdate) - 1) * 30 + day(o_orderdate)) * 86400 + hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + (second(o_orderdate) // 2) * 2)::BIGINT AS seconds FROM orders")(lambda df: df.select("o_orderkey", T.dos_time_ref(T.to_dos_date(F.col("o_orderdate")), T.to_dos_time(F.col("o_orderdate"))).alias("seconds")))
query("filetime_round_trip", "events", "SELECT event_id, epoch_us(ts) * 10 + 116444736000000000 AS ticks, ts AS stamp FROM events")(lambda df: df.select("event_id", T.to_filetime(F.col("ts")).alias("ticks")).select("event_id", "ticks", T.filetime(F.col("ticks")).alias("stamp")))
query("octal_numbers", "orders", "SELECT o_orderkey, o_custkey AS value FROM orders")(lambda df: df.select("o_orderkey", T.octal(F.concat(F.lit("00"), F.conv(F.col("o_custkey").cast("string"), 10, 8), F.lit(" \0"))).alias("value")))
query("ucs2_names", "nation", "SELECT n_nationkey, n_name AS name FROM nation")(lambda df: df.select("n_nationkey", T.ucs2_be(F.encode("n_name", "UTF-16BE")).alias("name")))
query("leb128_numbers", "orders", "SELECT o_orderkey, o_orderkey AS value FROM orders")(
    lambda df: df.select("o_orderkey", T.leb128(F.unhex(F.concat(*[F.when((F.shiftrightunsigned("o_orderkey", 7 * i) > 0) | F.lit(i == 0), F.lpad(F.hex(F.shiftrightunsigned("o_orderkey", 7 * i).bitwiseAND(F.lit(127)) + F.when(F.shiftrightunsigned("o_orderkey", 7 * (i + 1)) > 0, 128).otherwise(0)), 2, "0")).otherwise("") for i in range(5)]))).alias("value"))
)
query("sevenzip_numbers", "orders", "SELECT o_orderkey, o_orderkey AS value FROM orders")(
    lambda df: df.select("o_orderkey", T.sevenzip_number(F.unhex(F.concat(F.lit("F0"), *[F.lpad(F.hex(F.shiftrightunsigned("o_orderkey", 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]))).alias("value"))
)

# ---- bits and tables ----

query("reverse_bits", "part", "SELECT p_partkey, list_sum(list_transform(range(0, 16), lambda i: ((p_partkey >> i) & 1) << (15 - i)))::BIGINT AS reversed FROM part")(lambda df: df.select("p_partkey", B.reverse_bits(F.col("p_partkey"), 16).alias("reversed")))
query("sigma_map", "events", "SELECT event_id, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS sigma, d AS delta FROM (SELECT event_id, (floor(value * 100)::BIGINT - 5000) AS d FROM events)")(lambda df: df.select("event_id", (F.floor(F.col("value") * 100).cast("bigint") - 5000).alias("d")).select("event_id", B.sigma_map(F.col("d")).alias("sigma")).select("event_id", "sigma", B.inverse_sigma(F.col("sigma")).alias("delta")))
query("szip_sigma_lag", "events", "SELECT user_id, event_id, CASE WHEN p IS NULL THEN v WHEN v >= p THEN 2 * (v - p) ELSE -2 * (v - p) - 1 END AS mapped FROM (SELECT user_id, event_id, floor(abs(value) * 100)::BIGINT AS v, lag(floor(abs(value) * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")(
    lambda df: df.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.floor(F.abs("value") * 100).cast("bigint").alias("v")))).alias("s")).select("user_id", F.posexplode(B.nearest_neighbour(F.transform("s", lambda x: x["v"]))).alias("i", "mapped"), "s").select("user_id", F.element_at("s", F.col("i") + 1)["event_id"].alias("event_id"), "mapped")
)
_SAMPLES = "SELECT user_id, array_to_string(list(floor(abs(value) * 100)::BIGINT % 65536 ORDER BY ts, event_id), ',') AS samples FROM events GROUP BY user_id"


def _samples(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.floor(F.abs("value") * 100).cast("bigint") % 65536).alias("v")))).alias("s")).select("user_id", F.transform("s", lambda x: x["v"]).alias("v"))


for _nn in (True, False):
    query(f"szip_{'predicted' if _nn else 'plain'}", "events", _SAMPLES)(lambda df, p=szip.Params(16, 16, 8, _nn): _samples(df).select("user_id", F.array_join(C.szip_decode(C.szip_encode(F.col("v"), p), p), ",").alias("samples")))
query("sample_bytes", "events", _SAMPLES)(lambda df: _samples(df).select("user_id", F.array_join(B.bytes_to_samples(B.samples_to_bytes(F.col("v"), 2), 2), ",").alias("samples")))
query("nearest_neighbour_inverse", "events", _SAMPLES)(lambda df: _samples(df).select("user_id", F.array_join(B.inverse_nearest_neighbour(B.nearest_neighbour(F.col("v")), 65535), ",").alias("samples")))
query("lz_codes", "part", "SELECT p_partkey, CASE WHEN n = 258 THEN 285 WHEN n < 11 THEN 254 + n ELSE 261 + 4 * (floor(log2(n - 3))::INT - 2) + ((n - 3) >> (floor(log2(n - 3))::INT - 2)) - 4 END::BIGINT AS length_symbol, CASE WHEN p_partkey < 4 THEN p_partkey ELSE 2 * (floor(log2(p_partkey))::INT - 1) + (p_partkey >> (floor(log2(p_partkey))::INT - 1)) END::BIGINT AS distance_symbol FROM (SELECT p_partkey, (3 + p_partkey % 256)::BIGINT AS n FROM part)")(
    lambda df: df.select("p_partkey", B.lz_length_code(3 + F.col("p_partkey") % 256)["symbol"].cast("bigint").alias("length_symbol"), B.lz_distance_code(F.col("p_partkey") + 1, most=None)["symbol"].cast("bigint").alias("distance_symbol"))
)
query("level_tables", "nation", "SELECT n_nationkey, [0, 4, 8, 16, 32, 64, 128, 256, 1024, 4096][least(n_nationkey, 9) + 1]::BIGINT AS deflate_chain, [17, 17, 17, 18, 18, 18, 19, 19, 19, 20, 20, 20][least(greatest(n_nationkey, 1), 12)]::BIGINT AS zstd_hash_log, CASE WHEN n_nationkey = 0 THEN 65536 ELSE 1 << (17 + least(n_nationkey, 9)) END::BIGINT AS lzma_dictionary, CASE WHEN n_nationkey >= 40 THEN 4294967295 ELSE (2 + n_nationkey % 2)::BIGINT << (n_nationkey // 2 + 11) END::BIGINT AS lzma2_dictionary FROM nation")(
    lambda df: df.select("n_nationkey", B.deflate_params(F.col("n_nationkey"))["max_chain"].cast("bigint").alias("deflate_chain"), B.zstd_params(F.col("n_nationkey"))["hash_log"].cast("bigint").alias("zstd_hash_log"), B.lzma_dictionary(F.col("n_nationkey")).cast("bigint").alias("lzma_dictionary"), B.lzma2_dictionary(F.col("n_nationkey")).alias("lzma2_dictionary"))
)
query("codec_parameters", "part", "SELECT p_partkey, p_size % 9 AS lc, (p_size // 9) % 5 AS lp, p_size // 45 AS pb, CASE WHEN b IN (1, 2) THEN 'uncompressed' WHEN b >= 128 THEN 'lzma' ELSE 'end' END AS chunk, CASE WHEN b = 1 THEN true WHEN b >= 128 THEN b >= 224 ELSE false END AS reset_dict, b BETWEEN 0 AND 11 AS valid_quality, CASE WHEN p_size <= 2 THEN 1 WHEN p_size <= 4 THEN 2 WHEN p_size <= 8 THEN 3 WHEN p_size <= 16 THEN 4 ELSE 5 END AS id_bits FROM (SELECT p_partkey, p_size, p_partkey % 256 AS b FROM part)")(
    lambda df: df.withColumn("b", F.col("p_partkey") % 256).select("p_partkey", B.lzma_props(F.col("p_size"))["lc"].alias("lc"), B.lzma_props(F.col("p_size"))["lp"].alias("lp"), B.lzma_props(F.col("p_size"))["pb"].alias("pb"), B.lzma2_chunk(F.col("b"))["kind"].alias("chunk"), B.lzma2_chunk(F.col("b"))["reset_dict"].alias("reset_dict"), B.brotli_params_valid(F.col("b"), F.lit(22), F.lit(0)).alias("valid_quality"), B.id_length(F.col("p_size")).alias("id_bits"))
)
query("snappy_bounds", "documents", "SELECT doc_id, (CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END + 32 + n + n // 6)::BIGINT AS bound, n AS stated FROM (SELECT doc_id, strlen(text) AS n FROM documents)")(lambda df: df.select("doc_id", B.snappy_bound(F.octet_length("text").cast("bigint")).cast("bigint").alias("bound"), C.compress(F.col("text"), "snappy_raw").alias("c")).select("doc_id", "bound", B.snappy_length(F.col("c")).alias("stated")))
query("lz4_flags", "part", "SELECT p_partkey, (64 + 32 * (p_size & 1) + 16 * ((p_size >> 1) & 1) + 8 * ((p_size >> 2) & 1) + 4 * ((p_size >> 3) & 1) + ((p_size >> 4) & 1))::BIGINT AS flags FROM part")(lambda df: df.select("p_partkey", B.lz4_flags(*[F.shiftright("p_size", i).bitwiseAND(F.lit(1)) == 1 for i in range(5)]).cast("bigint").alias("flags")))
query("brotli_contexts", "part", "SELECT p_partkey, p_partkey % 256 & 63 AS lsb6, p_partkey % 256 >> 2 AS msb6, (CASE WHEN a = 0 THEN 0 WHEN a < 16 THEN 1 WHEN a < 64 THEN 2 WHEN a < 128 THEN 3 WHEN a < 192 THEN 4 WHEN a < 240 THEN 5 WHEN a < 255 THEN 6 ELSE 7 END * 8 + CASE WHEN p_size = 0 THEN 0 WHEN p_size < 16 THEN 1 WHEN p_size < 64 THEN 2 ELSE 3 END)::BIGINT AS signed FROM (SELECT p_partkey, p_partkey % 256 AS a, p_size FROM part)")(
    lambda df: df.withColumn("a", F.col("p_partkey") % 256).select("p_partkey", B.brotli_context("lsb6", F.col("a"), F.col("p_size")).alias("lsb6"), B.brotli_context("msb6", F.col("a"), F.col("p_size")).cast("bigint").alias("msb6"), B.brotli_context("signed", F.col("a"), F.col("p_size")).cast("bigint").alias("signed"))
)
query("stream_headers", "documents", "SELECT doc_id, strlen(text) AS zstd_size, 9::BIGINT AS bzip2_level, CASE WHEN doc_id % 2 = 0 THEN (doc_id + 5) % 4294967296 END AS dict_id FROM documents")(
    lambda df: df.select("doc_id", F.coalesce(B.zstd_content_size(C.compress(F.col("text"), "zstd")), F.octet_length("text").cast("bigint")).alias("zstd_size"), B.bzip2_level(C.compress(F.col("text"), "bzip2")).alias("bzip2_level"), B.lz4_frame_dict_id(F.concat(F.unhex(F.concat(F.lit("04224D18"), F.when(F.col("doc_id") % 2 == 0, "61").otherwise("60"), F.lit("40"), *[F.lpad(F.hex(F.shiftrightunsigned(F.col("doc_id") + 5, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)])))).alias("dict_id"))
)
query("skippable_frames", "nation", "SELECT n_nationkey, '532A4D18' || printf('%02X', strlen(n_name)::INT) || '000000' || hex(n_name) AS frame FROM nation")(lambda df: df.select("n_nationkey", F.hex(B.skippable_frame(F.col("n_name").cast("binary"), 3)).alias("frame")))
query("sequence_modes", "lineitem", "SELECT l_orderkey, CASE WHEN d = 1 THEN 'rle' WHEN t < 16 AND d <= 4 THEN 'predefined' ELSE 'fse' END AS mode FROM (SELECT l_orderkey, count(DISTINCT l_quantity) AS d, count(*) AS t FROM lineitem GROUP BY l_orderkey)")(lambda df: df.groupBy("l_orderkey").agg(F.count_distinct("l_quantity").alias("d"), F.count(F.lit(1)).alias("t")).select("l_orderkey", B.sequence_mode(F.col("d"), F.col("t")).alias("mode")))
query("run_blocks", "lineitem", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN ascii(min(l_returnflag)) END::BIGINT AS run FROM lineitem GROUP BY l_orderkey")(lambda df: df.groupBy("l_orderkey").agg(F.array_join(F.collect_list("l_returnflag"), "").alias("s")).select("l_orderkey", B.is_run(F.col("s").cast("binary")).alias("run")))
query("sparse_maps", "orders", "SELECT o_orderkey, 2::BIGINT AS runs, o_custkey > 0 AS valid, false AS overlapping FROM orders")(
    lambda df: df.select("o_orderkey", B.sparse_runs(F.concat_ws(",", F.lit("0"), F.col("o_custkey").cast("string"), (F.col("o_custkey") * 2).cast("string"), F.lit("5"))).alias("r")).select("o_orderkey", F.size("r").cast("bigint").alias("runs"), B.sparse_valid(F.col("r"), F.lit(1 << 40)).alias("valid"), B.sparse_valid(F.concat("r", "r"), F.lit(1 << 40)).alias("overlapping"))
)
query("lzh_methods", "nation", "SELECT n_nationkey, [4096, 8192, 32768, 65536][n_nationkey % 4 + 1]::BIGINT AS window_size, [12, 13, 15, 16][n_nationkey % 4 + 1]::BIGINT AS position_bits FROM nation")(lambda df: df.select("n_nationkey", B.lzh_method(F.expr("element_at(array('-lh4-', '-lh5-', '-lh6-', '-lh7-'), cast(n_nationkey % 4 as int) + 1)")).alias("m")).select("n_nationkey", F.col("m.window").cast("bigint").alias("window_size"), F.col("m.position_bits").cast("bigint").alias("position_bits")))
query("memory_budget", "nation", "SELECT n_nationkey, (CASE WHEN n_nationkey = 0 THEN 65536 ELSE 1 << (17 + least(n_nationkey, 9)) END + 1000 + 1048576)::BIGINT AS need FROM nation")(lambda df: df.select("n_nationkey", B.check_budget(B.lzma_memory(F.col("n_nationkey"), F.lit(1000)), 1 << 30).alias("need")))
query("bwt_expression", "nation", "SELECT n_nationkey, list_reduce(list_transform(list_sort(list_transform(range(1, strlen(n_name) + 1), lambda i: substr(n_name, i) || substr(n_name, 1, i - 1))), lambda r: substr(r, strlen(r), 1)), lambda a, b: a || b) AS last_column FROM nation")(lambda df: df.select("n_nationkey", F.substring(C.bwt(F.col("n_name")), 5, 1 << 20).cast("string").alias("last_column")))

# ---- aggregates ----

query("byte_histogram", "documents", "SELECT lang, byte, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)) AS byte FROM (SELECT lang, text, hex(text) AS h FROM documents)) GROUP BY lang, byte")(lambda df: training.histogram(df, "text", "lang"))
query("code_lengths", "documents", "SELECT lang, 1.0::DOUBLE AS kraft, true AS limited FROM documents GROUP BY lang")(lambda df: training.code_lengths(training.histogram(df, "text", "lang"), "lang", limit=12).groupBy("lang").agg(F.sum(F.pow(F.lit(2.0), -F.col("bits"))).alias("kraft"), (F.max("bits") <= 12).alias("limited")))


def _canonical(df: DataFrame) -> DataFrame:
    codes = training.canonical_codes(training.code_lengths(training.histogram(df, "text", "lang"), "lang"), "lang")
    return codes.groupBy("lang").agg(F.count(F.lit(1)).alias("n_symbols"), F.count_distinct(F.struct("bits", "code")).alias("n_codes"))


query("canonical_codes", "documents", "SELECT lang, count(DISTINCT byte) AS n_symbols, count(DISTINCT byte) AS n_codes FROM (SELECT lang, unnest(list_transform(range(1, strlen(text) + 1), lambda i: substr(h, 2 * i - 1, 2))) AS byte FROM (SELECT lang, text, hex(text) AS h FROM documents)) GROUP BY lang")(_canonical)
query("table_shares", "documents", "SELECT lang, 512::BIGINT AS cells FROM documents GROUP BY lang")(lambda df: training.table_shares(training.histogram(df, "text", "lang"), "lang").groupBy("lang").agg(F.sum("share").alias("cells")))
query("brotli_transforms", "nation", "SELECT n_nationkey, ' ' || upper(substr(n_name, 1, 1)) || substr(n_name, 2) || ', ' AS first, upper(n_name) AS every, substr(n_name, 3) AS later, substr(n_name, 1, length(n_name) - 2) AS earlier FROM nation")(
    lambda df: df.select("n_nationkey", C.brotli_transform(F.col("n_name"), " ", "first_upper", suffix=", ").alias("first"), C.brotli_transform(F.col("n_name"), kind="all_upper").alias("every"), C.brotli_transform(F.col("n_name"), kind="omit_first", n=2).alias("later"), C.brotli_transform(F.col("n_name"), kind="omit_last", n=2).alias("earlier"))
)
query("coded_size", "documents")(lambda df: training.coded_size(training.histogram(df, "text", "lang"), training.code_lengths(training.histogram(df, "text", "lang"), "lang"), "lang"))
query("fixed_size", "documents", "SELECT lang, sum(CASE WHEN byte <= 143 THEN 8 ELSE 9 END)::BIGINT AS bits FROM (SELECT lang, unnest(list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)) AS byte FROM (SELECT lang, text, hex(text) AS h FROM documents)) GROUP BY lang")(lambda df: training.histogram(df, "text", "lang").groupBy("lang").agg(F.sum(training.fixed_length(F.col("byte")) * F.col("n")).cast("bigint").alias("bits")))
query("ngram_counts", "part", "WITH g AS (SELECT substr(p_name, i, k) AS ngram, k AS length FROM (SELECT p_name, unnest(range(4, least(16, length(p_name)) + 1)) AS k FROM part WHERE length(p_name) >= 4), LATERAL (SELECT unnest(range(1, length(p_name) - k + 2)) AS i)) SELECT ngram, length, count(*) AS n, count(*) * length AS score FROM g GROUP BY ngram, length HAVING count(*) >= 2")(
    lambda df: training.ngrams(df, F.col("p_name")).select("ngram", F.col("length").cast("bigint").alias("length"), "n", F.col("score").cast("bigint").alias("score"))
)
query("rle_runs", "lineitem", "SELECT l_orderkey, l_returnflag, count(*) AS run, min(l_linenumber) AS first FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS g FROM lineitem) GROUP BY l_orderkey, l_returnflag, g")(
    lambda df: _runs(df.select("l_orderkey", "l_returnflag", *_LINE)).groupBy("l_orderkey", "l_returnflag", "g").agg(F.count(F.lit(1)).alias("run"), F.min("l_linenumber").alias("first")).drop("g")
)
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _runs(df: DataFrame) -> DataFrame:
    """df with g, the number of the run of equal flags: one window, whose partitioning serves the grouping."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    new = F.coalesce((F.lag("l_returnflag").over(w) != F.col("l_returnflag")).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


query("totals_rollup", "documents", "SELECT lang, source, count(*) AS files, sum(strlen(text))::BIGINT AS size FROM documents GROUP BY ROLLUP (lang, source)")(lambda df: df.rollup("lang", "source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("size")))


def _chunk(codec: str, size: int) -> None:
    def run(df: DataFrame) -> DataFrame:
        packed = training.compress_chunked(df.select(F.col("doc_id").alias("id"), "text"), "text", codec, size=size)
        return packed.select(F.col("id").alias("doc_id"), F.sha2(C.decompress(F.col("text"), codec), 256).alias("digest"))

    query(f"parallel_{codec}", "documents", "SELECT doc_id, sha256(text) AS digest FROM documents")(run)


for _codec in ("gzip", "deflate", "bzip2", "lz4", "zstd", "xz", "snappy", "lzma2"):
    _chunk(_codec, 4096)
query("parallel_brotli", "documents", "SELECT doc_id, sha256(text) AS digest FROM documents")(lambda df: training.unframe_table(training.frame_table(df, "text", "doc_id", 4096), "text", "doc_id").select("doc_id", F.sha2("text", 256).alias("digest")))
query("gzip_multi_member", "conversations", "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")(
    lambda df: df.select("conv_id", "turn", C.compress(F.col("text"), "gzip").alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("s")).select("conv_id", F.sha2(C.decompress(training.join_bytes(F.col("s.m")), "gzip"), 256).alias("digest"))
)


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = training.train_dictionary(table(spark, sf_dir, "part"), F.col("p_name"), 1024)
    return spark.createDataFrame([(len(made), bytearray(made))], "size bigint, dictionary binary")


QUERIES["train_dictionary"] = _dictionary
