"""Queries whose archives take several volumes, and keys beyond those of the small tables, against their SQL."""

import duckdb
import pytest
from test_queries import TABLES, norm

from quarry.plans import archives, catalog


@pytest.fixture
def small_volumes(monkeypatch):
    whole = archives.A.pack
    monkeypatch.setattr(archives.A, "pack", lambda *a, **k: whole(*a, **{**k, "most": 20_000}))


def wanted(name, sf_dir, **tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tables.get(t, f'{sf_dir}/{t}.parquet')}')")
    return con.execute(catalog.ORACLE_SQL[name]).df()


@pytest.mark.parametrize("name", ["corrupt_archives", "detect_archives", "lenient_tar"])
def test_one_row_an_archive(name, spark, sf_dir, small_volumes):
    assert norm(catalog.QUERIES[name](spark, sf_dir).toPandas()) == norm(wanted(name, sf_dir))


def test_listing_ties_across_volumes(spark, sf_dir, tmp_path, small_volumes):
    # many files of one size: their order is the archive's, not that of a volume
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "repeat('x', cast(doc_id % 3 as int) * 500 + 900) text", "lang", "'src1' source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["listing_sorted"](spark, str(tmp_path)).toPandas()
    assert norm(got) == norm(wanted("listing_sorted", sf_dir, documents=f"{tmp_path}/documents.parquet/*.parquet"))


def test_distance_codes_of_large_keys(spark, sf_dir, tmp_path):
    keys = sorted({k for b in range(1, 47) for k in ((1 << b) - 1, 1 << b, (1 << b) + 1)} | {0, 98_304})
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["lz_codes"](spark, str(tmp_path)).toPandas()
    assert norm(got) == norm(wanted("lz_codes", sf_dir, part=f"{tmp_path}/part.parquet/*.parquet"))


def test_turns_are_dealt_to_many_volumes(spark, sf_dir):
    # three archives of one volume each would be three tasks, whatever the input's size
    size = sum(len(r["text"].encode()) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    copies = max(1, (2 << 20) // size + 1)
    rows = archives.turns(spark, sf_dir).crossJoin(spark.range(copies)).selectExpr("archive", "concat(id, '/', name) name", "content", "entry_index")
    seen = []
    try:
        whole, archives.turns = archives.turns, lambda *_: rows
        seen = archives.packed_turns(spark, sf_dir, "zip").groupBy("archive").count().collect()
    finally:
        archives.turns = whole
    assert max(r["count"] for r in seen) > 4


def test_codec_batches_end_by_bytes(spark):
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    from quarry.functions import codecs

    @arrow_udf("int")
    def held(v: pa.Array) -> pa.Array:
        return pa.array([len(v)] * len(v), pa.int32())

    codecs.bound_batches(spark)
    rows = spark.range(40, numPartitions=1).selectExpr("repeat('x', 1000000) text")
    assert max(r[0] for r in rows.select(held("text")).collect()) <= 6


def test_damaged_folders_in_bounded_cabinets(spark, sf_dir, tmp_path, monkeypatch):
    from quarry.plans import foreign

    # one source with more text than a cabinet takes; every cabinet of it is cut
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).selectExpr("doc_id", "repeat(sha2(text, 256), 2000) text", "lang", "'src1' source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes, whole = [], foreign.A.scan

    def seen(made, **options):
        sizes.extend(r[0] for r in made.selectExpr("octet_length(content)").collect())
        return whole(made, **options)

    big = foreign.cabinet
    monkeypatch.setattr(foreign, "cabinet", lambda files: big(files, False))
    monkeypatch.setattr(foreign.A, "scan", seen)
    got = catalog.QUERIES["damaged_folders"](spark, str(tmp_path)).toPandas()
    assert norm(got) == norm(wanted("damaged_folders", sf_dir, documents=f"{tmp_path}/documents.parquet/*.parquet"))
    assert len(sizes) > 1 and max(sizes) < 5 << 20
