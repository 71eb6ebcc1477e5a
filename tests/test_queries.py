"""Every registered query against DuckDB on the small tables; sources, sinks and streams."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.codecs import registry
from quarry.operators import archives as A
from quarry.plans import catalog
from quarry.sources import archive as source
from quarry.streaming import codecs as streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(df):
    import pandas as pd

    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind in "mM":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = [None if v is None or v is pd.NA or v != v else v if isinstance(v, bool | str) else round(float(v), 9) if hasattr(v, "__float__") else str(v) for v in df[c]]
    return sorted(map(str, df.values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    wanted = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns) and norm(got) == norm(wanted)


def test_source_and_sinks(spark, tmp_path):
    source.register(spark)
    rows = spark.createDataFrame([(f"d/{i}.txt", bytearray(b"x" * i)) for i in range(20)], "name string, content binary")
    rows.repartition(2).write.format("archive").option("path", str(tmp_path / "a")).option("format", "zip").mode("append").save()
    back = spark.read.format("archive").option("content", "true").load(str(tmp_path / "a"))
    assert back.count() == 20 and back.filter("name = 'd/7.txt'").first()["size"] == 7 and back.filter("name like 'd/1%'").count() == 11
    back.select(F.col("name").alias("path"), "content").write.format("files").option("path", str(tmp_path / "out")).mode("append").save()
    assert sorted(os.listdir(tmp_path / "out" / "d"))[0] == "0.txt" and (tmp_path / "out" / "d" / "9.txt").read_bytes() == b"x" * 9
    assert A.read(spark, str(tmp_path / "a"), verify=True).filter("status = 'OK'").count() == 20
    picked = spark.read.format("archive").option("content", "true").option("names", "d/3.txt\nd/4.txt").load(str(tmp_path / "a"))
    assert sorted(r["content"] for r in picked.collect()) == [b"xxx", b"xxxx"]
    pushed = lambda: spark.read.format("archive").option("pushdown", "true").load(str(tmp_path / "a"))
    assert [r["name"] for r in pushed().filter("name = 'd/7.txt'").collect()] == ["d/7.txt"] and pushed().filter("name like 'd/1%'").count() == 11
    query = spark.readStream.format("archive").load(str(tmp_path / "a")).writeStream.format("memory").queryName("archive_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("archive_stream").count() == 20


@pytest.mark.parametrize("codec", ["gzip", "zlib", "deflate", "zstd", "lz4", "bzip2", "xz", "snappy"])
def test_stream_codecs(codec, spark, tmp_path):
    pieces = [os.urandom(50) * 30, b"abc" * 100, b"end"]
    schema = "key string, seq bigint, data binary, last boolean"

    def play(path, parts, f, name):
        for i, p in enumerate(parts):
            spark.createDataFrame([("k", i, bytearray(p), i == len(parts) - 1)], schema).coalesce(1).write.mode("append").parquet(path)
        q = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), codec).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return b"".join(bytes(r["data"]) for r in spark.table(name).orderBy("seq").collect())

    packed = play(str(tmp_path / "p"), pieces, streams.compress_stream, f"packed_{codec}")
    assert registry.decompress(codec, packed) == b"".join(pieces)
    cuts = [packed[:100], packed[100:900], packed[900:]]
    assert play(str(tmp_path / "q"), cuts, streams.decompress_stream, f"plain_{codec}") == b"".join(pieces)


def test_stream_budget():
    with pytest.raises(streams.BudgetExceeded):
        streams.decompress_step(None, registry.compress("gzip", os.urandom(5000))[:4000], "gzip", budget=1000)


def test_empty_and_null_blobs(spark):
    blobs = spark.createDataFrame([("a", None), ("b", bytearray())], "archive string, content binary")
    assert [(r["archive"], r["status"]) for r in A.scan(blobs).collect()] == [("b", "CORRUPT")]
    assert A.scan(blobs.limit(0)).count() == 0 and A.repair(blobs).count() == 0


def test_convert_errors(spark):
    bad = spark.createDataFrame([("a", bytearray(b"PK\3\4broken"))], "archive string, content binary")
    with pytest.raises(Exception, match="cannot convert"):
        A.convert(bad, "tar").collect()
