"""LZH archives whose header size and sum are the magic bytes of another format."""

import pytest
from pyspark.sql import functions as F

from quarry.containers import lzh
from quarry.functions.detect import detect, detect_bytes
from quarry.operators import archives as A

MAGIC = {"gzip": (b"\x1f\x8b", "c{}/t1.txt"), "zip": (b"PK", "c{}/" + "t" * 55)}


def looking_like(kind):
    """(name, content) of a file whose LZH header begins with that magic."""
    magic, name = MAGIC[kind]
    for i in range(100_000):
        w = lzh.Writer()
        w.add(name.format(i), b"turn %d" % i)
        if w.finish()[:2] == magic:
            return name.format(i), b"turn %d" % i
    raise AssertionError("no such header")


@pytest.mark.parametrize("kind", MAGIC)
def test_lzh_headers_that_begin_as_others(kind, spark):
    name, content = looking_like(kind)
    rows = spark.createDataFrame([("user", name, bytearray(content), 1)], "archive string, name string, content binary, entry_index int")
    blobs = A.pack(rows, "lzh")
    assert blobs.select(detect(F.col("content"))).first()[0] == detect_bytes(bytes(blobs.first()["content"])) == "LZH"
    seen = A.scan(blobs, with_content=True).collect()
    assert [(r["name"], bytes(r["content"]), r["status"]) for r in seen] == [(name, content, "OK")]
    extra = spark.createDataFrame([("user", "extra.txt", bytearray(b"hello"))], "archive string, name string, content binary")
    both = A.scan(A.add(blobs, extra, "lzh"), with_content=True).collect()
    assert {(r["name"], bytes(r["content"]), r["status"]) for r in both} == {(name, content, "OK"), ("extra.txt", b"hello", "OK")}
