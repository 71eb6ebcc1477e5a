"""Kernels that take the values of a batch side by side, against those that take one."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.codecs import crypto, lzh
from quarry.functions import codecs

RND = random.Random(5)
WORDS = [bytes(RND.choices(b"abcdefghijklmnopqrstuvwxyz", k=RND.randrange(1, 9))) for _ in range(300)]


def texts(n, most):
    return [b" ".join(RND.choices(WORDS, k=RND.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 5, 60])
def test_zipcrypto_of_many(n):
    values = [b"", b"x", *texts(n, 200), *texts(1, 4000)][: n + 3]
    locked = crypto.zipcrypto_many(values, b"secret", True)
    assert locked == [crypto.ZipCrypto(b"secret").encrypt(v) for v in values]
    assert crypto.zipcrypto_many(locked, b"secret", False) == values


def test_zipcrypto_column(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else "text %d " % i * i) for i in range(40)], "i int, t string").coalesce(1)
    locked = rows.withColumn("p", codecs.zipcrypto_encrypt(F.col("t").cast("binary"), b"secret")).cache()
    back = locked.withColumn("q", codecs.zipcrypto_decrypt(F.when(F.col("p").isNotNull(), F.col("p")), b"secret")).collect()
    assert all((None if r["q"] is None else bytes(r["q"]).decode()) == r["t"] for r in back)
    with pytest.raises(Exception, match="wrong password"):
        locked.select(codecs.zipcrypto_decrypt(F.col("p"), b"guess")).collect()


def test_zipcrypto_of_many_is_faster_than_one_by_one():
    values = texts(1000, 500)
    took = []
    for f in (lambda: crypto.zipcrypto_many(values, b"secret", True), lambda: [crypto.ZipCrypto(b"secret").encrypt(v) for v in values[:100]]):
        begun = time.perf_counter()
        f()
        took.append(time.perf_counter() - begun)
    assert took[0] < took[1] * 10 / 3  # a tenth of the values one by one


def lzh_values():
    return [
        b"", b"a", b"aaaa", bytes(5000), b"ab" * 3000, bytes(range(256)) * 20, RND.randbytes(3000), RND.randbytes(20_000), *texts(40, 900), *texts(1, 20_000),
        b"".join(b"%c" % (65 + k) * int(1.6**k) for k in range(18)), RND.randbytes(4200) + RND.randbytes(10) * 3, b"x" * 300 + RND.randbytes(4090) + b"x" * 300,
    ]


@pytest.mark.parametrize("method", lzh.METHODS)
@pytest.mark.parametrize("few", [False, True])
def test_lzh_of_many(method, few):
    values = lzh_values()[: 5 if few else None]
    packed = [lzh.encode(v, method) for v in values]
    assert [lzh.decode(p, method, len(v)) for p, v in zip(packed, values, strict=True)] == values
    assert lzh.decode_many(packed, method, [len(v) for v in values]) == values


@pytest.mark.parametrize("method", ["lh4", "lh5", "lh6", "lh7"])
def test_damage_among_many_is_found(method):
    values = texts(30, 400)[:] + [b"some text " * 40]
    packed = [lzh.encode(v, method) for v in values]
    sizes = [len(v) for v in values]
    packed[-1] = packed[-1][:-4]
    with pytest.raises(Exception):
        lzh.decode(packed[-1], method, sizes[-1])
    with pytest.raises(Exception):
        lzh.decode_many(packed, method, sizes)
    assert lzh.decode_many(packed[:-1], method, sizes[:-1]) == values[:-1]


def test_lzh_of_other_encoders():
    # matches of the general search, of three bytes, and codes of many blocks among single ones
    values = texts(20, 600) + [RND.randbytes(40_000)]
    packed = [lzh.encode(b"\0" + v, "lh5", b"\1") for v in values]
    assert lzh.decode_many(packed, "lh5", [len(v) + 1 for v in values]) == [b"\0" + v for v in values]


def test_lzh_packs_no_worse_than_the_general_search():
    values = [v for v in texts(40, 900) if v]
    general = sum(len(lzh.encode(v, "lh5", b"\1")) for v in values)  # a dictionary takes the general search
    assert sum(len(lzh.encode(v, "lh5")) for v in values) <= general * 1.01


def test_lzh_of_many_is_faster_than_one_by_one():
    values = [v for v in texts(600, 700) if v]
    packed, sizes = [lzh.encode(v) for v in values], [len(v) for v in values]
    took = []
    for f in (lambda: lzh.decode_many(packed, "lh5", sizes), lambda: [lzh.decode(p, "lh5", n) for p, n in zip(packed, sizes, strict=True)]):
        best = 1e9
        for _ in range(3):
            begun = time.process_time()
            f()
            best = min(best, time.process_time() - begun)
        took.append(best)
    assert took[0] < took[1] / 1.5
