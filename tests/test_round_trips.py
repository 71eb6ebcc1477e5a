"""Round-trip queries pack each value once; kernels over several pieces of codes."""

import hashlib
import os
import random

import pytest
from pyspark.sql.functions import arrow_udf

from quarry.codecs import checksums, lzw, snappy
from quarry.plans import scalars


def test_each_text_is_packed_once(spark, sf_dir):
    import pyarrow as pa

    @arrow_udf("binary")
    def salted(v: pa.Array) -> pa.Array:
        return pa.array([os.urandom(8) for _ in v], pa.binary())

    @arrow_udf("binary")
    def same(v: pa.Array) -> pa.Array:
        return v

    try:
        scalars._round_trip("_salted", salted, same, "00" * 8)
        # what is unpacked is what the head was taken from
        rows = scalars.QUERIES["_salted"](spark, sf_dir).select("digest", "head").collect()
    finally:
        scalars.QUERIES.pop("_salted"), scalars.ORACLE_SQL.pop("_salted")
    assert rows and all(r["digest"] == hashlib.sha256(bytes.fromhex(r["head"])).hexdigest() for r in rows)


def plain_codes(data, config):
    """Codes and widths by the rules, one at a time, as (code, bits)."""
    clear, end = 1 << config.root, (1 << config.root) + 1
    width, table, code, out = config.root + 1, {}, end + 1, []
    if config.clear:
        out.append((clear, width))
    word = b""
    known = lambda w: w[0] if len(w) == 1 else table[w]
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        out.append((known(word), width))
        if code < 1 << config.most:
            table[longer], code = code, code + 1
            width += code + config.early > 1 << width and width < config.most
        if config.clear and code + config.early >= 1 << config.most:
            out.append((clear, width))
            width, table, code = config.root + 1, {}, end + 1
        word = data[i : i + 1]
    if word:
        out.append((known(word), width))
        width += code < 1 << config.most and code + 1 + config.early > 1 << width and width < config.most
    return [*out, (end, width)]


@pytest.mark.parametrize("config", [lzw.TIFF, lzw.TIFF_NO_CLEAR, lzw.gif(8), lzw.LzwConfig(most=9), lzw.LzwConfig(root=2, most=5, msb=False, early=False)])
def test_lzw_codes_one_by_one(config):
    rnd = random.Random(5)
    for n in (0, 1, 2, 300, 9000, 40_000):
        data = bytes(rnd.choice(b"\0\1\2\3") for _ in range(n)) if config.root < 8 else rnd.randbytes(n // 2) + b"abcab" * (n // 10)
        wanted = plain_codes(data, config)
        if config.msb:
            bits = "".join(f"{c:0{w}b}" for c, w in wanted)
            packed = int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
        else:
            bits = "".join(f"{c:0{w}b}"[::-1] for c, w in wanted)
            packed = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
        assert lzw.compress(data, config) == packed
        assert lzw.decompress(packed, config) == data
        assert lzw.decompress(packed, config, n // 2) == data[: n // 2]


def test_lzw_damage():
    with pytest.raises(ValueError):
        lzw.decompress(b"\x80\x7f\xff\xff\xff")
    with pytest.raises(ValueError):
        lzw.decompress(lzw.compress(b"abc" * 50), size=1000)
    cleared = "100000000" * 5000 + "001100001" + "100000001"  # clear codes only, then one symbol
    cleared += "0" * (-len(cleared) % 8)
    assert lzw.decompress(int(cleared, 2).to_bytes(len(cleared) // 8, "big")) == b"a"


def test_snappy_dictionary_across_elements():
    rnd = random.Random(9)
    words = b"the quick brown fox jumps over the lazy dog and more "
    noise = rnd.randbytes(3000)
    # elements that reach over the dictionary's end, noise that the library skips, values beyond its 64 KiB
    for dictionary in (b"", words, noise, words * 40, b"a" * 70_000, b"abcd" * 20):
        for data in (b"", b"a", words, dictionary[-50:] * 3, noise[1000:], b"a" * 300, b"abcd" * 5000, words * 1400, rnd.randbytes(300)):
            packed = snappy.compress_with_dictionary(data, dictionary)
            assert snappy.decompress_with_dictionary(packed, dictionary) == data
            assert snappy.unframe(snappy.frame_with_dictionary(data, dictionary), dictionary) == data
    assert len(snappy.compress_with_dictionary(noise[1000:], noise)) < 200
    for damaged in (b"\xff\xff\xff\xff\x07\0a", b"\x05\x10ab", b"\x04\x0d\xff", b"\x04\x0d"):
        with pytest.raises(ValueError):
            snappy.decompress_with_dictionary(damaged, words)


@pytest.mark.parametrize("crc", [checksums.CRC16, checksums.CRC32C, checksums.CRC64])
def test_short_values_are_summed_by_rows(crc):
    rnd = random.Random(11)
    for n in (0, 1, 63, 64, 65, 4096, 70_001):
        data, now, full = rnd.randbytes(n), (1 << crc.width) - 1 if crc.ones else 0, (1 << crc.width) - 1 if crc.ones else 0
        for b in data:
            now ^= b
            for _ in range(8):
                now = now >> 1 ^ crc.poly * (now & 1)
        assert crc.one(data) == now ^ full
        assert crc.many([data, b"x"], [5, 6])[0] == crc.many([data] * 50, [5] * 50)[0]


def test_snappy_dictionary_keeps_its_pace():
    import time

    data, words = b"".join(b"%d some words of line " % i for i in range(2000))[:32_768], b"the and of to that with for"
    lap = lambda f: min(_timed(f, time.process_time) for _ in range(3))
    # against a loop over the bytes, which stood here before
    loop = lap(lambda: sum(1 for b in data if b == 1))
    assert lap(lambda: snappy.unframe(snappy.frame_with_dictionary(data, words), words)) < 15 * loop


def _timed(f, clock):
    began = clock()
    f()
    return clock() - began


def test_chunked_batches_end_by_bytes(spark):
    import pyarrow as pa

    from quarry.operators import training

    @arrow_udf("int")
    def held(v: pa.Array) -> pa.Array:
        return pa.array([v.nbytes] * len(v), pa.int32())

    rows = spark.createDataFrame([(i, os.urandom(300_000)) for i in range(30)], "id int, text binary").coalesce(1)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert max(r[0] for r in training.compress_chunked(rows, "text", "lz4", size=4096).select(held("text")).collect()) < 6 << 20
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        frames = training.frame_table(rows, "text", "id", 4096)
        assert max(r[0] for r in training.unframe_table(frames, "text", "id").select(held("text")).collect()) < 6 << 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
