"""Known answers and round trips of the codec kernels."""

import io
import os
import random
import tarfile
import zipfile
from datetime import UTC, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.codecs import checksums as C
from quarry.codecs import crypto, huffman, lz4, lzh, lzw, registry, snappy, szip, transforms
from quarry.containers import archive as A
from quarry.containers import lzh as L
from quarry.containers import others, tar
from quarry.functions.detect import detect_bytes

RND = random.Random(7)
SAMPLES = [b"", b"a", b"ab" * 2000, b"\0" * 5000, bytes(range(256)) * 20, RND.randbytes(3000), b"the quick brown fox jumps over the lazy dog. " * 100]
BINARY = st.binary(max_size=600)


def test_known_checksums():
    data = b"123456789"
    assert (C.CRC16.one(data), C.CRC32C.one(data), C.CRC64.one(data)) == (0xBB3D, 0xE3069283, 0x995DC9BBDF1939FA)
    assert C.xxh64(b"") == 0xEF46DB3751D8E999 and C.xxh32(b"") == 0x02CC5D05
    assert C.unmask(C.mask(0xDEADBEEF)) == 0xDEADBEEF


def test_lanes_agree_with_single_values():
    values = [RND.randbytes(n) for n in (0, 1, 5, 2047, 2048, 2049, 10_000)] * 10
    for crc in (C.CRC16, C.CRC32C, C.CRC64):
        assert crc.many(values).tolist() == [crc.one(v) for v in values]
    run = C.RunningCrc(C.CRC64).update(values[6][:777]).update(values[6][777:])
    assert run.value == C.CRC64.one(values[6])


@pytest.mark.parametrize("n", [0, 1, 3, 4, 15, 16, 31, 32, 33, 100, 1000])
def test_plain_xxh_agrees_with_package(n):
    data = RND.randbytes(n)
    assert C._xxh(data, 7, 32) == C.xxh32(data, 7) and C._xxh(data, 7, 64) == C.xxh64(data, 7)


@pytest.mark.parametrize("codec", sorted(registry.CODECS))
@pytest.mark.parametrize("data", SAMPLES, ids=range(len(SAMPLES)))
def test_registry_round_trip(codec, data):
    assert registry.decompress(codec, registry.compress(codec, data)) == data


@settings(max_examples=40, deadline=None)
@given(BINARY)
def test_kernels_round_trip(data):
    for config in (lzw.TIFF, lzw.TIFF_NO_CLEAR, lzw.gif(8)):
        assert lzw.decompress(lzw.compress(data, config), config) == data
    for method in lzh.METHODS:
        assert lzh.decode(lzh.encode(data, method), method, len(data)) == data
    assert transforms.inverse_bwt(*transforms.bwt(data)) == data
    assert transforms.inverse_mtf(transforms.mtf(data)) == data
    assert transforms.inverse_rle1(transforms.rle1(data)) == data
    assert transforms.inverse_zero_runs(transforms.zero_runs(data)) == data
    assert snappy.unframe(snappy.frame(data)) == data
    assert transforms.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=30, deadline=None)
@given(BINARY, st.binary(min_size=1, max_size=200))
def test_dictionaries(data, words):
    assert lz4.decompress_block(lz4.compress_block(data, words), len(data), words) == data
    assert lz4.decompress_frame(lz4.compress_frame(data, words), words) == data
    assert snappy.unframe(snappy.frame_with_dictionary(data, words), words) == data
    assert registry.inflate(registry.deflate(data, 6, words), words) == data
    assert registry.zstd_decompress(registry.zstd_compress(data, 3, words), words) == data


@settings(max_examples=30, deadline=None)
@given(BINARY, st.integers(1, 12))
def test_lz4_levels(data, level):
    data = data + data[:50] * 3
    for words in (b"", b"abcabcabc"):
        assert lz4.decompress_block(lz4.compress_block_hc(data, level, words), len(data), words) == data
    assert registry.lz4_unblock(lz4.compress_block_hc(data, level), len(data)) == data


def test_zip64():
    from quarry.containers import zip as zipfmt

    w = zipfmt.Writer()
    for i in range(70_000):
        w.add(f"{i}", method="Stored")
    blob = w.finish()
    assert len(zipfmt.central(blob)) == 70_000 and len(zipfile.ZipFile(io.BytesIO(blob)).namelist()) == 70_000


def test_large_repetitive_lzw():
    data = b"\0" * 200_000 + b"\xff" * 200_000
    assert lzw.decompress(lzw.compress(data)) == data


def test_limits_and_damage():
    with pytest.raises(ValueError):
        lz4.decompress_block(lz4.compress_block(b"a" * 1000), 10)
    with pytest.raises(ValueError):
        snappy.unframe(snappy.frame(b"hello")[:-1])
    with pytest.raises(ValueError):
        snappy.unframe(snappy.frame_with_dictionary(b"hello", b"one"), b"two")
    with pytest.raises(registry.CodecError):
        registry.decompress("zlib", registry.compress("zlib", b"a" * 10_000), max_ratio=10)
    with pytest.raises(registry.CodecError):
        registry.inflate(registry.deflate(b"abc" * 100)[:-3])
    assert registry.gzip_decompress(registry.gzip_compress(b"a") + registry.gzip_compress(b"b")) == b"ab"
    assert lz4.decompress_frame(lz4.compress_frame(b"x" * 99)) == registry._arrow_stream(lz4.compress_frame(b"x" * 99), "lz4")


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 12, 16, 32])
@pytest.mark.parametrize("block", [8, 16, 32])
@pytest.mark.parametrize("nearest", [True, False])
def test_sample_coding(bits, block, nearest):
    p = szip.Params(bits, block, 4, nearest)
    for samples in ([], [0] * 200, [RND.randint(0, p.highest) for _ in range(333)], [min(p.highest, i // 3) for i in range(500)], [0] * 2000 + [p.highest] + [0] * 900):
        assert szip.decode(szip.encode(samples, p), len(samples), p) == samples
    with pytest.raises(ValueError):
        szip.Params(33)


def test_huffman():
    counts = [RND.randint(0, 1000) for _ in range(100)]
    sizes = huffman.lengths(counts, 9)
    assert max(sizes) <= 9 and abs(huffman.kraft(sizes) - 1) < 1e-9
    assert len(set(zip(sizes, huffman.codes(sizes), strict=True)) - {(0, 0)}) == sum(f > 0 for f in counts)
    assert sum(huffman.normalise(counts, 512)) == 512


def test_crypto_vectors():
    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)[None]
    for n, expected in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert crypto.aes_blocks(block, crypto.expand_key(bytes(range(n)))).tobytes().hex() == expected
    with pytest.raises(PermissionError):
        crypto.ae2_decrypt(crypto.ae2_encrypt(b"data", b"a"), b"b", 3)


WHEN = datetime(2024, 3, 5, 12, 34, 56, tzinfo=UTC)
FILES = [("root.txt", b"r"), ("dir1/a.txt", b"aa" * 500), ("dir1/", b""), ("dir2/sub/ü.txt", os.urandom(3000)), ("empty", b"")]
ROWS = [{"name": n, "content": c, "entry_type": "Directory" if n.endswith("/") else "File", "modified": WHEN} for n, c in FILES]


@pytest.mark.parametrize("format", ["zip", "tar", "lzh"])
def test_containers(format):
    rows = A.rows(A.pack(ROWS, format), "x", content=True)
    assert [(e["name"], e["content"], e["status"], e["modified"]) for e in rows] == [(n, c, "OK", WHEN) for n, c in FILES]


def test_other_tools_read_ours():
    assert zipfile.ZipFile(io.BytesIO(A.pack(ROWS, "zip"))).testzip() is None
    names = [m.name + "/" * m.isdir() for m in tarfile.open(fileobj=io.BytesIO(A.pack(ROWS, "tar")))]
    assert names == [n for n, _ in FILES]


@pytest.mark.parametrize("encryption", ["aes128", "aes192", "aes256", "traditional"])
def test_encrypted_zip(encryption):
    blob = A.pack(ROWS, "zip", password=b"pw", encryption=encryption)
    assert [e["content"] for e in A.rows(blob, content=True, password=b"pw")] == [c for _, c in FILES]
    assert all(e["status"] != "OK" for e in A.rows(blob, content=True, password=b"no") if e["entry_type"] == "File")
    assert {e["status"] for e in A.rows(blob, content=True) if e["entry_type"] == "File"} == {"PASSWORD"}


def test_long_tar_names_and_links():
    name = "d/" * 60 + "x" * 130
    blob = A.pack([{"name": name, "content": b"q"}, {"name": "l", "entry_type": "Symlink", "link_target": "t" * 150}], "tar")
    first, second = A.rows(blob, content=True)
    assert first["name"] == name and (second["entry_type"], second["link_target"]) == ("Symlink", "t" * 150)


def test_sparse_tar():
    runs, real = tar.pax_sparse({"GNU.sparse.map": "0,2,6,2", "GNU.sparse.realsize": "10"})
    tar.check_sparse(runs, real)
    assert tar.fill_sparse(b"abcd", runs, real) == b"ab\0\0\0\0cd\0\0"
    with pytest.raises(ValueError):
        tar.check_sparse([(0, 4), (2, 4)], 10)


@pytest.mark.parametrize("level", [1, 2, 3])
def test_lzh_levels(level):
    w = L.Writer()
    w.add("dir/a.txt", b"hello" * 50, level=level, modified=WHEN, **({"comment": "hi", "unix_mode": 0o600, "uid": 5, "uname": "me"} if level == 3 else {}))
    (e,) = A.rows(w.finish(), content=True)
    assert (e["name"], e["content"], e["modified"]) == ("dir/a.txt", b"hello" * 50, WHEN)
    if level == 3:
        assert (e["comment"], e["attributes"]["unix_mode"], e["attributes"]["uid"], e["uname"]) == ("hi", 0o600, 5, "me")


def _cab(files: list[tuple[str, bytes]]) -> bytes:
    import struct
    import zlib

    body = b"".join(c for _, c in files)
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = b"CK" + z.compress(body) + z.flush()
    entries, at = b"", 0
    for n, c in files:
        entries += struct.pack("<IIHHHH", len(c), at, 0, 0x5865, 0x6000, 0x21) + n.encode() + b"\0"
        at += len(c)
    head, folder = 36, 8
    data_at = head + folder + len(entries)
    block = struct.pack("<HH", len(packed), len(body))
    check = others.cab_checksum(block, others.cab_checksum(packed))
    data = struct.pack("<I", check) + block + packed
    return b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, data_at + len(data), 0, head + folder, 0, 3, 1, 1, len(files), 0, 0, 0) + struct.pack("<IHH", data_at, 1, 1) + entries + data


def test_cab():
    rows = A.rows(_cab([("a.txt", b"hello"), ("b\\c.txt", b"world" * 20)]), content=True)
    assert [(e["name"], e["content"], e["status"]) for e in rows] == [("a.txt", b"hello", "OK"), ("b/c.txt", b"world" * 20, "OK")]
    damaged = bytearray(_cab([("a.txt", b"hello")]))
    damaged[-1] ^= 1
    assert A.rows(bytes(damaged), content=True)[0]["status"] == "CORRUPT"


def _iso() -> bytes:
    import struct

    both = lambda v: struct.pack("<I", v) + struct.pack(">I", v)

    def record(name: bytes, lba: int, size: int, flags: int) -> bytes:
        body = b"\0" + both(lba) + both(size) + bytes([124, 3, 5, 12, 34, 56, 0]) + bytes([flags, 0, 0]) + b"\1\0\0\1" + bytes([len(name)]) + name
        body += b"\0" * (len(body) % 2 == 0)
        return bytes([len(body) + 1]) + body

    root = (record(b"\0", 18, 2048, 2) + record(b"\1", 18, 2048, 2) + record(b"A.TXT;1", 20, 5, 0) + record(b"D", 19, 2048, 2)).ljust(2048, b"\0")
    sub = (record(b"\0", 19, 2048, 2) + record(b"\1", 18, 2048, 2) + record(b"B.TXT;1", 20, 4, 0)).ljust(2048, b"\0")
    volume = (b"\1CD001\1\0").ljust(156, b"\0") + record(b"\0", 18, 2048, 2)
    end = b"\xffCD001\1".ljust(2048, b"\0")
    return b"\0" * 32768 + volume.ljust(2048, b"\0") + end + root + sub + b"hello".ljust(2048, b"\0")


def test_iso():
    assert detect_bytes(_iso()) == "ISO 9660"
    rows = A.rows(_iso(), content=True)
    assert [(e["name"], e["content"]) for e in rows] == [("A.TXT", b"hello"), ("D/", b""), ("D/B.TXT", b"hell")]


def _sevenzip(files: list[tuple[str, bytes]]) -> bytes:
    import lzma
    import struct
    import zlib

    body = b"".join(c for _, c in files)
    packed = lzma.compress(body, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
    num = lambda v: bytes([v]) if v < 128 else bytes([0x80 | v >> 8, v & 255])
    sizes = b"".join(num(len(c)) for _, c in files[:-1])
    crcs = b"".join(struct.pack("<I", zlib.crc32(c)) for _, c in files)
    streams = b"\x04\x06" + num(0) + num(1) + b"\x09" + num(len(packed)) + b"\0\x07\x0b" + num(1) + b"\0" + num(1) + b"\x21\x21\x01\x10" + b"\x0c" + num(len(body)) + b"\0\x08\x0d" + num(len(files)) + b"\x09" + sizes + b"\x0a\x01" + crcs + b"\0\0"
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in files)
    head = b"\1" + streams + b"\x05" + num(len(files)) + b"\x11" + num(len(names)) + names + b"\0\0"
    start = struct.pack("<QQI", len(packed), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + packed + head


def test_sevenzip():
    files = [("a.txt", b"hello"), ("d/b.txt", b"world" * 20)]
    rows = A.rows(_sevenzip(files), content=True)
    assert [(e["name"], e["content"], e["status"], e["method"]) for e in rows] == [(n, c, "OK", "LZMA2") for n, c in files]


def test_streams_of_zip():
    sink = io.BytesIO()

    class Pipe(io.RawIOBase):
        def writable(self):
            return True

        def write(self, data):
            sink.write(data)
            return len(data)

    with zipfile.ZipFile(Pipe(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello" * 100)
        z.writestr("b.txt", "x" * 99)
    assert [e["content"] for e in A.rows(sink.getvalue(), mode="stream", content=True)] == [b"hello" * 100, b"x" * 99]
    assert A.rows(sink.getvalue(), mode="local_headers") == []


def test_repair_and_lenient():
    blob = A.pack(ROWS, "zip")
    found = A.recover(b"junk" * 3 + blob[: blob.rfind(b"PK\1\2")])
    assert [r["name"] for r in found if r["kind"] == "entry"] == [n for n, _ in FILES]
    assert [(r["start"], r["stop"]) for r in found if r["kind"] == "skipped"][0] == (0, 12)
    damaged = bytearray(A.pack(ROWS, "tar"))
    damaged[10] ^= 1
    assert A.rows(bytes(damaged))[0]["status"] == "CORRUPT"
    rows = A.rows(bytes(damaged), lenient=True)
    assert [w["kind"] for w in rows[0]["warnings"]] == ["HeaderChecksumMismatch", "ScannedForward"]
    flipped = bytearray(blob)
    flipped[blob.find(b"root.txt") + 8] ^= 1
    assert A.rows(bytes(flipped), content=True)[0]["status"] == "CRC_MISMATCH"
    for cut in (b"", b"P", b"PK\3\4", blob[:40], b"\0" * 100):
        assert all(e["status"] != "OK" or e["content"] is not None or e["entry_type"] == "Directory" for e in A.rows(cut, content=True))


def test_encoders_hold_no_more_than_a_value_needs():
    # an encoder's tables follow its dictionary, which the stream's header states
    assert int.from_bytes(registry.compress("lzma", b"abc" * 500)[1:5], "little") == 4096
    assert int.from_bytes(registry.compress("lzma", bytes(9 << 20))[1:5], "little") == 8 << 20


def test_huffman_tree_is_as_short_as_package_merge():
    for n in (2, 3, 70, 510):
        counts = [RND.randint(0, 1 << RND.randint(0, 12)) for _ in range(n)] + [1, 2]
        cost = [sum(c * s for c, s in zip(counts, f(counts, 16), strict=True)) for f in (huffman.lengths, huffman.quick_lengths)]
        assert cost[0] == cost[1]
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(sum(fibonacci[-2:]))
    assert huffman.quick_lengths(fibonacci, 16) == huffman.lengths(fibonacci, 16)


def test_lzh_streams_of_many_pieces():
    data = RND.randbytes(3 * lzh.PIECE) + b"abcabc" * 5000
    packed = lzh.encode(data, "lh5")
    assert lzh.decode(packed, "lh5", len(data)) == data
    with pytest.raises((EOFError, ValueError)):
        lzh.decode(packed[: len(packed) // 2], "lh5", len(data))
