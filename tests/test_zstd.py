"""Zstandard does what it is asked for, or fails."""

import pytest

from quarry.codecs import registry

TEXT = b"".join(b"line %d of %d\n" % (i * i % 977, i) for i in range(4000))


def test_no_weaker_compression_without_the_library(monkeypatch):
    monkeypatch.setattr(registry, "zstandard", None)
    with pytest.raises(Exception):
        registry.compress("zstd", TEXT, 19)
    with pytest.raises(Exception):
        registry.zstd_compress(TEXT, 19, b"line of")


def test_level_and_checksum():
    low, high = registry.compress("zstd", TEXT, 1), registry.compress("zstd", TEXT, 19)
    assert len(high) < len(low) and high[4] & 4  # the frame's checksum flag
    broken = high[:-1] + bytes([high[-1] ^ 1])
    with pytest.raises(Exception):
        registry.decompress("zstd", broken)
    assert registry.decompress("zstd", high) == TEXT


@pytest.mark.parametrize("data", [b"", b"\x28\xb5", b"no frame at all"])
def test_what_is_no_frame_is_an_error(data):
    with pytest.raises(registry.CodecError):
        registry.decompress("zstd", data)
