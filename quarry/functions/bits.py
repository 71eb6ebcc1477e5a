"""Bit arithmetic, code tables and codec parameters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.times import byte_at, little_endian

MASK32 = (1 << 32) - 1


def reverse_bits(value: Column, n: int) -> Column:
    """The low n bits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(value.bitwiseAND(F.lit((1 << n) - 1))), n, "0")), 2, 10).cast("bigint")


def mask_crc(crc: Column) -> Column:
    """Rotation by 15 plus a constant (0xA282EAD8), modulo 2**32."""
    rotated = F.shiftrightunsigned(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(MASK32))
    return (rotated + F.lit(0xA282EAD8)).bitwiseAND(F.lit(MASK32))


def unmask_crc(masked: Column) -> Column:
    rotated = (masked - F.lit(0xA282EAD8)).bitwiseAND(F.lit(MASK32))
    return F.shiftleft(rotated, 15).bitwiseOR(F.shiftrightunsigned(rotated, 17)).bitwiseAND(F.lit(MASK32))


def sigma_map(delta: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 ... -> 0, 1, 2, 3 ..."""
    return F.when(delta >= 0, delta * 2).otherwise(delta * -2 - 1)


def inverse_sigma(sigma: Column) -> Column:
    return F.when(sigma % 2 == 0, F.floor(sigma / 2)).otherwise(-F.floor((sigma + 1) / 2)).cast("bigint")


def id_length(bits_per_pixel: Column) -> Column:
    """Bits of a block's option id."""
    return F.when(bits_per_pixel <= 2, 1).when(bits_per_pixel <= 4, 2).when(bits_per_pixel <= 8, 3).when(bits_per_pixel <= 16, 4).otherwise(5)


def valid_sample_params(bits_per_pixel: Column, pixels_per_block: Column) -> Column:
    return bits_per_pixel.between(1, 32) & pixels_per_block.isin(8, 16, 32)


def bytes_per_sample(bits_per_pixel: Column) -> Column:
    return F.when(bits_per_pixel <= 8, 1).when(bits_per_pixel <= 16, 2).when(bits_per_pixel <= 32, 4).otherwise(8)


def samples_to_bytes(samples: Column, width: int) -> Column:
    """Big-endian bytes of an array of numbers."""
    return F.unhex(F.array_join(F.transform(samples, lambda v: F.lpad(F.hex(v), 2 * width, "0")), ""))


def bytes_to_samples(data: Column, width: int) -> Column:
    count = F.floor(F.octet_length(data) / width).cast("int")
    one = lambda i: F.conv(F.hex(F.substring(data, (i * width + 1).cast("int"), F.lit(width))), 16, 10).cast("bigint")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<bigint>"))


def nearest_neighbour(samples: Column) -> Column:
    """Differences to the sample before, zig-zag mapped; the first sample stands as it is."""
    return F.transform(samples, lambda v, i: F.when(i == 0, v).otherwise(sigma_map(v - F.element_at(samples, F.greatest(i, F.lit(1))))))


def inverse_nearest_neighbour(mapped: Column, highest: int) -> Column:
    """Running sum of the unmapped differences, clamped to 0..highest."""
    clamp = lambda v: F.least(F.greatest(v, F.lit(0).cast("bigint")), F.lit(highest).cast("bigint"))
    empty = F.array().cast("array<bigint>")
    return F.aggregate(mapped, empty, lambda a, v: F.concat(a, F.array(F.when(F.size(a) == 0, v.cast("bigint")).otherwise(clamp(F.element_at(a, F.greatest(F.size(a), F.lit(1))) + inverse_sigma(v))))))


def lz_length_code(length: Column) -> Column:
    """DEFLATE length 3..258 -> struct(symbol, extra bits, extra value). From the rule that each
    group of four codes from 265 on takes one extra bit more; 258 has a code of its own."""
    n = (length - 3).cast("int")
    bits = F.when(n < 8, 0).otherwise(F.floor(F.log2(n.cast("double"))).cast("int") - 2)
    code = F.when(n < 8, 257 + n).otherwise(257 + 4 * (bits + 1) + F.call_function("shiftright", n, bits) - 4)
    value = F.when(n < 8, 0).otherwise(n - F.call_function("shiftleft", F.call_function("shiftright", n, bits), bits))
    last = length == 258
    return F.when(length.between(3, 258), F.struct(F.when(last, 285).otherwise(code).alias("symbol"), F.when(last, 0).otherwise(bits).alias("bits"), F.when(last, 0).otherwise(value).alias("value")))


def lz_distance_code(distance: Column, most: int | None = 32768) -> Column:
    """DEFLATE distance 1..32768 -> struct(symbol, extra bits, extra value). most: the largest distance, or
    None: two symbols for each power of two go on as they do in formats with larger windows."""
    n = (distance - 1).cast("bigint")
    bits = F.when(n < 4, 0).otherwise(F.length(F.bin(n)) - 2)  # binary digits are exact where logarithms round
    code = F.when(n < 4, n).otherwise(2 * bits + F.call_function("shiftright", n, bits)).cast("int")
    value = F.when(n < 4, F.lit(0)).otherwise(n - F.call_function("shiftleft", F.call_function("shiftright", n, bits), bits))
    known = distance >= 1 if most is None else distance.between(1, most)
    return F.when(known, F.struct(code.alias("symbol"), bits.alias("bits"), value.alias("value")))


# Match-search settings by DEFLATE level 0..9 and by preset (longest chain, nice length).
DEFLATE_LEVELS = [(0, 258), (4, 258), (8, 258), (16, 258), (32, 258), (64, 64), (128, 128), (256, 192), (1024, 250), (4096, 258)]
DEFLATE_PRESETS = {"fast": (8, 16), "default": (128, 128), "best": (256, 128), "ultra": (4096, 258)}


def deflate_params(level: Column) -> Column:
    pick = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in DEFLATE_LEVELS]), F.least(level, F.lit(9)).cast("int") + 1)
    return F.struct(pick(0).alias("max_chain"), pick(1).alias("nice_length"))


def zstd_params(level: Column) -> Column:
    """Match-search settings by level, clamped to 1..22."""
    n = F.least(F.greatest(level, F.lit(1)), F.lit(22))
    by = lambda *v: F.when(n <= 2, v[0] if n is not None else None).when(n == 3, v[1]).when(n <= 6, v[2]).when(n <= 9, v[3]).when(n <= 15, v[4]).otherwise(v[5])
    depth = F.when(n <= 2, n).when(n == 3, 6).when(n <= 6, n * 4).when(n <= 9, n * 8).when(n <= 15, n * 16).otherwise(n * 32)
    return F.struct(by(17, 17, 18, 19, 20, 20).alias("hash_log"), by(0, 16, 17, 18, 19, 20).alias("chain_log"), depth.alias("search_depth"), (n >= 4).alias("lazy"), by(0, 0, 1, 1, 2, 3).alias("lazy_gain"))


def lzma_dictionary(level: Column) -> Column:
    """64 KiB at level 0, then 256 KiB doubling up to 64 MiB at level 9."""
    n = F.least(F.greatest(level, F.lit(0)), F.lit(9)).cast("int")
    return F.when(n == 0, 1 << 16).otherwise(F.call_function("shiftleft", F.lit(1), n + 17))


def lzma_props(byte: Column) -> Column:
    """(pb * 5 + lp) * 9 + lc, null above 224."""
    return F.when(byte < 225, F.struct((byte % 9).alias("lc"), (F.floor(byte / 9) % 5).cast("int").alias("lp"), F.floor(byte / 45).cast("int").alias("pb")))


def lzma2_dictionary(props: Column) -> Column:
    p = props.cast("int")
    return F.when(p >= 40, F.lit(MASK32)).otherwise(F.call_function("shiftleft", F.lit(2).cast("bigint").bitwiseOR(p.bitwiseAND(F.lit(1)).cast("bigint")), F.floor(p / 2).cast("int") + 11))


def lzma2_chunk(control: Column) -> Column:
    """Kind of an LZMA2 chunk and what it resets; undefined control bytes end the stream."""
    reset = F.floor((control - 128) / 32)
    kind = F.when(control.isin(1, 2), "uncompressed").when(control >= 128, "lzma").otherwise("end")
    return F.struct(kind.alias("kind"), F.when(control == 1, True).when(control >= 128, reset == 3).otherwise(False).alias("reset_dict"), F.when(control >= 128, reset >= 2).otherwise(False).alias("reset_state"))


def lzma_memory(level: Column, size: Column, overhead: int = 1 << 20) -> Column:
    """Bytes that an encoder needs: dictionary, input and overhead."""
    return lzma_dictionary(level).cast("bigint") + size + overhead


def check_budget(need: Column, budget: int) -> Column:
    return F.when(need > budget, F.raise_error(F.concat(F.lit("memory budget exceeded: "), need.cast("string"))).cast("bigint")).otherwise(need)


def snappy_bound(length: Column) -> Column:
    """Largest compressed size: length header, 32 bytes, the input and a sixth."""
    header = F.when(length < 1 << 7, 1).when(length < 1 << 14, 2).when(length < 1 << 21, 3).when(length < 1 << 28, 4).otherwise(5)
    return header + 32 + length + F.floor(length / 6)


def brotli_params_valid(quality: Column, lgwin: Column, lgblock: Column) -> Column:
    return quality.between(0, 11) & lgwin.between(16, 24) & ((lgblock == 0) | lgblock.between(16, 24))


def brotli_context(mode: str, p1: Column, p2: Column) -> Column:
    """Literal context of the two bytes before (p1 the nearer)."""
    if mode == "lsb6":
        return p1.bitwiseAND(F.lit(0x3F))
    if mode == "msb6":
        return F.shiftrightunsigned(p1.cast("int"), 2)
    if mode == "signed":
        level = lambda p: F.when(p == 0, 0).when(p < 16, 1).when(p < 64, 2).when(p < 128, 3).when(p < 192, 4).when(p < 240, 5).when(p < 255, 6).otherwise(7)
        return level(p1) * 8 + level(p2)
    if mode == "utf8":
        among = lambda chars: p1.isin([ord(c) for c in chars])
        near = (
            F.when(among("\t\n\r"), 4).when((p1 < 32) | (p1 == 127), 0).when(p1 == 32, 8).when(among("\"'"), 16).when(among("%"), 20).when(among("([{<"), 24).when(among(")]}>"), 28)
            .when(among(",:;"), 32).when(among("."), 36).when(among("="), 40).when(among("0123456789"), 44).when(among("AEIOU"), 48).when(p1.between(65, 90), 52)
            .when(among("aeiou"), 56).when(p1.between(97, 122), 60).when(p1 < 128, 12).when(p1 < 192, p1 % 2).otherwise(2 + p1 % 2)
        )
        far = F.when((p2 < 32) | (p2 == 127), 0).when(p2.between(97, 122), 3).when(p2.between(48, 57) | p2.between(65, 90), 2).when(p2 < 128, 1).when(p2 < 192, 0).otherwise(2)
        return near.bitwiseOR(far)
    raise ValueError(mode)


def lz4_flags(independent: Column, block_checksum: Column, has_size: Column, content_checksum: Column, has_dict: Column) -> Column:
    """FLG byte of an LZ4 frame, version 01."""
    bit = lambda c, v: F.when(c, v).otherwise(0)
    return F.lit(0x40) + bit(independent, 0x20) + bit(block_checksum, 0x10) + bit(has_size, 0x08) + bit(content_checksum, 0x04) + bit(has_dict, 0x01)


def lz4_frame_dict_id(frame: Column) -> Column:
    """Dictionary id of an LZ4 frame header, null without one."""
    flags = byte_at(frame, 4)
    magic = F.hex(F.substring(frame, 1, 4)) == "04224D18"
    at6, at14 = little_endian(frame, 6, 4), little_endian(frame, 14, 4)
    return F.when(magic & (flags.bitwiseAND(F.lit(1)) == 1), F.when(flags.bitwiseAND(F.lit(8)) == 8, at14).otherwise(at6))


def zlib_dict_id(data: Column) -> Column:
    """Required dictionary id (Adler-32) of a zlib stream, null if it needs none."""
    head = byte_at(data, 0) * 256 + byte_at(data, 1)
    valid = (byte_at(data, 0).bitwiseAND(F.lit(15)) == 8) & (head % 31 == 0)
    big = byte_at(data, 2) * F.lit(1 << 24) + byte_at(data, 3) * F.lit(1 << 16) + byte_at(data, 4) * 256 + byte_at(data, 5)
    return F.when(valid & (byte_at(data, 1).bitwiseAND(F.lit(32)) == 32), big)


def zstd_content_size(frame: Column) -> Column:
    """Content size of a Zstandard frame header, null if it is not stated."""
    d = byte_at(frame, 4)
    single = d.bitwiseAND(F.lit(32)) == 32
    code = F.shiftrightunsigned(d.cast("int"), 6)
    dict_size = F.element_at(F.array(*[F.lit(x) for x in (0, 1, 2, 4)]), d.bitwiseAND(F.lit(3)).cast("int") + 1)
    out = None
    for offset in range(0, 5):
        if offset == 3:
            continue
        for window in (0, 1):
            start = 5 + window + offset
            value = F.when(code == 0, F.when(single, byte_at(frame, start))).when(code == 1, little_endian(frame, start, 2) + 256).when(code == 2, little_endian(frame, start, 4)).otherwise(little_endian(frame, start, 7))
            here = (dict_size == offset) & (single == (window == 0))
            out = F.when(here, value) if out is None else out.when(here, value)
    return F.when(F.hex(F.substring(frame, 1, 4)) == "28B52FFD", out)


def skippable_frame(content: Column, nibble: int = 0) -> Column:
    """A Zstandard skippable frame around content."""
    size = F.octet_length(content)
    le = F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(size, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)])
    return F.concat(F.unhex(F.lit(f"{0x50 + nibble:02X}2A4D18")), F.unhex(le), content)


def snappy_length(block: Column) -> Column:
    """Decoded length that a Snappy block states (a variable-length number of up to five bytes)."""
    from quarry.functions.times import leb128

    return leb128(F.substring(block, 1, 5))


def bzip2_level(data: Column) -> Column:
    return F.when(F.hex(F.substring(data, 1, 3)) == "425A68", byte_at(data, 3) - 48)


# Method id -> (window bytes, position bits) of the LZH methods.
LZH_METHODS = {"-lh0-": (0, 0), "-lh4-": (4096, 12), "-lh5-": (8192, 13), "-lh6-": (32768, 15), "-lh7-": (65536, 16)}


def lzh_method(method_id: Column) -> Column:
    window = F.create_map(*[F.lit(x) for k, v in LZH_METHODS.items() for x in (k, v[0])])
    bits = F.create_map(*[F.lit(x) for k, v in LZH_METHODS.items() for x in (k, v[1])])
    return F.when(method_id.isin(list(LZH_METHODS)), F.struct(F.substring(method_id, 2, 3).alias("name"), window[method_id].alias("window"), bits[method_id].alias("position_bits")))


def is_run(data: Column) -> Column:
    """The byte that a run consists of, null if the bytes differ or there are none."""
    first = F.hex(F.substring(data, 1, 1))
    return F.when((F.octet_length(data) > 0) & (F.hex(data) == F.repeat(first, F.octet_length(data))), byte_at(data, 0))


def sequence_mode(distinct: Column, total: Column) -> Column:
    """How the symbols of a block's sequences are coded, from their counts."""
    return F.when((total == 0) | (distinct == 0), "predefined").when(distinct == 1, "rle").when((total < 16) & (distinct <= 4), "predefined").otherwise("fse")


def sparse_runs(spec: Column) -> Column:
    """``offset,size,offset,size...`` of a PAX sparse map as an array of structs."""
    numbers = F.transform(F.filter(F.split(spec, ","), lambda s: s != ""), lambda s: s.cast("bigint"))
    count = F.floor(F.size(numbers) / 2).cast("int")
    pair = lambda i: F.struct(F.element_at(numbers, i * 2 + 1).alias("offset"), F.element_at(numbers, i * 2 + 2).alias("length"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), pair)).otherwise(F.array().cast("array<struct<offset:bigint,length:bigint>>"))


def sparse_valid(runs: Column, real_size: Column) -> Column:
    """No empty run, no overlap, nothing beyond the real size."""
    ordered = F.array_sort(runs)
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(True).alias("ok"))
    step = lambda a, r: F.struct((r["offset"] + r["length"]).alias("end"), (a["ok"] & (r["length"] > 0) & (r["offset"] >= a["end"])).alias("ok"))
    return F.aggregate(ordered, start, step, lambda a: a["ok"] & (a["end"] <= real_size))


def tar_checksum(block: Column) -> Column:
    """Sum of the 512 header bytes with the checksum field as spaces."""
    value = lambda i: F.when(i.between(148, 155), 32).otherwise(byte_at(block, i))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(511)), value), F.lit(0).cast("bigint"), lambda a, v: a + v)


def tar_checksum_ok(block: Column) -> Column:
    from quarry.functions.times import octal

    return tar_checksum(block) == octal(F.decode(F.substring(block, 149, 8), "ISO-8859-1"))


def recovery_class(crc: Column, header_crc: Column, has_descriptor: Column) -> Column:
    """How sure a recovered payload is."""
    return F.when(has_descriptor & (header_crc == 0), "Recovered").when(crc == header_crc, "Verified").otherwise("Recovered")
