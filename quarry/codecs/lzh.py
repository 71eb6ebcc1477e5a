"""The static-Huffman LZSS methods lh0 and lh4..lh7 of LHA archives (bits MSB first)."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa

from quarry.codecs.huffman import BitReader, BitWriter, bit_string, codes, quick_lengths as lengths, whole_bytes

# Fixed values by method: window bits, position symbols, bits of their count.
METHODS = {"lh0": (0, 0, 0), "lh4": (12, 14, 4), "lh5": (13, 14, 4), "lh6": (15, 16, 5), "lh7": (16, 17, 5)}
NC, NT, CBIT, TBIT, LEAST, MOST, BLOCK = 510, 19, 9, 5, 3, 256, 16384
PIECE, TOKEN = 65536, 64  # bytes that are held as bits, and more bits than a token has


class _Code:
    """A code read from a block: by lengths, or one symbol for all. Canonical codes of one length follow one
    another, so the next bits, taken as a number of ``most`` bits, tell a length by the range they are in."""

    def __init__(self, sizes: list[int] | None, lone: int = 0) -> None:
        self.lone, self.most = lone, max(sizes, default=0) if sizes else 0
        if sizes is None:
            self.starts = None
            return
        used = sorted((s, i) for i, s in enumerate(sizes) if s)
        self.starts, self.symbols, at = [], used, 0
        for size, _ in used:
            self.starts.append(at)
            at += 1 << self.most - size
        self.end = at

    def find(self, value: int) -> tuple[int, int]:
        """(length, symbol) of the next ``most`` bits."""
        if value >= self.end:
            raise ValueError("bad code")
        return self.symbols[bisect_right(self.starts, value) - 1]

    def read(self, bits: BitReader) -> int:
        if self.starts is None:
            return self.lone
        size, symbol = self.find(bits.peek(self.most))
        bits.read(size)
        return symbol

    def strings(self) -> dict[str, int]:
        """bits -> symbol."""
        return {f"{at >> self.most - size:0{size}b}": symbol for (size, symbol), at in zip(self.symbols, self.starts, strict=True)}


def _read_sizes(bits: BitReader, n: int, count_bits: int, special: int) -> _Code:
    count = bits.read(count_bits)
    if count == 0:
        return _Code(None, bits.read(count_bits))
    sizes: list[int] = []
    while len(sizes) < count:
        size = bits.read(3)
        if size == 7:
            while bits.read(1):
                size += 1
        sizes.append(size)
        if len(sizes) == special:
            sizes += [0] * bits.read(2)
    return _Code((sizes + [0] * n)[:n])


def _read_main(bits: BitReader, inner: _Code) -> _Code:
    count = bits.read(CBIT)
    if count == 0:
        return _Code(None, bits.read(CBIT))
    sizes: list[int] = []
    while len(sizes) < count:
        symbol = inner.read(bits)
        if symbol == 0:
            sizes.append(0)
        elif symbol == 1:
            sizes += [0] * (bits.read(4) + 3)
        elif symbol == 2:
            sizes += [0] * (bits.read(CBIT) + 20)
        else:
            sizes.append(symbol - 2)
    return _Code((sizes + [0] * NC)[:NC])


def decode(data: bytes, method: str, size: int, dictionary: bytes = b"") -> bytes:
    """size bytes; dictionary: bytes that stand in front of the window."""
    if method == "lh0":
        if len(data) < size:
            raise ValueError("data ends early")
        return data[:size]
    window, symbols, pbit = METHODS[method]
    bits, out = BitReader(data, True), bytearray(dictionary[-(1 << window) :])
    base, left = len(out), 0
    main = place = None
    low = at = end = 0  # text holds the bits from byte ``low`` on
    text = ""
    while len(out) - base < size:
        if left and at > end - TOKEN and low + PIECE < len(data):
            low, at = low + (at >> 3), at & 7
            text = bit_string(data[low : low + PIECE])
            end = len(text)
        if not left:
            bits.at = 8 * low + at
            left = bits.read(16)
            inner = _read_sizes(bits, NT, TBIT, 3)
            main = _read_main(bits, inner)
            place = _read_sizes(bits, symbols, pbit, -1)
            low, at = bits.at >> 3, bits.at & 7
            text = bit_string(data[low : low + PIECE])
            end = len(text)
            if not left:
                raise ValueError("empty block")
            known = {} if main.starts is None else main.strings()
            shortest = min(map(len, known), default=0)
        left -= 1
        if main.starts is None:
            c = main.lone
        else:
            n = shortest
            while (c := known.get(text[at : at + n])) is None:
                n += 1
                if n > main.most:
                    raise EOFError("bits after the end") if at + n > end else ValueError("bad code")
            at += n
        if at > end:
            raise EOFError("bits after the end")
        if c < 256:
            out.append(c)
            continue
        n = c - 256 + LEAST
        if place.starts is None:
            p = place.lone
        else:
            width, p = place.find(int(text[at : at + place.most].ljust(place.most, "0"), 2))
            at += width
        if p < 2:
            distance = p + 1
        else:
            if at + p - 1 > end:
                raise EOFError("bits after the end")
            distance = (1 << (p - 1)) + int(text[at : at + p - 1], 2) + 1
            at += p - 1
        if at > end:
            raise EOFError("bits after the end")
        start = len(out) - distance
        if start < 0:  # the window starts as spaces
            out += b" " * min(n, -start)
            n -= min(n, -start)
            start = len(out) - distance
        if distance >= n:
            out += out[start : start + n]
        else:
            out += (bytes(out[start:]) * (n // distance + 1))[:n]
    return bytes(out[base : base + size])


#: Values that are decoded side by side; bits of the tables of symbols and places; steps that still pay for few.
LANES, MAIN_BITS, PLACE_BITS, FEW, LONG = 1024, 13, 9, 8, 1 << 16
_BAD = 31 << 9  # in a table: no code begins like that


def _table(code: _Code, width: int) -> np.ndarray | None:
    """length << 9 | symbol for the next ``width`` bits; None where codes are longer."""
    if code.starts is None:
        return np.full(1 << width, code.lone, np.uint16)
    if code.most > width or not code.symbols:
        return None
    sizes, symbols = np.array(code.symbols, np.int64).T
    out = np.repeat((sizes << 9 | symbols).astype(np.uint16), 1 << width - sizes)
    return out if len(out) == 1 << width else np.concatenate([out, np.full(max(0, (1 << width) - len(out)), _BAD, np.uint16)])[: 1 << width]


def _block_head(data: bytes, symbols: int, pbit: int) -> tuple[int, _Code, _Code, int]:
    """(tokens, main code, place code, bits in all) of the block that data begins with, cut from a bit string."""
    text = bit_string(data[:512])
    number = lambda at, n: int(text[at : at + n], 2)

    def sizes_at(at: int, n: int, count_bits: int, special: int) -> tuple[_Code, int]:
        count, at = number(at, count_bits), at + count_bits
        if count == 0:
            return _Code(None, number(at, count_bits)), at + count_bits
        sizes: list[int] = []
        while len(sizes) < count:
            size, at = number(at, 3), at + 3
            if size == 7:
                end = text.index("0", at)
                size, at = size + end - at, end + 1
            sizes.append(size)
            if len(sizes) == special:
                sizes += [0] * number(at, 2)
                at += 2
        return _Code((sizes + [0] * n)[:n]), at

    left = number(0, 16)
    inner, at = sizes_at(16, NT, TBIT, 3)
    count, at = number(at, CBIT), at + CBIT
    if count == 0:
        main, at = _Code(None, number(at, CBIT)), at + CBIT
    else:
        known = {"": inner.lone} if inner.starts is None else inner.strings()
        shortest = min(map(len, known))
        sizes: list[int] = []
        while len(sizes) < count:
            n = shortest
            while (symbol := known.get(text[at : at + n])) is None:
                n += 1
                if n > inner.most:
                    raise ValueError("bad code")
            at += n
            if symbol > 2:
                sizes.append(symbol - 2)
            elif symbol == 0:
                sizes.append(0)
            elif symbol == 1:
                sizes += [0] * (number(at, 4) + 3)
                at += 4
            else:
                sizes += [0] * (number(at, CBIT) + 20)
                at += CBIT
        main = _Code((sizes + [0] * NC)[:NC])
    place, at = sizes_at(at, symbols, pbit, -1)
    if at > len(text):
        raise EOFError("bits after the end")
    return left, main, place, at


def decode_many(values: list[bytes], method: str, sizes: list[int]) -> list[bytes]:
    """As decode() of each. Values of one block are read side by side: the first token of all, then the second.
    Any other value, and any that is damaged, goes through decode(), which says what is wrong."""
    out: list[bytes | None] = [None] * len(values)
    if method != "lh0":
        window, symbols, pbit = METHODS[method]
        fit = [i for i, v in enumerate(values) if v and 0 < sizes[i] <= LONG and len(v) <= LONG]
        for at in range(0, len(fit), LANES):
            if len(fit) - at >= FEW:
                _side_by_side(values, sizes, fit[at : at + LANES], symbols, pbit, out)
    return [decode(v, method, n) if made is None else made for v, n, made in zip(values, sizes, out, strict=True)]


def _side_by_side(values: list[bytes], sizes: list[int], chosen: list[int], symbols: int, pbit: int, out: list[bytes | None]) -> None:
    lanes = []
    for i in chosen:
        try:
            left, main, place, begin = _block_head(values[i], symbols, pbit)
            tables = _table(main, MAIN_BITS), _table(place, PLACE_BITS)
        except Exception:  # decode() meets the same, and says it
            continue
        if left and tables[0] is not None and tables[1] is not None:
            lanes.append((left, i, begin, *tables))
    if len(lanes) < FEW:
        return
    lanes.sort(key=lambda x: -x[0])
    lefts = np.array([x[0] for x in lanes], np.int64)
    # the few with most tokens are not worth their steps
    steps = int(lefts[FEW - 1])
    counts = np.searchsorted(-lefts, -np.arange(steps)).tolist()
    starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    begins, at = [], 0
    for x in lanes:
        begins.append(at)
        at += len(values[x[1]])
    data = np.frombuffer(b"".join(values[x[1]] for x in lanes) + bytes(16 + 8 * steps), np.uint8)
    words = np.zeros(len(data) - 8, np.uint64)  # the 64 bits from each byte on
    for k in range(8):
        words |= data[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    main_table, place_table = np.concatenate([x[3] for x in lanes]), np.concatenate([x[4] for x in lanes])
    main_at, place_at = np.arange(len(lanes)) << MAIN_BITS, np.arange(len(lanes)) << PLACE_BITS
    pos = np.array(begins, np.int64) * 8 + np.array([x[2] for x in lanes])
    code, distance = np.empty(int(starts[-1]), np.int16), np.zeros(int(starts[-1]), np.int32)
    last, bad, seven = len(words) - 1, np.zeros(len(lanes), bool), np.int64(7)
    to_main, to_place, one, most = np.uint64(64 - MAIN_BITS), np.uint64(64 - PLACE_BITS), np.uint64(1), np.uint64(63)
    at = 0
    for k in counts:
        here = pos[:k]
        word = words[np.minimum(here >> 3, last)] << (here & seven).astype(np.uint64)
        entry = main_table[main_at[:k] + (word >> to_main).astype(np.int64)]
        symbol = entry & 511
        size = entry >> 9
        code[at : at + k] = symbol
        here += size  # in place: pos moves on
        match = np.flatnonzero((symbol > 255) | (size == 31))
        if match.size:
            used = size[match].astype(np.uint64)
            word = word[match] << used
            entry = place_table[place_at[match] + (word >> to_place).astype(np.int64)]
            n, p = entry >> 9, (entry & 511).astype(np.int64)
            wrong = (used == 31) | (n == 31)
            if wrong.any():
                bad[match[wrong]] = True
                p[wrong] = 0
            extra = np.maximum(p - 1, 0)
            more = (word << n.astype(np.uint64) >> one) >> (most - extra.astype(np.uint64))
            distance[at + match] = ((p > 0).astype(np.int64) << extra) + more.astype(np.int64) + 1
            pos[match] += n + extra
        at += k
    for lane, (left, i, *_) in enumerate(lanes):
        if left > steps or bad[lane] or pos[lane] > 8 * (begins[lane] + len(values[i])):
            continue
        mine = starts[:left] + lane
        out[i] = _unfolded(code[mine], distance[mine], sizes[i])


def _unfolded(code: np.ndarray, distance: np.ndarray, size: int) -> bytes | None:
    """The bytes of tokens; None where they are not ``size`` or reach before the first."""
    match = np.flatnonzero(code > 255)
    literals = code[code < 256].astype(np.uint8).tobytes()
    out, before = bytearray(), 0
    for cut, n, back in zip((match - np.arange(len(match))).tolist(), (code[match] - (256 - LEAST)).tolist(), distance[match].tolist(), strict=True):
        out += literals[before:cut]
        before = cut
        start = len(out) - back
        if start < 0:
            return None
        out += out[start : start + n] if back >= n else (bytes(out[start:]) * (n // back + 1))[:n]
    out += literals[before:]
    return bytes(out) if len(out) == size else None


def _tokens(data: bytes, window: int, dictionary: bytes, depth: int = 16) -> list[tuple[int, int]]:
    """(literal or 256 + length - 3, distance - 1)."""
    base = dictionary[-(1 << window) :]
    whole, chains, out = base + data, {}, []
    for i in range(max(0, len(base) - 2)):
        chains.setdefault(whole[i : i + 3], []).append(i)
    at = len(base)
    while at < len(whole):
        best = where = 0
        key = whole[at : at + 3]
        most = min(MOST, len(whole) - at)
        for j in chains.get(key, ())[: -depth - 1 : -1]:
            if at - j > 1 << window or best == most:
                break
            if best and whole[j + best] != whole[at + best]:
                continue  # no longer than the best so far
            n = 3
            while n < most and whole[j + n] == whole[at + n]:
                n += 1
            if n > best:
                best, where = n, at - j
        step = best if best >= LEAST else 1
        out.append((best - LEAST + 256, where - 1) if step > 1 else (whole[at], 0))
        for i in range(at, at + step):
            if i + 3 <= len(whole):
                chains.setdefault(whole[i : i + 3], []).append(i)
        at += step
    return out


def _write_sizes(out: BitWriter, sizes: list[int], count_bits: int, special: int) -> None:
    n = len(sizes)
    while n and not sizes[n - 1]:
        n -= 1
    out.write(n, count_bits)
    i = 0
    while i < n:
        size = sizes[i]
        i += 1
        if size <= 6:
            out.write(size, 3)
        else:
            out.write((1 << (size - 3)) - 2, size - 3)
        if i == special:
            skip = 0
            while skip < 3 and i + skip < n and not sizes[i + skip]:
                skip += 1
            out.write(skip, 2)
            i += skip


def _runs(sizes: list[int]) -> list[tuple[int, int, int]]:
    """Main code lengths as (symbol, extra, extra bits)."""
    n = len(sizes)
    while n and not sizes[n - 1]:
        n -= 1
    out, i = [], 0
    while i < n:
        if sizes[i]:
            out.append((sizes[i] + 2, 0, 0))
            i += 1
            continue
        run = 0
        while i + run < n and not sizes[i + run]:
            run += 1
        i += run
        while run:
            if run < 3 or run == 19:
                out.append((0, 0, 0))
                run -= 1
            elif run < 19:
                out.append((1, run - 3, 4))
                run = 0
            else:
                take = min(run, 20 + 511)
                out.append((2, take - 20, CBIT))
                run -= take
    return out


#: Finds matches of four bytes and more in the last 64 KB, in compiled code.
_FINDER = pa.Codec("lz4_raw", compression_level=9)


def _found(data: bytes, window: int) -> tuple[bytes, list[int], list[int], list[int]] | None:
    """(all literals, how many of them stand before each match, lengths of the matches, distances), from a block of
    LZ4's high compression. None where its matches may lie too far back for the window."""
    if len(data) > min(1 << window, 65535) * 5 // 4:
        return None
    packed, at, far, plain = _FINDER.compress(data, asbytes=True), 0, 1 << window, 0
    literals, cuts, sizes, distances, whole, held = [], [], [], [], len(packed), 0
    while True:
        token = packed[at]
        at += 1
        n = token >> 4
        if n == 15:
            while packed[at] == 255:
                n += 255
                at += 1
            n += packed[at]
            at += 1
        if n:
            literals.append(packed[at : at + n])
            at += n
            held += n
        if at >= whole:
            return b"".join(literals), cuts, sizes, distances
        distance = packed[at] | packed[at + 1] << 8
        at += 2
        size = token & 15
        if size == 15:
            while packed[at] == 255:
                size += 255
                at += 1
            size += packed[at]
            at += 1
        size += 4
        plain += n + size
        if distance > far:
            literals.append(data[plain - size : plain])
            held += size
            continue
        while size > MOST:  # no rest that is shorter than a match can be
            take = MOST if size - MOST >= LEAST else size - LEAST
            cuts.append(held)
            sizes.append(take)
            distances.append(distance)
            size -= take
        cuts.append(held)
        sizes.append(size)
        distances.append(distance)


def _heading(n_tokens: int, main_count: list[int], place_count: list[int], pbit: int) -> tuple[str, list[int], list[int]]:
    """A block's head as bits, and the code lengths of its symbols and places (none where there is one only)."""
    head = BitWriter(True)
    head.write(n_tokens, 16)
    main = lengths(main_count, 16)
    if main_count.count(0) == NC - 1:
        head.write(0, TBIT)
        head.write(0, TBIT)
        head.write(0, CBIT)
        head.write(next(i for i, f in enumerate(main_count) if f), CBIT)
        main = [0] * NC
    else:
        runs = _runs(main)
        inner_count = [0] * NT
        for s, _, _ in runs:
            inner_count[s] += 1
        inner = lengths(inner_count, 16)
        if sum(f > 0 for f in inner_count) == 1:
            head.write(0, TBIT)
            head.write(next(i for i, f in enumerate(inner_count) if f), TBIT)
            inner = [0] * NT
        else:
            _write_sizes(head, inner, TBIT, 3)
        inner_codes = codes(inner)
        n = NC
        while n and not main[n - 1]:
            n -= 1
        head.write(n, CBIT)
        for s, extra, width in runs:
            head.write(inner_codes[s] << width | extra, inner[s] + width)
    places = lengths(place_count, 16)
    if sum(f > 0 for f in place_count) < 2:
        head.write(0, pbit)
        head.write(next((i for i, f in enumerate(place_count) if f), 0), pbit)
        places = [0] * len(place_count)
    else:
        _write_sizes(head, places, pbit, -1)
    return bit_string(bytes(head.out)) + (f"{head.value:0{head.count}b}" if head.count else ""), main, places


def _one_block(literals: bytes, cuts: list[int], sizes: list[int], distances: list[int], symbols: int, pbit: int) -> bytes:
    """The block of such tokens: each is a number of some bits, and all bits are laid out at once."""
    match = np.array(cuts, np.int64) + np.arange(len(cuts))
    symbol = np.empty(len(literals) + len(cuts), np.int64)
    rest = np.ones(len(symbol), bool)
    rest[match] = False
    symbol[rest] = np.frombuffer(literals, np.uint8)
    symbol[match] = np.array(sizes, np.int64) + (256 - LEAST)
    back = np.array(distances, np.int64) - 1
    place = np.frexp(back.astype(np.float64))[1].astype(np.int64)  # bits of the number
    head, main, places = _heading(len(symbol), np.bincount(symbol, minlength=NC).tolist(), np.bincount(place, minlength=symbols).tolist(), pbit)
    value, width = np.array(codes(main), np.int64)[symbol], np.array(main, np.int64)[symbol]
    extra, size = np.maximum(place - 1, 0), np.array(places, np.int64)[place]
    value[match] = (value[match] << size | np.array(codes(places), np.int64)[place]) << extra | back & (1 << extra) - 1
    width[match] += size + extra
    end = np.cumsum(width)
    bits = np.repeat(value, width) >> np.repeat(end - 1, width) - np.arange(int(end[-1])) & 1
    return np.packbits(np.concatenate([np.frombuffer(head.encode(), np.uint8) - 48, bits.astype(np.uint8)])).tobytes()


def encode(data: bytes, method: str = "lh5", dictionary: bytes = b"") -> bytes:
    if method == "lh0":
        return data
    window, symbols, pbit = METHODS[method]
    if 0 < len(data) <= BLOCK and not dictionary and (found := _found(data, window)) is not None:
        return _one_block(*found, symbols, pbit)
    tokens, out, rest = _tokens(data, window, dictionary), bytearray(), ""
    for at in range(0, len(tokens), BLOCK):
        block = tokens[at : at + BLOCK]
        place = [0 if d == 0 else d.bit_length() for _, d in block]
        main_count, place_count = [0] * NC, [0] * symbols
        for (c, _), p in zip(block, place, strict=True):
            main_count[c] += 1
            if c > 255:
                place_count[p] += 1
        head, main, places = _heading(len(block), main_count, place_count, pbit)
        main_codes, place_codes = ([f"{c:0{n}b}" if n else "" for c, n in zip(codes(x), x, strict=True)] for x in (main, places))
        parts = [rest, head]
        for (c, d), p in zip(block, place, strict=True):
            parts.append(main_codes[c])
            if c > 255:
                parts.append(place_codes[p])
                if p > 1:
                    parts.append(f"{d:b}"[1:])  # p bits, the first of which is 1
        done, rest = whole_bytes("".join(parts))
        out += done
    return bytes(out) + whole_bytes(rest.ljust(8, "0"))[0] if rest else bytes(out)
