"""Archive encryption: ZipCrypto, and WinZip AES with 128, 192 and 256-bit keys."""

from __future__ import annotations

import hashlib
import hmac
import secrets
import zlib

import numpy as np

_POLY = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _POLY = np.where(_POLY & 1, _POLY >> 1 ^ np.uint32(0xEDB88320), _POLY >> 1)
_CRC = _POLY.tolist()


class ZipCrypto:
    """Three keys that each plain byte moves on."""

    def __init__(self, password: bytes) -> None:
        self.keys = [0x12345678, 0x23456789, 0x34567890]
        for b in password:
            self._move(b)

    def _move(self, b: int) -> None:
        a, c, d = self.keys
        a = _CRC[(a ^ b) & 255] ^ a >> 8
        c = ((c + (a & 255)) * 134775813 + 1) & 0xFFFFFFFF
        d = _CRC[(d ^ c >> 24) & 255] ^ d >> 8
        self.keys = [a, c, d]

    def _stream(self) -> int:
        t = self.keys[2] & 0xFFFF | 2
        return t * (t ^ 1) >> 8 & 255

    def decrypt(self, data: bytes) -> bytes:
        out = bytearray()
        for b in data:
            b ^= self._stream()
            self._move(b)
            out.append(b)
        return bytes(out)

    def encrypt(self, data: bytes) -> bytes:
        out = bytearray()
        for b in data:
            out.append(b ^ self._stream())
            self._move(b)
        return bytes(out)


_CRC32 = np.array(_CRC, np.uint32)
#: What the low 16 bits of the third key give for the next byte.
_STREAM = np.array([(t := k | 2) * (t ^ 1) >> 8 & 255 for k in range(1 << 16)], np.uint8)
FEW = 24  # values that are faster one by one than in lanes


def zipcrypto_many(values: list[bytes], password: bytes, encrypt: bool) -> list[bytes]:
    """ZipCrypto over many values at once: the first byte of all, then the second, and so on. The longest come
    first, so that those that go on are always in front; the last few end one by one."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order], np.int64)
    steps = int(sizes[FEW - 1]) if len(order) >= FEW else 0
    counts = np.searchsorted(-sizes, -np.arange(steps)).tolist()  # how many values are longer than that
    starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)
    flat = np.empty(int(starts[-1]), np.uint8)
    for lane, i in enumerate(order):
        n = min(steps, len(values[i]))
        flat[starts[:n] + lane] = np.frombuffer(values[i], np.uint8, n)
    a, c, d = (np.full(len(order), k, np.uint32) for k in ZipCrypto(password).keys)
    at = 0
    for k in counts:
        a, c, d = a[:k], c[:k], d[:k]
        given = flat[at : at + k]
        made = given ^ _STREAM[d.astype(np.uint16)]
        a = _CRC32[a.astype(np.uint8) ^ (given if encrypt else made)] ^ a >> 8
        c = (c + (a & 255)) * np.uint32(134775813) + np.uint32(1)
        d = _CRC32[d.astype(np.uint8) ^ (c >> 24).astype(np.uint8)] ^ d >> 8
        flat[at : at + k] = made
        at += k
    out: list[bytes] = [b""] * len(values)
    for lane, i in enumerate(order):
        n = min(steps, len(values[i]))
        out[i] = flat[starts[:n] + lane].tobytes()
        if n < len(values[i]):
            rest = ZipCrypto(password)
            if n:
                rest.keys = [int(x[lane]) for x in (a, c, d)]
            out[i] += (rest.encrypt if encrypt else rest.decrypt)(values[i][n:])
    return out


def zipcrypto_encrypt(data: bytes, password: bytes, check: int) -> bytes:
    """12 random bytes, the last of which is the check, in front of the data."""
    return ZipCrypto(password).encrypt(secrets.token_bytes(11) + bytes([check & 255]) + data)


def zipcrypto_decrypt(data: bytes, password: bytes, check: int) -> bytes:
    """check: high byte of the CRC-32, or of the DOS time where a descriptor follows."""
    plain = ZipCrypto(password).decrypt(data)
    if len(plain) < 12 or plain[11] != check & 255:
        raise PermissionError("wrong password")
    return plain[12:]


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _sbox() -> list[int]:
    """The AES S-box from its definition: inverse in GF(2^8), then the affine map."""
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(x for x in range(1, 256) if _times(a, x) == 1)
            inverse[a], inverse[b] = b, a
    rot = lambda x, n: (x << n | x >> (8 - n)) & 255
    return [x ^ rot(x, 1) ^ rot(x, 2) ^ rot(x, 3) ^ rot(x, 4) ^ 0x63 for x in inverse]


SBOX = _sbox()
_S = np.array(SBOX, np.uint8)
_SHIFT = np.array([0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11])
# S-box and MixColumns in one: what byte x at place k of a column adds to that column
_COLUMN = [np.array([[_times(SBOX[x], m) for m in np.roll((2, 1, 1, 3), k).tolist()] for x in range(256)], np.uint8).view(np.uint32).reshape(-1) for k in range(4)]


def expand_key(key: bytes) -> np.ndarray:
    """Round keys, a row of 16 bytes each."""
    n = len(key) // 4
    if len(key) not in (16, 24, 32):
        raise ValueError("AES keys have 16, 24 or 32 bytes")
    words, r = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)], 1
    through = lambda t: SBOX[t >> 24] << 24 | SBOX[t >> 16 & 255] << 16 | SBOX[t >> 8 & 255] << 8 | SBOX[t & 255]
    for i in range(n, 4 * (n + 7)):
        t = words[-1]
        if i % n == 0:
            t = through((t << 8 | t >> 24) & 0xFFFFFFFF) ^ r << 24
            r = _times(r, 2)
        elif n > 6 and i % n == 4:
            t = through(t)
        words.append(words[i - n] ^ t)
    return np.array(words, ">u4").view(np.uint8).reshape(-1, 16)


def aes_blocks(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """ECB encryption of many blocks (n x 16) at once."""
    x = blocks ^ keys[0]
    for key in keys[1:-1]:
        column = _COLUMN[0].take(x.take(_SHIFT[::4], 1))
        for k in (1, 2, 3):
            column ^= _COLUMN[k].take(x.take(_SHIFT[k::4], 1))
        x = column.view(np.uint8) ^ key
    return _S.take(x.take(_SHIFT, 1)) ^ keys[-1]


def aes_ctr(data: bytes, key: bytes) -> bytes:
    """CTR with a little-endian counter from 1 on, as WinZip has it."""
    n = -(-len(data) // 16)
    if not n:
        return b""
    counter = np.zeros((n, 16), np.uint8)
    counter[:, :8] = np.arange(1, n + 1, dtype="<u8").view(np.uint8).reshape(n, 8)
    stream = aes_blocks(counter, expand_key(key)).ravel()[: len(data)]
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


KEY_BYTES = {1: 16, 2: 24, 3: 32}


def _derive(password: bytes, salt: bytes, strength: int) -> tuple[bytes, bytes, bytes]:
    n = KEY_BYTES[strength]
    made = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * n + 2)
    return made[:n], made[n : 2 * n], made[2 * n :]


def ae2_encrypt(data: bytes, password: bytes, strength: int = 3, salt: bytes | None = None) -> bytes:
    """salt, verifier, encrypted data, ten bytes of authentication."""
    salt = secrets.token_bytes(KEY_BYTES[strength] // 2) if salt is None else salt
    key, auth, verifier = _derive(password, salt, strength)
    body = aes_ctr(data, key)
    return salt + verifier + body + hmac.new(auth, body, hashlib.sha1).digest()[:10]


def ae2_decrypt(data: bytes, password: bytes, strength: int) -> bytes:
    n = KEY_BYTES[strength] // 2
    if len(data) < n + 12:
        raise ValueError("encrypted data is too short")
    key, auth, verifier = _derive(password, data[:n], strength)
    body = data[n + 2 : -10]
    if not hmac.compare_digest(verifier, data[n : n + 2]):
        raise PermissionError("wrong password")
    if not hmac.compare_digest(hmac.new(auth, body, hashlib.sha1).digest()[:10], data[-10:]):
        raise ValueError("authentication failed")
    return aes_ctr(body, key)


def hmac_sha1(key: bytes, message: bytes) -> bytes:
    return hmac.new(key, message, hashlib.sha1).digest()


def pbkdf2_sha1(password: bytes, salt: bytes, iterations: int, size: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha1", password, salt, iterations, size)


def crc_check_byte(data: bytes) -> int:
    return zlib.crc32(data) >> 24
