"""Checking passwords against Argon2 hashes (RFC 9106), in the usual text form $argon2id$v=19$m=...,t=...,p=...$salt$hash.

A block of 1024 bytes is a matrix of 8 x 16 words; a round runs over all its rows, then over all its columns at once. A check
at the usual cost takes some seconds: it is for single logins, on the driver, and never runs over rows of a table.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import struct

import numpy as np

VERSION = 0x13
#: Variants by name, and slices of a pass.
KINDS = {"argon2d": 0, "argon2i": 1, "argon2id": 2}
SLICES = 4
_LOW = np.uint64(0xFFFFFFFF)


def _long_hash(size: int, data: bytes) -> bytes:
    data = struct.pack("<I", size) + data
    if size <= 64:
        return hashlib.blake2b(data, digest_size=size).digest()
    out, v = b"", hashlib.blake2b(data).digest()
    while size - len(out) > 64:
        out += v[:32]
        left = size - len(out)
        v = hashlib.blake2b(v, digest_size=min(64, left)).digest()
    return out + v


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b + ((a & _LOW) * (b & _LOW) << np.uint64(1))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint64(n)) | (x << np.uint64(64 - n))


def _quarter(a, b, c, d):
    a = _times(a, b)
    d = _turned(d ^ a, 32)
    c = _times(c, d)
    b = _turned(b ^ c, 24)
    a = _times(a, b)
    d = _turned(d ^ a, 16)
    c = _times(c, d)
    b = _turned(b ^ c, 63)
    return a, b, c, d


def _round(v: np.ndarray) -> np.ndarray:
    """One round over columns of sixteen words: all four quarters at once, then those on the diagonals."""
    a, b, c, d = _quarter(v[0:4], v[4:8], v[8:12], v[12:16])
    a, b, c, d = _quarter(a, b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]])
    return np.concatenate([a, b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]])


def _compress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    r = x ^ y
    rows = _round(r.reshape(8, 16).T).T
    columns = _round(rows.reshape(8, 8, 2).transpose(0, 2, 1).reshape(16, 8))
    return columns.reshape(8, 2, 8).transpose(0, 2, 1).reshape(128) ^ r


def digest(kind: str, password: bytes, salt: bytes, *, memory: int, passes: int, lanes: int, size: int, secret: bytes = b"", data: bytes = b"") -> bytes:
    """The tag of a password; memory in blocks of 1024 bytes."""
    y, part = KINDS[kind], lambda b: struct.pack("<I", len(b)) + b
    seed = hashlib.blake2b(struct.pack("<6I", lanes, size, memory, passes, VERSION, y) + part(password) + part(salt) + part(secret) + part(data)).digest()
    segment = memory // (SLICES * lanes)
    if segment < 2:
        raise ValueError("eight blocks a lane are needed at least")
    length = SLICES * segment
    block = np.zeros((lanes, length, 128), dtype=np.uint64)
    for lane in range(lanes):
        for j in range(2):
            block[lane, j] = np.frombuffer(_long_hash(1024, seed + struct.pack("<2I", j, lane)), dtype="<u8")
    zero = np.zeros(128, dtype=np.uint64)
    for turn in range(passes):
        for slice_ in range(SLICES):
            fixed = y == 1 or (y == 2 and turn == 0 and slice_ < 2)
            for lane in range(lanes):
                places = None
                for index in range(2 if turn == 0 and slice_ == 0 else 0, segment):
                    at = slice_ * segment + index
                    before = block[lane, at - 1]  # of the first block, the last of the lane
                    if fixed:
                        if places is None or index % 128 == 0:
                            head = np.zeros(128, dtype=np.uint64)
                            head[:7] = turn, lane, slice_, length * lanes, passes, y, index // 128 + 1
                            places = _compress(zero, _compress(zero, head))
                        word = int(places[index % 128])
                    else:
                        word = int(before[0])
                    other = lane if turn == 0 and slice_ == 0 else (word >> 32) % lanes
                    have = slice_ * segment if turn == 0 else length - segment
                    area = have + index - 1 if other == lane else have - (index == 0)
                    far = area - 1 - (area * ((word & 0xFFFFFFFF) ** 2 >> 32) >> 32)
                    start = 0 if turn == 0 or slice_ == SLICES - 1 else (slice_ + 1) * segment
                    new = _compress(before, block[other, (start + far) % length])
                    block[lane, at] = new if turn == 0 else new ^ block[lane, at]
    return _long_hash(size, np.bitwise_xor.reduce(block[:, -1]).astype("<u8").tobytes())


def _bytes(text: str) -> bytes:
    return base64.b64decode(text + "=" * (-len(text) % 4))


def verify(stored: str, password: str) -> bool:
    """Whether a password has the stored hash; anything that is not such a hash has no password."""
    try:
        _, kind, version, costs, salt, tag = stored.split("$")
        cost = {k: int(v) for k, v in (x.split("=") for x in costs.split(","))}
        if kind not in KINDS or version != f"v={VERSION}":
            return False
        salt, tag = _bytes(salt), _bytes(tag)
        got = digest(kind, password.encode(), salt, memory=cost["m"], passes=cost["t"], lanes=cost["p"], size=len(tag))
    except (ValueError, KeyError):
        return False
    return hmac.compare_digest(got, tag)


def encoded(kind: str, password: str, salt: bytes, *, memory: int, passes: int, lanes: int, size: int = 32) -> str:
    plain = lambda b: base64.b64encode(b).decode().rstrip("=")
    tag = digest(kind, password.encode(), salt, memory=memory, passes=passes, lanes=lanes, size=size)
    return f"${kind}$v={VERSION}$m={memory},t={passes},p={lanes}${plain(salt)}${plain(tag)}"
