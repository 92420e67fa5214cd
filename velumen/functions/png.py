"""Reading PNG pixels: 1 to 16 bits a sample, grey, colour, palette and alpha, not interlaced."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Fixed values of the format: its first bytes, and samples a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and content of each chunk; a checksum that does not fit is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        yield kind, body
        at += 12 + n


def _unfiltered(raw: np.ndarray, height: int, line: int, step: int) -> np.ndarray:
    """Rows of bytes without their filters. step: bytes from a sample to the same one of the pixel before."""
    rows = raw[: height * (line + 1)].reshape(height, line + 1)
    out = np.zeros((height + 1, line + step), dtype=np.int64)  # a row above, and a pixel before, of zeros
    for y in range(height):
        kind, given, above, now = rows[y, 0], rows[y, 1:].astype(np.int64), out[y], out[y + 1]
        if kind in (0, 2):
            now[step:] = (given + (above[step:] if kind == 2 else 0)) & 255
        elif kind == 1:
            pad = -line % step
            sums = np.cumsum(np.pad(given, (0, pad)).reshape(-1, step), axis=0).ravel()
            now[step:] = sums[:line] & 255
        elif kind in (3, 4):
            for x in range(line):
                a, b, c = int(now[x]), int(above[x + step]), int(above[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(near - v))  # the first of equals, in this order
                now[x + step] = (int(given[x]) + guess) & 255
        else:
            raise ValueError(f"filter {kind} is unknown")
    return out[1:, step:].astype(np.uint8)


def pixels(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """(height x width x samples bytes, palette or None)."""
    head, palette, body = None, None, []
    for kind, content in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(content)
    if head is None:
        raise ValueError("no header")
    width, height, bits, colour, _, _, interlaced = head
    if interlaced or colour not in SAMPLES or not width or not height:
        raise ValueError("this kind of PNG is not read")
    n = SAMPLES[colour]
    line = -(-width * n * bits // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) < height * (line + 1):
        raise ValueError("pixels are missing")
    rows = _unfiltered(raw, height, line, max(1, n * bits // 8))
    if bits == 16:
        rows = rows[:, ::2]
    elif bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
        rows = (each[:, : width * n] * (1 if colour == 3 else 255 // ((1 << bits) - 1))).astype(np.uint8)
    return rows.reshape(height, width, n), palette
