"""Word and n-gram fingerprints of whole texts, computed for a block of documents at a time with numpy.

Words are maximal runs of bytes other than space and the controls 9 to 13. Those bytes never occur inside a
multi-byte UTF-8 character, so splitting the encoded text is the same as splitting the characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once; a longer single text is a block of its own.
BLOCK = 2 << 20

U = np.uint64
_ODD = U(0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All bytes but ASCII letters and those of multi-byte characters.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer words are hashed one by one.
LONG = 64
#: Bits of the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def blocks(text: pa.Array, size: int = BLOCK, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of each row's bytes) of consecutive rows; null is empty text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_binary()) if not pa.types.is_large_binary(text.type) else text
    if text.null_count:
        text = text.fill_null(b"")
    n = len(text)
    if not n:
        return
    off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1))
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def spans(data: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a block, and the offsets of each row's words. between: bytes that part words."""
    ink = ~between[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes.

    Eight bytes at a time are mixed into a state that begins with the word's length; nothing about it is linear, and
    words of up to eight bytes have a fingerprint of their own among words of their length.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _ODD)
    if not len(out):
        return out
    wide = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    rows = None  # of words that go on
    for k in range(0, LONG, 8):
        at, left = (starts, size) if rows is None else (starts[rows] + k, size[rows] - k)
        chunk = wide[at] & _FIRST[np.minimum(left, 8)]
        out[slice(None) if rows is None else rows] = mix((out if rows is None else out[rows]) ^ chunk)
        rows = np.flatnonzero((size > k + 8) & (size <= LONG)) if rows is None else rows[left > 8]
        if not len(rows):
            break
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A fingerprint of the k values from each place; places whose k values would pass the end are left out.

    Fingerprints of 1, 2, 4, ... values are mixed from two halves, and those that make up k are mixed together.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, at, level, width = None, 0, h, 1
    while True:
        if k & width:
            part = level[at : at + n]
            out = part if out is None else mix(out * _ODD + part)
            at += width
        if 2 * width > k:
            return mix(out + U(k))
        level = mix(level[:-width] * _ODD + level[width:])
        width *= 2


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys in batches that are sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        key = np.stack([t.column(c).to_numpy() for c in names])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        done = 0
        for cut in cuts:
            yield t.slice(done, int(cut) - done)
            done = int(cut)
        held = t.slice(done)
    if held is not None and held.num_rows:
        yield held
