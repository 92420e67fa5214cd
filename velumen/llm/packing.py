"""Sequence packing as vector bin packing with the dot-product heuristic.

Each task tokenises its documents and packs them while it reads, so no text is shuffled. A document's full
sequences stand alone; its remainder waits in a bounded pool. For the open sequence the piece that fits and has the
largest product of demand and free room over three dimensions (tokens, segments, loss-bearing tokens) goes in next;
when nothing fits, the longest waiting piece is cut to fill the room. A sequence that a limit or the end of the
input stops short is cut back to a power of two, which needs no padding, and the rest is packed on.

Defined results: null text is empty text and gives the end id alone; a null id is carried; repeated rows are packed
as often as they occur; an empty table gives no rows; other columns are ignored; a tokenizer whose words depend on the
white space around them is an error. Memory holds the pool, one Arrow
batch and the memo, each of bounded size.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

#: Words whose letters and trailing signs the tokenizer splits apart before merging, in characters that lower-case
#: one to one and that normalisation leaves alone. All other words go through the whole tokenizer.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """Token ids of a word as little-endian 32-bit integers; forgets everything when it is full."""

    def __init__(self, path: str, words: int = 700_000, parts: int = 700_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = False
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ids = lambda text: self.whole.encode(text, add_special_tokens=False).ids
        for probe in ("a b", " Word,\tand\n\nmore  words. ", "é ü\r\n中 文 x9"):
            if ids(probe) != [i for word in probe.split() for i in ids(word)]:
                raise ValueError(f"{path}: words are not independent of the white space around them")
        self.parts: dict[str, bytes] = {}
        self.most = (words, parts)
        self.cased = self.whole.encode("A", add_special_tokens=False).ids != self.whole.encode("a", add_special_tokens=False).ids
        self.split = not self.cased and self.whole.encode("ab.,", add_special_tokens=False).ids == [
            i for x in ("ab", ".,") for i in self.whole.encode(x, add_special_tokens=False).ids
        ]

    def part(self, s: str) -> bytes:
        found = self.parts.get(s)
        if found is None:
            if len(self.parts) >= self.most[1]:
                self.parts.clear()
            mapped = s if s.isascii() else self.bytes.pre_tokenize_str(s)[0][0]
            found = self.parts[s] = packed([t.id for t in self.whole.model.tokenize(mapped)])
        return found

    def __missing__(self, word: bytes) -> bytes:
        s = word.decode()
        plain = _PLAIN.fullmatch(s) if self.split and len(s) < 64 else None
        if plain:
            ids = self.part(plain[1].lower())
            if plain[2]:
                ids += self.part(plain[2])
        else:
            ids = packed(self.whole.encode(s, add_special_tokens=False).ids)
        if len(word) < 64:
            if len(self) >= self.most[0]:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """Ids of a whole text: the tokenizer drops white space, so words split at ASCII white space are independent."""
        return b"".join(map(self.__getitem__, text.split()))


_memos: dict[str, Memo] = {}


def memo(path: str | None) -> Memo:
    """This worker's memo. path None: the public word-level vocabulary."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _memos:
        _memos[path] = Memo(path)
    return _memos[path]


class Packer:
    """Fills sequences from a pool of waiting pieces; rows of finished sequences gather in self.rows."""

    def __init__(self, first: int, capacity: int = 2048, segments: int = 128, loss: int = 2048, pool: int = 256):
        self.room = np.array([capacity, segments, loss], dtype=np.float64)
        self.capacity, self.most = capacity, pool
        self.next = first
        self.pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens, loss_from)
        self.need = np.zeros((4 * pool, 3))  # demands of self.pool, row by row
        self.rows: list[list] = [[] for _ in range(7)]

    def demand(self, start: int, n: int, loss_from: int) -> tuple[int, int, int]:
        return n, 1, max(0, start + n - max(start, loss_from))

    def wait(self, piece: tuple) -> None:
        if len(self.pool) == len(self.need):
            self.need = np.vstack([self.need, np.zeros_like(self.need)])
        self.need[len(self.pool)] = self.demand(piece[1], len(piece[2]) // 4, piece[4])
        self.pool.append(piece)

    def take(self, i: int) -> tuple:
        piece, last = self.pool[i], len(self.pool) - 1
        self.pool[i] = self.pool[last]
        self.need[i] = self.need[last]
        self.pool.pop()
        return piece

    def add(self, doc_id, ids: bytes, loss_from: int = 0) -> None:
        total, cap = len(ids) // 4, self.capacity
        whole = cap if self.demand(0, cap, 0)[2] <= self.room[2] and self.room[1] >= 1 else 0
        at = 0
        while whole and total - at >= cap:
            self.close([(doc_id, at, ids[4 * at : 4 * (at + cap)], total, loss_from)])
            at += cap
        while total > at:
            n = min(cap, total - at)
            self.wait((doc_id, at, ids[4 * at : 4 * (at + n)], total, loss_from))
            at += n
        while len(self.pool) >= self.most:
            self.fill()

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total, _ in pieces:
            n = len(ids) // 4
            for column, x in zip(self.rows, (doc_id, start, n, zlib.crc32(ids), total, self.next, offset), strict=True):
                column.append(x)
            offset += n
        self.next += 1

    def fill(self) -> None:
        """One sequence from the pool."""
        free, pieces, used = self.room.copy(), [], 0
        while self.pool and free[0] and free[1] and free[2] >= 0:
            need = self.need[: len(self.pool)]
            fits = (need <= free).all(axis=1)
            if fits.any():
                gain = (need / self.room) @ (free / self.room)
                piece = self.take(int(np.argmax(np.where(fits, gain, -1.0))))
            else:
                i = int(np.argmax(need[:, 0]))
                doc_id, start, ids, total, loss_from = self.pool[i]
                n = int(min(free[0], len(ids) // 4, max(0, loss_from - start) + free[2]))
                if n <= 0:
                    break
                self.take(i)
                piece = (doc_id, start, ids[: 4 * n], total, loss_from)
                if n < len(ids) // 4:
                    self.wait((doc_id, start + n, ids[4 * n :], total, loss_from))
            n = len(piece[2]) // 4
            free -= self.demand(piece[1], n, piece[4])
            used += n
            pieces.append(piece)
        over = used - (self.capacity if used == self.capacity else 1 << (used.bit_length() - 1))
        while over:
            doc_id, start, ids, total, loss_from = pieces.pop()
            keep = max(0, len(ids) // 4 - over)
            over -= len(ids) // 4 - keep
            self.wait((doc_id, start + keep, ids[4 * keep :], total, loss_from))
            if keep:
                pieces.append((doc_id, start, ids[: 4 * keep], total, loss_from))
        self.close(pieces)

    def drain(self) -> Iterator[pa.RecordBatch]:
        out, self.rows = self.rows, [[] for _ in range(7)]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in out], schema=_ARROW)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None, capacity: int = 2048, max_segments: int = 128, max_loss: int | None = None, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """One row per piece. loss_from_col: token index from which a document's tokens bear loss (default 0: all)."""
    if capacity < 1 or max_segments < 1 or (max_loss is not None and max_loss < 1):
        raise ValueError("limits must be positive")
    end = packed([end_id])
    loss = capacity if max_loss is None else max_loss
    first = F.col(loss_from_col).cast("long") if loss_from_col else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = memo(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, max_segments, loss)
        for batch in batches:
            ids, text, loss_from = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                packer.add(ids[i].as_py(), words.ids(text[i].as_py() or b"") + end, loss_from[i].as_py() or 0)
                if len(packer.rows[0]) >= 20_000:
                    yield from packer.drain()
        while packer.pool:
            packer.fill()
        yield from packer.drain()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"), first.alias("loss_from")).mapInArrow(run, SCHEMA)
