"""TIFF media columns: walk image directories, decode strips and tiles, undo predictors, one row per page.

The reader takes either byte order, classic and big files, strips or tiles, planar or interleaved samples of 1, 8,
16, 32 or 64 bits, stored raw or by PackBits, LZW or deflate, with horizontal or floating-point predictors. The
writer stores bytes as 8-bit grey pages.

Defined results: null media gives no page rows; media that cannot be read gives one row with page -1 and the error,
and a page that cannot be decoded gives its row with null pixels and the error; a directory that points back ends
the walk; a page of more than 1 GiB gives its row with an error; an empty table gives no rows; repeated rows repeat;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the TIFF 6.0 format and its later big form: field sizes by type, and compression schemes by number.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {RAW: "raw", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}


class TiffError(ValueError):
    pass


# Codecs ---------------------------------------------------------------------------------------------------------


def packbits_encode(row: bytes) -> bytes:
    """One row; runs of three bytes or more become repeat packets."""
    a = np.frombuffer(row, dtype=np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]) if len(a) else np.zeros(1, int)
    long = np.flatnonzero(np.diff(starts) >= 3)
    out, done = [], 0

    def literal(end: int) -> None:
        for i in range(done, end, 128):
            n = min(128, end - i)
            out.append(bytes([n - 1]) + row[i : i + n])

    for k in long:
        literal(int(starts[k]))
        at, end = int(starts[k]), int(starts[k + 1])
        while at < end:
            n = min(128, end - at)
            out.append(bytes([257 - n, row[at]]) if n > 1 else bytes([0, row[at]]))
            at += n
        done = end
    literal(len(row))
    return b"".join(out)


def packbits_rows(block: np.ndarray) -> bytes:
    """Rows one by one, as the format asks; those without a run of three bytes are one literal packet."""
    width = block.shape[1]
    if width > 128 or width < 3:
        return b"".join(packbits_encode(r.tobytes()) for r in block)
    same = block[:, 1:] == block[:, :-1]
    plain = ~(same[:, 1:] & same[:, :-1]).any(axis=1)
    ready = np.concatenate([np.full((len(block), 1), width - 1, dtype=np.uint8), block], axis=1)
    cuts = np.flatnonzero(np.diff(plain)) + 1
    out = []
    for a, b in zip(np.concatenate([[0], cuts]), np.append(cuts, len(block)), strict=True):
        out.append(ready[a:b].tobytes() if plain[a] else b"".join(packbits_encode(r.tobytes()) for r in block[a:b]))
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, have, at = [], 0, 0
    while have < size and at < len(data):
        n = data[at]
        if n < 128:
            piece = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            piece = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
            continue
        out.append(piece)
        have += len(piece)
    return b"".join(out)


#: Bits of the nth code after a clear code: 9 to 12, one more from the code before the one that needs them; and their sums.
WIDTHS = 9 + (np.arange(8192)[:, None] >= np.array([254, 766, 1790])).sum(axis=1)
PLACES = np.concatenate([[0], np.cumsum(WIDTHS)])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; widths grow one code early, as the format asks."""
    codes, table, free, now = [256], {}, 258, -1
    emit, known = codes.append, table.get
    for c in data:
        if now < 0:
            now = c
            continue
        key = now << 8 | c
        found = known(key)
        if found is not None:
            now = found
            continue
        emit(now)
        table[key] = free
        now = c
        if free == 4094:
            emit(256)
            table.clear()
            free = 258
        else:
            free += 1
    if now >= 0:
        emit(now)
    emit(257)
    all_ = np.array(codes, dtype=np.int64)
    clear = np.flatnonzero(all_ == 256)
    since = np.arange(len(all_)) - clear[np.maximum(np.searchsorted(clear, np.arange(len(all_)), side="left") - 1, 0)] - 1
    w = WIDTHS[np.maximum(since, 0)]
    ends = np.cumsum(w)
    first = (ends - w) >> 3
    wide = all_ << (24 - w - ((ends - w) & 7))
    size = int(ends[-1] + 7) // 8
    # Codes share bytes but no bits, so their parts of a byte add up.
    out = sum(np.bincount(first + k, (wide >> (16 - 8 * k)) & 255, minlength=size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


_PLAIN = [bytes([i]) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes are cut out many at a time, as their widths hang on their number since the last clear code alone."""
    raw, end = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int64), 8 * len(data)
    out: list[bytes] = []
    table, last, bit, nth, have = list(_PLAIN), b"", 0, 0, 0
    while have < size:
        nth = min(nth, 4096)
        start, w = bit + PLACES[nth : nth + 4096] - PLACES[nth], WIDTHS[nth : nth + 4096]
        n = int(np.searchsorted(start + w, end, side="right"))
        if not n:
            break
        start, w = start[:n], w[:n]
        i = start >> 3
        codes = (raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) >> (24 - w - (start & 7)) & ((1 << w) - 1)
        special = np.flatnonzero((codes == 256) | (codes == 257))
        m = int(special[0]) if len(special) else n
        known = codes[:m].tolist()
        if known and not last:
            if known[0] > 255:
                raise TiffError("LZW code before its entry")
            last = table[known[0]]
            out.append(last)
            have += len(last)
            del known[0]
        add, emit, free = table.append, out.append, len(table)
        for code in known:
            if code < free:
                piece = table[code]
                add(last + piece[:1])
            elif code == free:
                piece = last + last[:1]
                add(piece)
            else:
                raise TiffError("LZW code before its entry")
            free += 1
            last = piece
            emit(piece)
        have += sum(map(len, out[len(out) - len(known) :])) if known else 0
        if m == n:
            bit, nth = int(start[-1] + w[-1]), nth + n
        elif codes[m] == 257:
            break
        else:
            table, last, bit, nth = list(_PLAIN), b"", int(start[m] + w[m]), 0
    return b"".join(out)


def decompress(scheme: int, data: bytes, size: int) -> bytes:
    if scheme == RAW:
        out = data
    elif scheme == PACKBITS:
        out = packbits_decode(data, size)
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise TiffError(f"compression {scheme} is not supported")
    if len(out) < size:
        raise TiffError(f"{len(out)} of {size} bytes decoded")
    return out[:size]


# Reading --------------------------------------------------------------------------------------------------------


@dataclass
class Page:
    number: int
    width: int = 0
    height: int = 0
    samples: int = 1
    bits: int = 8
    compression: int = RAW
    predictor: int = 1
    tiled: bool = False
    pixels: bytes | None = None
    error: str | None = None
    tags: dict = field(default_factory=dict)


def directories(data: bytes) -> Iterator[tuple[str, dict]]:
    """Byte order and tags of each image directory."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8:
        raise TiffError("not a TIFF file")
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise TiffError("not a TIFF file")
    big = magic == 43
    count, step, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    at = struct.unpack_from(order + word, data, 8 if big else 4)[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + count, data, at)
            base, tags = at + struct.calcsize(count), {}
            for k in range(n):
                tag, kind = struct.unpack_from(order + "HH", data, base + step * k)
                (m,) = struct.unpack_from(order + word, data, base + step * k + 4)
                if kind not in FORMATS:
                    continue
                inline = base + step * k + 4 + struct.calcsize(word)
                long = SIZES[kind] * m > struct.calcsize(word)
                where = struct.unpack_from(order + word, data, inline)[0] if long else inline
                if m * SIZES[kind] > len(data):
                    raise TiffError("a field is longer than the file")
                tags[tag] = struct.unpack_from(f"{order}{m}{FORMATS[kind]}", data, where)
            (at,) = struct.unpack_from(order + word, data, base + step * n)
        except struct.error as e:
            raise TiffError(f"a directory leaves the file: {e}") from e
        yield order, tags


def undo(raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Rows of sample bytes in native order, without the predictor."""
    if bits == 1:
        line = np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1)
        return np.unpackbits(line, axis=1)[:, : width * samples].reshape(rows, width, samples)
    kind = np.dtype(f"{order}u{bits // 8}")
    if predictor == 3:
        line = np.frombuffer(raw, dtype=np.uint8).reshape(rows, width * samples * bits // 8)
        line = np.cumsum(line.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, bits // 8, width * samples)
        return np.ascontiguousarray(line.transpose(0, 2, 1)).view(np.dtype(f">u{bits // 8}")).reshape(rows, width, samples).astype(kind.newbyteorder("="))
    a = np.frombuffer(raw, dtype=kind).reshape(rows, width, samples).astype(kind.newbyteorder("="))
    return np.cumsum(a, axis=1, dtype=a.dtype) if predictor == 2 else a


def decode(data: bytes, order: str, tags: dict, page: Page) -> None:
    """Fill a page from its directory."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    page.width, page.height, page.samples = one(256, 0), one(257, 0), one(277, 1)
    page.bits, page.compression, page.predictor = one(258, 1), one(259, RAW), one(317, 1)
    page.tiled, planar, w, h = 324 in tags, one(284, 1) == 2, page.width, page.height
    if page.bits not in (1, 8, 16, 32, 64) or len(set(tags.get(258, (1,)))) > 1:
        raise TiffError("sample sizes are not supported")
    if not w or not h:
        raise TiffError("a page has no size")
    if page.predictor not in (1, 2, 3):
        raise TiffError(f"predictor {page.predictor} is not supported")
    cw, ch = (one(322, 0), one(323, 0)) if page.tiled else (w, min(h, one(278, h)))
    at, sizes = (tags.get(324), tags.get(325)) if page.tiled else (tags.get(273), tags.get(279))
    if not at or not sizes or len(at) != len(sizes) or not cw or not ch:
        raise TiffError("strips or tiles are not listed")
    across, down, deep = -(-w // cw), -(-h // ch), page.samples if planar else 1
    per = 1 if planar else page.samples
    if len(at) < across * down * deep:
        raise TiffError("strips or tiles are missing")
    kind = np.uint8 if page.bits == 1 else np.dtype(f"u{page.bits // 8}")
    if w * h * page.samples * np.dtype(kind).itemsize > 1 << 30:
        raise TiffError("a page is larger than 1 GiB")
    out = np.empty((h, w, page.samples), dtype=kind)
    for k in range(across * down * deep):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * ch, rest % across * cw
        rows = ch if page.tiled else min(ch, h - y)
        line = -(-cw * per * page.bits // 8)
        raw = data[at[k] : at[k] + sizes[k]]
        if len(raw) < sizes[k]:
            raise TiffError("a strip or tile leaves the file")
        block = undo(decompress(page.compression, raw, rows * line), rows, cw, per, page.bits, page.predictor, order)
        part = block[: h - y, : w - x]
        if planar:
            out[y : y + part.shape[0], x : x + part.shape[1], plane] = part[:, :, 0]
        else:
            out[y : y + part.shape[0], x : x + part.shape[1]] = part
    page.pixels = out.tobytes()


def pages(data: bytes) -> Iterator[Page]:
    """Every page; what cannot be read is told in its error."""
    number = 0
    try:
        for order, tags in directories(data):
            page = Page(number, tags=tags)
            try:
                decode(data, order, tags, page)
            except (TiffError, zlib.error, ValueError, IndexError) as e:
                page.error = str(e)
            yield page
            number += 1
    except (TiffError, struct.error) as e:
        yield Page(-1, error=str(e))


# Writing --------------------------------------------------------------------------------------------------------


def compress(scheme: int, block: np.ndarray) -> bytes:
    if scheme == PACKBITS:
        return packbits_rows(block)
    raw = block.tobytes()
    return raw if scheme == RAW else lzw_encode(raw) if scheme == LZW else zlib.compress(raw, 1)


def encode(samples: bytes, *, width: int = 64, scheme: int = DEFLATE, predictor: int = 1, tiled: bool = False, page_rows: int = 1024, rows: int = 128, order: str = "<") -> bytes:
    """Bytes as 8-bit grey pages of a given width; their number must be a multiple of it."""
    image = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    out, links = [struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0)], 4
    size = 8
    fix: list[tuple[int, int]] = []
    tile = -(-min(width, 64) // 16) * 16
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        parts = []
        for y in range(0, len(page), rows):
            for x in range(0, width, tile) if tiled else [0]:
                block = page[y : y + rows, x : x + tile] if tiled else page[y : y + rows]
                if tiled and block.shape != (rows, tile):
                    block = np.pad(block, ((0, rows - block.shape[0]), (0, tile - block.shape[1])))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                parts.append(compress(scheme, block))
        at = [size + sum(map(len, parts[:k])) for k in range(len(parts))]
        body = b"".join(parts)
        body += b"\0" * (-len(body) % 2)
        out.append(body)
        size += len(body)
        n = len(parts)
        lists = b"" if n == 1 else struct.pack(f"{order}{2 * n}I", *at, *map(len, parts))
        out.append(lists)
        entry = lambda tag, kind, m, x: struct.pack(order + "HHI", tag, kind, m) + (struct.pack(order + "HH", x, 0) if kind == 3 else struct.pack(order + "I", x))  # noqa: B023, E731
        where, sizes = (size, size + 4 * n) if n > 1 else (at[0], len(parts[0]))
        size += len(lists)
        entries = [(256, 4, 1, width), (257, 4, 1, len(page)), (258, 3, 1, 8), (259, 3, 1, scheme), (262, 3, 1, 1), (277, 3, 1, 1), (317, 3, 1, predictor)]
        entries += [(322, 3, 1, tile), (323, 3, 1, rows), (324, 4, n, where), (325, 4, n, sizes)] if tiled else [(273, 4, n, where), (278, 4, 1, rows), (279, 4, n, sizes)]
        fix.append((links, size))
        out.append(struct.pack(order + "H", len(entries)) + b"".join(entry(*e) for e in sorted(entries)) + b"\0\0\0\0")
        size += len(out[-1])
        links = size - 4
    whole = bytearray(b"".join(out))
    for place, to in fix:
        struct.pack_into(order + "I", whole, place, to)
    return bytes(whole)


# DataFrame operators --------------------------------------------------------------------------------------------

PAGE_SCHEMA = "doc_id long, page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each TIFF file, in the order of the files and their pages. keep: columns that go along."""
    carried = "".join(f", {c} {media.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PAGE_SCHEMA.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
        for batch in batches:
            ids, blobs = batch.column(0), batch.column(1)
            rows, at, size = [], [], 0
            for i in range(batch.num_rows):
                data = blobs[i].as_py()
                for p in pages(data) if data is not None else ():
                    rows.append((ids[i].as_py(), p.number, p.width, p.height, p.samples, p.bits, NAMES.get(p.compression, str(p.compression)), p.predictor, p.tiled, p.pixels, p.error))
                    at.append(i)
                    size += len(p.pixels or b"")
                    if size > BATCH:
                        yield table_of(rows, at, batch, names, kinds)
                        rows, at, size = [], [], 0
            if rows:
                yield table_of(rows, at, batch, names, kinds)

    def table_of(rows, at, batch, names, kinds) -> pa.RecordBatch:
        columns = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, *(batch.column(2 + k).take(pa.array(at)) for k in range(len(keep)))], names=[*names, *keep])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"), *keep).mapInArrow(run, PAGE_SCHEMA + carried)


#: Bytes of pixels in one batch of pages.
BATCH = 4 << 20
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(payload: bytes) -> bytes:
    """The payload as TIFF. Its checksum picks scheme, predictor and layout, so that every kind of page is in use alike."""
    pick = zlib.crc32(payload)
    scheme = (LZW, PACKBITS, DEFLATE)[pick % 3]
    return encode(payload, scheme=scheme, predictor=1 if scheme == PACKBITS or pick >> 8 & 1 else 2, tiled=bool(pick >> 9 & 1), order="<" if pick >> 10 & 1 else ">")


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as TIFF media: doc_id, media, n_bytes (of the text), media_bytes, media_sha256. Texts are padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or b""
                media = stored(text + b"\0" * (-len(text) % 64 or (0 if text else 64)))
                rows.append((media, len(text), len(media), hashlib.sha256(media).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "media", "n_bytes", "media_bytes", "media_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text")).mapInArrow(run, "doc_id long, media binary, n_bytes long, media_bytes long, media_sha256 string")


class Folded:
    """What the pages of one file amount to, page after page."""

    def __init__(self, first: dict):
        self.first, self.n, self.size = first, 0, 0
        self.sha, self.tail, self.counts = hashlib.sha256(), b"", np.zeros(256, dtype=np.int64)

    def add(self, page: dict) -> None:
        if page["error"]:
            raise TiffError(page["error"])
        pixels = page["pixels"]
        self.sha.update(pixels)
        self.tail = (self.tail + pixels[-64:])[-64:]
        self.counts += np.bincount(np.frombuffer(pixels, dtype=np.uint8), minlength=256)
        self.n, self.size = self.n + 1, self.size + len(pixels)

    def row(self) -> tuple:
        p, counts = self.first, self.counts
        mean = int(counts @ np.arange(256)) * 1000 // self.size
        feature = f"pages={self.n};size={p['width']}x{p['height']};codec={p['compression']}+{p['predictor']};mean_milli={mean};levels={int((counts > 0).sum())};mode={int(counts.argmax())}"
        return p["doc_id"], p["n_bytes"], self.size, self.sha.hexdigest(), zlib.crc32(self.tail), p["media_bytes"], p["media_sha256"], feature


def text_media_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its text stored as TIFF pages, read back page by page, and described.

    Pages come in the order of their files and no task gives any away, so they are folded where they are read.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, rows = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")], None, []
        for batch in batches:
            for page in batch.to_pylist():
                if page["page"] <= 0:  # the first page of a file, or its error
                    rows += [now.row()] if now else []
                    now = Folded(page)
                now.add(page)
            if len(rows) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        rows += [now.row()] if now else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    pages_ = tiff_pages(text_media(docs, id_col=id_col, text_col=text_col), keep=("n_bytes", "media_bytes", "media_sha256"))
    return pages_.mapInArrow(fold, DIGEST_SCHEMA)
