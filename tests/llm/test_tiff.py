import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from velumen.llm import tiff


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_codecs_round_trip(data, times):
    data *= times
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


def test_lzw_over_table_resets():
    data = np.random.default_rng(1).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_known_stream():
    data, codes = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]), [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    stream = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_encode(data) == stream and tiff.lzw_decode(stream, len(data)) == data


@pytest.mark.parametrize("scheme", [tiff.RAW, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(scheme, predictor, tiled, order):
    data = np.random.default_rng(3).integers(0, 9, 100 * 70, dtype=np.uint8).tobytes()
    media = tiff.encode(data, width=100, scheme=scheme, predictor=predictor, tiled=tiled, page_rows=32, rows=16, order=order)
    got = list(tiff.pages(media))
    assert [p.error for p in got] == [None] * 3
    assert [(p.width, p.height) for p in got] == [(100, 32), (100, 32), (100, 6)]
    assert b"".join(p.pixels for p in got) == data


def one_page(body, fields, order=">"):
    """A file with one directory; fields: tag -> (type, values)."""
    at, extra, entries = 8 + len(body), b"", []
    code = {3: "H", 4: "I"}
    top = at + 2 + 12 * len(fields) + 4
    for tag, (kind, values) in sorted(fields.items()):
        raw = struct.pack(f"{order}{len(values)}{code[kind]}", *values)
        if len(raw) > 4:
            where = struct.pack(order + "I", top + len(extra))
            extra += raw
        else:
            where = raw.ljust(4, b"\0")
        entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + where)
    head = struct.pack(order + "2sHI", b"MM" if order == ">" else b"II", 42, at)
    return head + body + struct.pack(order + "H", len(fields)) + b"".join(entries) + b"\0\0\0\0" + extra


def test_planar_16_bit_with_predictor():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 65536, (5, 7, 3)).astype(np.uint16)
    planes = [np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], axis=1).astype(">u2").tobytes() for p in image.transpose(2, 0, 1)]
    planes = [zlib.compress(p) for p in planes]
    at = [8 + sum(map(len, planes[:k])) for k in range(3)]
    media = one_page(b"".join(planes), {256: (3, [7]), 257: (3, [5]), 258: (3, [16] * 3), 259: (3, [8]), 273: (4, at), 277: (3, [3]), 278: (3, [5]), 279: (4, list(map(len, planes))), 284: (3, [2]), 317: (3, [2])})
    (page,) = tiff.pages(media)
    assert page.error is None and page.pixels == image.tobytes()


def test_floating_point_predictor():
    image = np.random.default_rng(6).normal(size=(4, 6)).astype(np.float32)
    planes = np.ascontiguousarray(image.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1)).reshape(4, 24)
    raw = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).tobytes()
    media = one_page(raw, {256: (3, [6]), 257: (3, [4]), 258: (3, [32]), 259: (3, [1]), 273: (4, [8]), 278: (3, [4]), 279: (4, [len(raw)]), 317: (3, [3])})
    (page,) = tiff.pages(media)
    assert page.error is None and np.array_equal(np.frombuffer(page.pixels, np.float32).reshape(4, 6), image)


def test_bilevel_packbits():
    bits = np.random.default_rng(7).integers(0, 2, (9, 19), dtype=np.uint8)
    raw = b"".join(tiff.packbits_encode(r.tobytes()) for r in np.packbits(bits, axis=1))
    media = one_page(raw, {256: (3, [19]), 257: (3, [9]), 259: (3, [32773]), 273: (4, [8]), 279: (4, [len(raw)])})
    (page,) = tiff.pages(media)
    assert page.error is None and page.pixels == bits.tobytes()


def test_damage_is_told_not_raised(spark):
    good = tiff.encode(b"x" * 128)
    loop = bytearray(good)
    loop[-4:] = struct.pack("<I", struct.unpack_from("<I", good, 4)[0])
    rows = [(1, b""), (2, None), (3, good[:40]), (4, good[:-1]), (5, bytes(loop)), (6, good), (6, good), (7, b"II*\0\xff\xff\xff\x7f"), (None, good)]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert 2 not in by and by[1][0].error and by[3][0].error and by[4][0].error and by[7][0].page == -1
    assert len(by[5]) == 1 and len(by[6]) == 2 and by[None][0].pixels == b"x" * 128
    assert tiff.tiff_pages(spark.createDataFrame([], "doc_id long, media binary")).collect() == []


def test_text_digest(spark):
    texts = [None, "", "a", "b" * 64, "é" * 33, "long text " * 30_000, "b" * 64]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in tiff.text_media_digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = tiff.stored(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[3][1:] == got[6][1:] and got[0][1:] == got[1][1:] and got[5].feature.startswith("pages=5;")


def test_every_codec_is_in_use_alike_and_the_whole_table_reads_back(spark, sf):
    from velumen.llm.registry import QUERIES

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_tiff_pages"](spark, sf).collect()
    assert len(got) == len(texts)
    codecs = {}
    for r in got:
        raw = texts[r.doc_id]
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        codec = r.feature.split("codec=")[1].split("+")[0]
        codecs[codec] = codecs.get(codec, 0) + 1
    assert set(codecs) == {"lzw", "packbits", "deflate"} and min(codecs.values()) > len(got) / 5


def test_kept_columns_go_along_with_pages(spark):
    media = tiff.encode(bytes(range(256)) * 1024, page_rows=512, width=64)
    got = tiff.tiff_pages(spark.createDataFrame([(1, media, "a"), (2, None, "b")], "doc_id long, media binary, pixels2 string"), keep=("pixels2",)).collect()
    assert [(r.page, r.pixels2) for r in got] == [(i, "a") for i in range(8)] and b"".join(r.pixels for r in got) == bytes(range(256)) * 1024


@pytest.mark.parametrize("seed", range(6))
def test_lzw_over_several_tables_and_packbits_rows(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, (2, 4, 256, 30, 256, 1)[seed] or 1, (0, 1, 60_000, 200_000, 9_000, 70_000)[seed], dtype=np.uint8).tobytes()
    packed = tiff.lzw_encode(data)
    assert tiff.lzw_decode(packed, len(data)) == data and tiff.lzw_decode(packed, len(data) // 2)[: len(data) // 2] == data[: len(data) // 2]
    block = rng.integers(0, (2, 3, 256, 5, 9, 2)[seed], (50, (64, 128, 2, 200, 17, 3)[seed]), dtype=np.uint8)
    packed = tiff.packbits_rows(block)
    assert packed == b"".join(tiff.packbits_encode(r.tobytes()) for r in block) and tiff.packbits_decode(packed, block.size) == block.tobytes()


def test_clear_codes_anywhere():
    """A stream that clears its table early and late, from its definition bit by bit."""
    def stream(codes):
        bits, nth = "", 0
        for c in codes:
            bits += format(c, f"0{9 + (nth >= 254) + (nth >= 766) + (nth >= 1790)}b")
            nth = 0 if c == 256 else nth + 1
        bits += "0" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))

    assert tiff.lzw_decode(stream([256, 65, 66, 258, 256, 67, 258, 256, 256, 68, 257]), 99) == b"ABABCCCD"
    assert tiff.lzw_decode(stream([65] * 300 + [256, 66, 257]), 999) == b"A" * 300 + b"B"
    with pytest.raises(tiff.TiffError):
        tiff.lzw_decode(stream([256, 65, 300]), 9)
