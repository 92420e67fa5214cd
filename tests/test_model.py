import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from velumen.functions import blurhash, model, png, preprocess
from velumen.functions.encoder import HashEncoder, embed_column
from velumen.operators import service


def written(image, colour, bits=8, kind=0, palette=None):
    """A PNG file whose rows all have one filter, from its definition."""
    height, width, n = image.shape
    if bits == 8:
        lines = [r.tobytes() for r in image.astype(np.uint8)]
    elif bits == 16:
        lines = [r.astype(">u2").tobytes() for r in image]
    else:
        lines = [np.packbits(((r.ravel()[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel()).tobytes() for r in image]
    step, above, out = max(1, n * bits // 8), bytes(len(lines[0])), b""
    for line in lines:
        row = bytearray()
        for x, v in enumerate(line):
            a, b, c = line[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            row.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind]) + bytes(row)
        above = line
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    plte = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + plte + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize(("colour", "bits"), [(0, 8), (2, 8), (4, 8), (6, 8), (2, 16), (0, 1), (0, 4)])
def test_png(kind, colour, bits):
    image = np.random.default_rng(kind).integers(0, 1 << bits, (7, 11, png.SAMPLES[colour]))
    got, _ = png.pixels(written(image, colour, bits, kind))
    want = image >> 8 if bits == 16 else image * (255 // ((1 << bits) - 1)) if bits < 8 else image
    assert np.array_equal(got, want)


def test_palettes_and_damage():
    palette = np.random.default_rng(1).integers(0, 256, (4, 3), dtype=np.uint8)
    image = np.random.default_rng(2).integers(0, 4, (5, 6, 1))
    data = written(image, 3, 2, 0, palette)
    assert np.array_equal(model.image_pixels(data), palette[image[:, :, 0]])
    assert np.array_equal(png.pixels(blurhash.png(blurhash.decode("LEHV6nWB2yk8pyo0adR*.7kCMdnj")))[0], blurhash.decode("LEHV6nWB2yk8pyo0adR*.7kCMdnj"))
    for bad in (b"", b"GIF89a", data[:40], data[:-20] + b"x" * 20):
        with pytest.raises((ValueError, zlib.error)):
            png.pixels(bad)


def _colours(pixels):
    return np.concatenate([pixels.mean(axis=(2, 3)), pixels.std(axis=(2, 3)) + 0.1], axis=1)


def _words(ids):
    return np.stack([np.bincount(r % 6, minlength=6) for r in ids])


class Load:
    made = 0

    def __call__(self):
        Load.made += 1
        return _colours, _words


def _fetch(address):
    level = 250 if "bright" in address else 10
    return written(np.full((40, 60, 3), level), 2)


@pytest.fixture
def encoder():
    import public_tokenizers

    return model.ModelEncoder(Load(), _fetch, public_tokenizers.path("word_bpe_49k.json"), dim=6)


def test_a_model_sees_pixels_and_ids(spark, encoder):
    out = np.array(encoder.embed("a red cover\nhttps://x/bright\n https://x/dark \na red cover"))
    assert out.shape == (4, 6) and np.allclose(np.linalg.norm(out, axis=1), 1, atol=1e-6) and np.array_equal(out[0], out[3])
    plain = _colours(np.stack([preprocess.preprocess(np.full((40, 60, 3), 250, np.uint8))]))[0]
    assert np.allclose(out[1], plain / np.linalg.norm(plain), atol=1e-6) and not np.allclose(out[1], out[2])
    made = Load.made
    encoder.embed("again")
    assert Load.made == made


def test_logits_are_bounded(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(model.logits(F.col("a"), F.col("b"), math.log(20))).collect()]
    assert got == pytest.approx([20, 0])
    assert df.select(model.logits(F.col("a"), F.col("b"), 9.0)).first()[0] == pytest.approx(100)


def test_search_address(spark):
    e = HashEncoder(16)
    df = spark.createDataFrame([(1, e.embed("x")[0], True, False, "jpg", None, False, None)], "id long, embedding array<double>, searchable boolean, deleted boolean, extension string, source string, from_old_database boolean, blurhash string")
    s = service.Service(df, df, df)
    assert s.cover_bytext({}, e) == s.cover_bytext({"q": ""}, e) == (400, "No query provided") and s.told == []
    assert s.cover_bytext({"q": "x"}, e) == (200, '[{"versions":{"png":{"original":"https://images.example.org/original/1.jpg"}}}]')
    assert embed_column(spark.createDataFrame([("x",)], "input string"), e).count() == 1
