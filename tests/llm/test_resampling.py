import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from velumen.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KIND = "doc_id long, text string"


def features(text, runs, buckets):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def slow(docs, target, *, percent=10, min_words=20, buckets=10_000, runs=1, seed="2024"):
    each = [features(t, runs, buckets) for _, t in docs]
    s, t = Counter(b for _, f in each for b in f), Counter(b for x in target for b in features(x, runs, buckets)[1])
    sall, tall = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sall + buckets) / ((s[b] + 1) * (tall + buckets)))) for b in s}
    rows = []
    for (i, _), (words, f) in zip(docs, each, strict=True):
        w = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    may = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = n
    return [tuple(r[:5]) for r in rows]


def check(spark, docs, target, **options):
    df = spark.createDataFrame([(*d, 1.5, "x") for d in docs], KIND + ", score double, ids string").repartition(5)
    got = resampling.resampled(df, spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string"), **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, slow(docs, target, **options)))


def corpus(n=200):
    rng = np.random.default_rng(1)
    words = ["the", "The", "été", "42", "x-y", "日本", "a_b"] + [f"w{i}" for i in range(50)]
    return [(i, " ".join(rng.choice(words, rng.integers(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"percent": 100, "min_words": 0}, {"runs": 3, "buckets": 97, "percent": 33, "min_words": 40, "seed": "other"}])
def test_against_slow_version(spark, options):
    check(spark, corpus(), ["the w1 w2 été", "w3 " * 30, None, ""], **options)


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties."""
    docs = corpus(50) + [(None, None), (None, "the " * 30), (60, ""), (61, None), (62, "-- __"), (63, "w1 w2 " * 100_000), (64, "w1 " * 25), (64, "w1 " * 25), (64, "w2 " * 25), (65, "\0a\0b" * 30)]
    check(spark, docs, ["w1 w2"], percent=50)
    check(spark, docs, ["w1 w2"], percent=50, runs=2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(spark.createDataFrame([], KIND), none).collect() == []
    check(spark, corpus(30), [])


def test_blocks_are_sparse_matrices(spark):
    docs = corpus(40)
    blocks = resampling.csr_blocks(spark.createDataFrame(docs, KIND).coalesce(1), buckets=31)
    dense = np.zeros((40, 31), dtype=int)
    for b in blocks.collect():
        at, n = np.frombuffer(b.buckets, "<u4"), np.frombuffer(b.counts, "<u4")
        for r, i in enumerate(b.ids):
            dense[i, at[b.offsets[r] : b.offsets[r + 1]]] = n[b.offsets[r] : b.offsets[r + 1]]
    want = np.array([np.bincount(features(t, 1, 31)[1], minlength=31) for _, t in docs])
    assert (dense == want).all() and (resampling.column_sums(blocks, 31) == want.sum(axis=0)).all()


def test_draw_follows_the_target(spark):
    """Half of the documents use the target's words; most of those drawn are of them, with their own columns."""
    docs = [(i, ("goal match team " if i % 2 else "stock bond fund ") * 10, i) for i in range(400)]
    df = spark.createDataFrame(docs, KIND + ", rank int")
    got = resampling.drawn_documents(df, spark.createDataFrame([(0, "goal team match goal")], "item_id long, text string"))
    assert got.columns == df.columns and got.count() == 40 and got.where("doc_id % 2 = 1").count() >= 36
