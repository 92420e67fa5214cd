import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velumen.llm import repeats
from velumen.llm import textcore as tc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    """(n_words, n_removed, kept digest) by position."""
    words = [WORD.findall(t or "") for t in docs]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def texts(seed, n=40, vocabulary=6, most=120):
    rng = np.random.default_rng(seed)
    out = [" ".join(f"w{k}" for k in rng.integers(0, vocabulary, rng.integers(0, most))) for _ in range(n)]
    for _ in range(n // 2):
        a = out[rng.integers(len(out))].split()
        i = rng.integers(0, len(a) + 1)
        out.append(" ".join([*(f"x{k}" for k in rng.integers(0, 99, 5)), *a[i : i + 40], *(f"y{k}" for k in rng.integers(0, 99, 5))]))
    return out


@pytest.mark.parametrize(("seed", "window", "vocabulary"), [(1, 35, 400), (2, 35, 2), (3, 8, 6), (4, 12, 1), (5, 20, 30)])
def test_against_brute_force(spark, seed, window, vocabulary):
    docs = texts(seed, vocabulary=vocabulary)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.repeat_digest(df, window=window).collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs, window)


def test_defined_cases(spark):
    run = "the " * 200
    long = " ".join(f"v{i}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, "short"), (4, run), (5, " ".join(["a"] * 35)), (6, " ".join(["a"] * 35)), (7, long), (8, "p q " + " ".join(f"v{i}" for i in range(100, 140)) + " r"), (9, " ".join(["z"] * 35)), (None, "x y   z\x1fq")]
    rows = spark.createDataFrame([(i, t, "kept", 7) for i, t in docs], "doc_id long, text string, n_words string, uid int")
    got = repeats.remove_repeats(rows.repartition(3)).collect()
    want = dict(zip([i for i, _ in docs], brute([t for _, t in docs], 35), strict=True))
    for r in got:
        assert (r.n_removed, r.kept_sha256) == want[r.doc_id][1:] and r.n_words == "kept" and r.uid == 7
    assert want[7][1] == 40 and want[8][1] == 40 and want[4][1] == 200 and want[9][1] == 0
    assert repeats.repeat_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows(spark):
    text = " ".join(f"v{i}" for i in range(50))
    got = repeats.repeat_digest(spark.createDataFrame([(1, text)] * 3 + [(2, "other " * 3)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 50)] * 3 + [(2, 0)]


@pytest.mark.parametrize("seed", range(8))
def test_equal_windows_share_their_anchor(seed):
    window, names = 12 + 7 * (seed % 4), {}
    for docs in (texts(seed, vocabulary=(2, 5, 30, 300)[seed % 4]), ["p q r " * 60, "x " + "p q r " * 40 + "y", "s " * 90 + "t"]):
        for _, _, data, off in tc.blocks(pa.array(docs)):
            starts, ends, rows = tc.spans(data, off)
            h = tc.word_hashes(data, starts, ends)
            _, low, high = repeats.symbols(h, rows)
            assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
            for p, _, name in zip(*repeats.anchors(h, rows, window), strict=True):
                names.setdefault(tuple(h[p : p + window].tolist()), set()).add(int(name))
    assert all(len(x) == 1 for x in names.values())


def test_anchors_of_plain_text_are_symbols():
    h = tc.mix(np.random.default_rng(9).integers(0, 500, 4000).astype(np.uint64))
    _, whole, name = repeats.anchors(h, np.array([0, len(h)]))
    assert (name != tc.mix(whole)).mean() > 0.99


def test_words_that_fool_linear_hashes(spark):
    parity = lambda n, flip: "".join("ab"[(i.bit_count() & 1) ^ flip] for i in range(n))
    common = " ".join(f"c{i}" for i in range(34))
    docs = [f"{parity(n, flip)} {n}{common}" for n in (8, 16, 512, 1024, 2048, 4096) for flip in (0, 1)]
    got = repeats.repeat_digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert {(r.doc_id, r.n_removed) for r in got.collect()} == {(i, 0) for i in range(len(docs))}
    # Windows of 1024 words whose two kinds of word are exchanged.
    docs = [" ".join(parity(1024, flip)) for flip in (0, 1)]
    got = repeats.repeat_digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), window=1024)
    assert [r.n_removed for r in got.collect()] == [0, 0]


@pytest.mark.parametrize("window", [128, 200, 300])
def test_wide_windows(spark, window):
    rng = np.random.default_rng(window)
    docs = [" ".join("ab" * 400)[: 2 * int(n) - 1] for n in rng.integers(window - 10, 500, 6)]
    docs += [" ".join(f"w{k}" for k in rng.integers(0, 4, 600)) for _ in range(4)]
    docs += [docs[6] + " end", "start " + docs[7], " ".join(docs[8].split()[100:450])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.repeat_digest(df, window=window).collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs, window)


def test_many_equal_rows(spark):
    text = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(5, text)] * 3000 + [(6, f"a {text} b")], "doc_id long, text string").repartition(8)
    got = repeats.repeat_digest(df).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(5, 60, 3000), (6, 60, 1)}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    from velumen.llm.registry import QUERIES

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op3_recompression_dedup"](spark, sf).collect()}
    assert [got[r.doc_id] for r in docs] == brute([r.text for r in docs], 35)


@pytest.mark.parametrize("words", [20, 34, 60])
def test_a_common_phrase_does_not_fill_a_bucket(spark, words):
    """A phrase in all of 3000 otherwise unlike documents: no bucket holds much more than its share, and only repeats go."""
    phrase = " ".join(f"phrase{k}" for k in range(words))
    docs = [(i, " ".join(f"a{i}x{k}" for k in range(50)) + " " + phrase + " " + " ".join(f"b{i}x{k}" for k in range(60))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    keyed = df.select(F.xxhash64("doc_id", "text").alias("uid"), F.lit(0).cast("smallint").alias("chk"), F.encode("text", "UTF-8").alias("text"))
    dealt = repeats.dealt_windows(keyed).where("whole is not null")
    held = [r.n for r in dealt.groupBy("bucket").agg(F.sum(F.length("whole") / repeats.HASH_BYTES).alias("n")).collect()]
    assert max(held) < 3 * sum(held) / len(held) and len(held) > 60
    got = {r.doc_id: r.n_removed for r in repeats.repeat_digest(df).collect()}
    assert set(got.values()) == ({0} if words < 35 else {words})
