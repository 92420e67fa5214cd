import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from velumen.llm import lines
from velumen.llm import textcore as tc

KIND = "doc_id long, text string"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def slow(docs, min_docs=2, min_points=1, keep="none", hot=None):
    """(doc_id, n_lines, n_dropped, kept text) of every document."""
    split = [(t or "").split("\n") for _, t in docs]
    have = Counter(k for parts in split for k in {key(x) for x in parts})
    doomed = {k for k, n in have.items() if n >= min_docs and len(k) >= min_points}
    place = [(i is None, i or 0, hashlib.sha256(f"{'null' if i is None else '=' + str(i)}\n{t or ''}".encode()).digest()) for i, t in docs]
    first = {}
    for p, parts in zip(place, split, strict=True):
        for k in {key(x) for x in parts} & doomed:
            first[k] = min(first.get(k, p), p)
    out = []
    for (i, _), p, parts in zip(docs, place, split, strict=True):
        left, met = [], set()
        for x in parts:
            k = key(x)
            if k not in doomed or keep == "first" and first[k] == p and k not in met:
                left.append(x)
            met.add(k)
        out.append((i, len(parts), len(parts) - len(left), "\n".join(left)))
    return out


def check(spark, docs, **options):
    df = spark.createDataFrame([(*d, "x") for d in docs], KIND + ", key string").repartition(5)
    got = lines.line_digest(df, **options).collect()
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in slow(docs, **options)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def corpus(n=120):
    rng = np.random.default_rng(3)
    common = ["All rights reserved.", "  all RIGHTS reserved.\t", "ÉCOLE", "école", "", " \x0b", "x", "é", "next page " * 40]
    docs = []
    for i in range(n):
        own = [f"line {i} {j}" for j in range(rng.integers(0, 6))] + [common[k] for k in rng.integers(0, len(common), 4)] + [f"shared {i // 3}"] * int(rng.integers(0, 3))
        docs.append((i, "\n".join(rng.permutation(own))))
    return docs


@pytest.mark.parametrize("options", [{"min_docs": 10}, {"keep": "first"}, {"keep": "first", "min_docs": 3, "min_points": 2, "hot": 1}, {"min_points": 0, "hot": 10**9}])
def test_against_slow_version(spark, options):
    check(spark, corpus(), **options)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_odd_rows(spark, keep):
    long = "\n".join(f"w{i % 7000}" for i in range(50_000)) + "\n" + "y" * 500_000
    docs = [(1, None), (2, ""), (None, None), (None, "a\nb"), (None, "a\nb"), (3, "a"), (3, "a\na\nb\na"), (3, "a\na\nb\na"), (4, "\n\n"), (5, "b\n"), (6, long), (7, long), (8, "z\0z\nz\0z")]
    check(spark, docs, keep=keep)


def test_empty_and_columns(spark):
    assert lines.line_digest(spark.createDataFrame([], KIND)).collect() == []
    df = spark.createDataFrame([(1, "a\nb", "k", 1, [1]), (2, "A \nc", "k", 2, None), (3, None, None, 3, [])], "doc_id long, text string, place string, lines int, c1 array<int>")
    got = lines.without_repeated_lines(df)
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "b", "k", 1, [1]), (2, "c", "k", 2, None), (3, None, None, 3, [])]))
    with pytest.raises(ValueError):
        lines.line_digest(df, min_docs=1)


def test_filter_holds_every_repeated_key_and_few_others(spark):
    """A task sees keys once; the filter finds those that two tasks have, and lets a hundredth of the others through."""
    texts = [(f"both {i}",) for i in range(5000)] * 2 + [(f"one {i}",) for i in range(200_000)]
    df = spark.createDataFrame(texts, "text string").repartition(7)
    seen = lines.seen_twice(df, lines.STRETCH, 1)
    hashed = lambda xs: np.concatenate([tc.word_hashes(b := np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(b)])) for x in xs])
    assert seen.test(hashed([f"both {i}" for i in range(5000)])).all()
    assert seen.test(hashed([f"one {i}" for i in range(20_000)])).mean() < 0.02
    assert hashed(["both 3"])[0] in seen


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "STRETCH", 64)
    monkeypatch.setattr(lines, "FLUSH", 50)
    docs = corpus()
    df = spark.createDataFrame(docs, KIND).repartition(5)
    spread = lines.line_digest(df, most_bits=64).orderBy("doc_id").collect()
    monkeypatch.undo()
    assert spread == lines.line_digest(df).orderBy("doc_id").collect()


def test_a_line_of_all_documents_is_not_shuffled_to_one_task(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("copyright\nown "), "id", F.lit("\npair "), F.expr("id div 2").cast("string")).alias("text"))
    marks = lines.doomed_lines(docs, min_docs=2)
    assert marks.count() == 4000 and marks.where("size(lines) = 2").count() == 4000
