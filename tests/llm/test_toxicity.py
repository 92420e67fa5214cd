import math
import re
import zlib

import numpy as np
import pytest

from velumen.llm import textcore as tc
from velumen.llm import toxicity


def brute_segments(s):
    """Maximal segments by their definition: recursively the best segment, then left and right of it."""
    best = (0.0, 0, 0)
    for i in range(len(s)):
        total = 0.0
        for j in range(i, len(s)):
            total += s[j]
            if total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and total > 0 and j + 1 - i < best[2] - best[1]):
                best = (total, i, j + 1)
    if best[0] <= 0:
        return []
    _, i, j = best
    return [*brute_segments(s[:i]), (i, j, best[0]), *[(a + j, b + j, t) for a, b, t in brute_segments(s[j:])]]


@pytest.mark.parametrize("seed", range(30))
def test_segments_against_their_definition(seed):
    rng = np.random.default_rng(seed)
    s = rng.normal(size=rng.integers(0, 40)) - 0.2
    got, want = toxicity.segments(s), brute_segments(s)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_best_segments_of_a_block():
    rng = np.random.default_rng(7)
    rows = np.cumsum([0, 5, 0, 12, 1, 0, 30, 0])
    s = rng.normal(size=rows[-1]) - 0.1
    want = [max([0.0, *(s[a:b][i:j].sum() for i in range(b - a) for j in range(i + 1, b - a + 1))]) for a, b in zip(rows, rows[1:], strict=False)]
    assert np.allclose(toxicity.best_segments(s, rows), want)


def corpus(seed=1, n=1200):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choice(vocabulary, rng.integers(20, 200)).tolist()
        toxic = i % 6 == 0
        if toxic:
            k = rng.integers(0, len(w) - 10)
            w[k : k + 10 : 2] = [str(rng.choice(["vileword", "scumbagish", "Badstem"])) + str(rng.choice(["", "ly", "ness"])) for _ in range(5)]
        docs.append((i, " ".join(w)))
        if i % 5:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_and_passages(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.classify(d, lab).collect()
    held = [r for r in got if r.held_out]
    truth = {i: i % 6 == 0 for i, _ in docs}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([bool(r.predicted) == truth[r.doc_id] for r in held]) >= 0.97
    text = dict(docs)
    found = toxicity.passages(d, toxicity.fit(d, lab)).collect()
    assert found and all(text[r.doc_id].encode()[r.start : r.end].decode() == r.passage and r.expect < 0.05 for r in found)
    assert np.mean([truth[r.doc_id] for r in found]) >= 0.9
    clean = toxicity.clean_documents(d.selectExpr("doc_id", "text", "1 AS score", "'x' AS tokens"), lab)
    assert clean.columns == ["doc_id", "text", "score", "tokens"] and {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.predicted}


def test_defined_cases(spark):
    docs, labels = corpus(2, 400)
    odd = [(9000, None), (9001, ""), (9002, "1 2 3"), (9003, "vileword scumbagish " * 50_000), (None, "wab"), (0, docs[0][1])]
    d = spark.createDataFrame([(*r, "x") for r in docs + odd], "doc_id long, text string, label string")
    lab = spark.createDataFrame([*labels, (3, None), (None, 1), (4, 0), (4, 1)], "doc_id long, toxic int")
    got = {}
    for r in toxicity.classify(d, lab).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[9000][0].score == got[9001][0].score == got[9002][0].score < 0.3 and got[9003][0].predicted == 1
    assert got[None][0].held_out is False and len(got[0]) == 2 and got[0][0].score == got[0][1].score


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a b"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.classify(d, none).collect()] == [0.0, 0.0]
    assert toxicity.classify(d.where("doc_id < 0"), none).collect() == []


def slow_score(text, m):
    """Probability of one text, token by token."""
    lower = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    s = []
    for token in re.findall(r"[a-z\u0080-\U0010ffff]+", lower):
        units = [(token, False)] + [(token[:k], True) for k in toxicity.PREFIXES if len(token) > k]
        values = []
        for unit, cut in units:
            raw = np.frombuffer(unit.encode(), np.uint8)
            h = tc.word_hashes(raw, np.array([0]), np.array([len(raw)]))
            values.append(float(m.scores[int((tc.mix(h) if cut else h)[0]) >> 64 - toxicity.BITS]))
        s.append(round((max(values, key=abs) - m.drift) * 65536) / 65536)
    found = brute_segments(np.array(s))
    best, chance = max([0.0, *(x[2] for x in found)]), m.log_k + math.log(max(len(s), 1))
    excess = m.rate * best - chance if best > 0 else min(0.0, -chance)
    told = [m.rate * x[2] - chance for x in found if m.rate * x[2] - chance > -math.log(m.alpha)]
    total = max(excess, 0.0, sum(told))
    x = [1.0, min(max(excess, -20), 20), math.log1p(min(total, 1e6)), math.log1p(len(s)) / 4]
    return 1 / (1 + math.exp(-min(max(sum(a * b for a, b in zip(x, m.curve, strict=True)), -30), 30))), len(told)


def test_against_a_slow_version(spark):
    docs, labels = corpus(3, 900)
    odd = [(5000, None), (5001, "VILEWORD, scumbagishly! éclairsé badstemness 12"), (5002, "ééééééééé " * 6 + "vileword")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.fit(d, lab)
    probe = [(i, t and " ".join(t.split()[:45])) for i, t in docs[:80] + odd]
    got = {r.doc_id: r for r in toxicity.measure(spark.createDataFrame(probe, "doc_id long, text string"), m).collect()}
    some = 0
    for i, t in probe:
        score, n = slow_score(t, m)
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].n_passages == n
        some += n
    assert some > 5


def test_counts_and_log_odds_against_a_slow_version(spark):
    docs, labels = corpus(4, 60)
    label = dict(labels)
    df = spark.createDataFrame([(t, label.get(i)) for i, t in docs], "text string, label int").repartition(3)
    got, want = toxicity.token_counts(df), np.zeros((3, toxicity.SIZE), dtype=np.int64)
    for i, t in docs:
        raw = np.frombuffer(t.encode(), np.uint8)
        units = toxicity.tokens(raw, np.array([0, len(raw)]))[0].ravel()
        for u in units[units < toxicity.SIZE]:
            want[2, u] += 1
            if i in label:
                want[0 if label[i] else 1, u] += 1
    assert np.array_equal(got, want)


def test_beginnings_are_cut_between_letters():
    raw = np.frombuffer("éàüöñçxyz abcdefgh".encode(), np.uint8)
    units = toxicity.tokens(raw, np.array([0, len(raw)]))[0]
    for i, k in enumerate(toxicity.PREFIXES):
        cut = np.frombuffer("éàüöñçxyz"[:k].encode(), np.uint8)
        h = tc.mix(tc.word_hashes(cut, np.array([0]), np.array([len(cut)])))
        assert units[i + 1, 0] == int(h[0]) >> 64 - toxicity.BITS


def test_whole_table(spark, sf):
    from velumen.llm.registry import QUERIES

    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = QUERIES["op8_toxic_segments"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == ids and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
