import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from velumen.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
KIND = "doc_id long, text string, lang string, source string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def slow(docs, min_docs=30, top=50, prior=5):
    have, n, groups = Counter(), Counter(), set()
    for _, text, lang, source in docs:
        lang, source, terms = lang or "", source or "", TERM.findall(lower(text or ""))
        groups.add((lang, source))
        have.update((lang, t) for t in set(terms))
        n.update((lang, source, t) for t in terms)
    kept = defaultdict(list)
    for (lang, t), d in have.items():
        if d >= min_docs:
            kept[lang].append(t)
    share = lambda c, total, v: 1 + 10**9 * (c + prior) // (total + prior * v)
    out, p = [], {}
    for lang, source in groups:
        total = sum(n[lang, source, t] for t in kept[lang])
        p[lang, source] = {t: share(n[lang, source, t], total, len(kept[lang])) for t in kept[lang]}
    for lang, source in groups:
        whole = {t: sum(n[lang, s, t] for ll, s in groups if ll == lang) for t in kept[lang]}
        q = {t: share(c, sum(whole.values()), len(whole)) for t, c in whole.items()}
        own = p[lang, source]
        pairs = [(sum(abs(own[t] - p[lang, s][t]) for t in own), s) for ll, s in groups if ll == lang and s != source]
        terms = [(own[t] - q[t], t) for t in own if n[lang, source, t] > 0 and own[t] > q[t]]
        for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
            rows.sort(key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (v, item) in enumerate(rows[:most])]
    return out


def check(spark, docs, *, chunk=4096, block=64, **options):
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], KIND + ", n int, chunk string").repartition(5)
    got = divergence.divergence(df, chunk=chunk, block=block, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(slow(docs, **options))


def corpus(n=300, sources=6):
    rng = np.random.default_rng(5)
    words = ["the", "The", "of", "été", "Été", "x1y", "zebra", "a", "ab", "日本", "don't", "—", "ß"] + [f"w{chr(97 + i)}" for i in range(26)]
    return [(i, " ".join(rng.choice(words, rng.integers(0, 40))), ("en", "fr")[i % 2], f"s{int(rng.integers(0, sources))}") for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"min_docs": 3, "top": 4}, {"min_docs": 5, "chunk": 5, "block": 2}])
def test_against_slow_version(spark, options):
    check(spark, corpus(), **options)


def test_odd_rows(spark):
    """Nulls, groups without terms, a language without kept terms, repeated rows, ties, one long text, a hot source."""
    docs = corpus(120, 3) + [(1, None, None, None), (None, "the of", "en", None), (2, "", "en", "empty"), (3, "only", "de", "a"), (4, "1 2", "de", "b"), (4, "1 2", "de", "b")]
    docs += [(5, "same words here", "en", "hot")] * 100 + [(6, "long " * 60_000, "fr", "s1"), (7, "b c a d", "tie", "x"), (8, "d a c b", "tie", "y"), (9, "q", "tie", "z")]
    check(spark, docs, min_docs=2, chunk=3, block=2)


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], KIND)).collect() == []
    check(spark, [(1, None, "en", "a"), (2, "", "en", "b")], min_docs=1)


def test_shares_are_exact_beyond_doubles():
    for c, total, size in [(10**14, 3 * 10**14, 7), (10**12 + 1, 10**12 + 1, 1), (0, 0, 1), (9 * 10**15 - 5, 9 * 10**15 - 5, 1), (1, 9 * 10**14, 10**6)]:
        assert divergence.shares(np.array([c]), total, size)[0] == 1 + 10**9 * (c + 5) // (total + 5 * size)


def test_dense_vectors(spark, monkeypatch):
    """Chunks hold sorted runs of terms, counts beyond doubles stay exact, and rows without number end a chunk between terms."""
    monkeypatch.setattr(divergence, "ROWS", 4)
    big = (1 << 60) + 1
    rows = [("en", f"s{i % 3}", f"t{i // 3:03d}", big if i == 0 else i) for i in range(90)]
    got = divergence.dense_chunks(spark.createDataFrame(rows, "lang string, source string, term string, n long"), chunk=1000).collect()
    whole = {r.chunk: r for r in got if r.source is None}
    seen = Counter()
    for r in got:
        if r.source is not None:
            seen.update({(r.source, t): n for t, n in zip(whole[r.chunk].terms, r.counts, strict=True) if n})
    assert seen == Counter({(s, t): n for _, s, t, n in rows if n})
    assert all(r.terms == sorted(r.terms) and len(r.terms) <= 4 for r in whole.values())
    assert sorted(t for r in whole.values() for t in r.terms) == sorted({t for _, _, t, _ in rows})
    assert max(max(r.counts) for r in whole.values()) == big + 1 + 2
