import re
from itertools import combinations

import numpy as np
import pytest

from velumen.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    """(size, component, kept) by row; rows of one id are one node."""
    sets = [shingles(t) for _, t in docs]
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, _), a, (j, _), b in ((docs[x], sets[x], docs[y], sets[y]) for x, y in combinations(range(len(docs)), 2)):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted([(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(docs, sets, strict=True)], key=str)


def run(spark, docs, n=4):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, kept string").repartition(n)
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()], key=str)


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    base = [[f"w{k}" for k in rng.integers(0, 500, rng.integers(1, 160))] for _ in range(n // 3)]
    docs = []
    for i in range(n):
        w = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(len(w))] = f"z{rng.integers(99)}"
        docs.append((1000 - 7 * i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    assert run(spark, docs) == brute(docs)


def test_defined_cases(spark):
    same = "one two three four five six seven"
    docs = [(1, None), (2, ""), (3, "Hi"), (4, "hi"), (5, "hi there"), (6, same), (9, same), (8, same.upper()), (None, same), (7, " \t\n"), (10, "É é"), (11, "é é")]
    assert run(spark, docs) == brute(docs)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_and_chain(spark):
    words = [f"w{i}" for i in range(120)]
    chain = [(i, " ".join(f"q{i}x{j}" if j < 2 * i else words[j] for j in range(120))) for i in range(1, 9)]
    docs = chain + chain[:2]
    got = run(spark, docs)
    assert got == brute(docs) and len(got) == 10


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "MEET_ROWS", 3)
    monkeypatch.setattr(minhash, "MEET_BYTES", 4000)
    docs = corpus(5, 90)
    assert run(spark, docs) == brute(docs)


def test_rows_of_one_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = [(3, a), (5, a), (5, b), (7, b), (8, None), (8, c), (2, c), (8, ""), (9, ""), (9, None), (5, a), (5, a)]
    got = run(spark, docs)
    assert got == brute(docs) and {r[0]: r[2] for r in got} == {3: 3, 5: 3, 7: 3, 8: 2, 2: 2, 9: 9}


def test_words_that_fool_linear_hashes(spark):
    parity = lambda n, flip: "".join("ab"[(i.bit_count() & 1) ^ flip] for i in range(n))
    docs = [(n + flip, parity(n, flip)) for n in (16, 512, 1024, 4096) for flip in (0, 1)]
    assert run(spark, docs) == brute(docs)


def test_all_links_near_the_threshold(spark):
    """Pairs of similarity 0.75 and little more: no candidate is lost to bands or estimates."""
    docs, near = [], 0
    for i in range(400):
        words = [f"p{i}w{j}" for j in range(60)]
        other = words[: 53 + i % 3] + [f"p{i}x{j}" for j in range(6)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        x, y = shingles(docs[-1][1]), shingles(docs[-2][1])
        near += 100 * len(x & y) >= 75 * len(x | y)
    got = {r[0]: r[2] for r in run(spark, docs)}
    assert near == 400 and all(got[2 * i + 1] == 2 * i for i in range(400))


def test_very_long_text(spark):
    words = [f"w{i * 7919 % 300007}" for i in range(250_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:230_000])), (3, " ".join(words[:150_000])), (4, "w0 " * 400_000)]
    assert [(r[0], r[2]) for r in run(spark, docs)] == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_whole_table(spark, sf):
    from velumen.llm.registry import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op4_bbit_minhash"](spark, sf).collect()
    assert sorted([tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in got], key=str) == brute(docs)


def test_deduplicated_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a b c", "x"), (1, "A b c", "y"), (3, "d", "z"), (None, "a b c", "n")], "doc_id long, text string, source string")
    got = minhash.deduplicated(df)
    assert got.columns == df.columns and {r.source for r in got.collect()} == {"y", "z", "n"}


def template(n, common=60, own=17, seed=0):
    """Documents that share one stretch of words and have some of their own: similar, but not enough."""
    shared = [f"t{i}" for i in range(common)]
    return [(i, " ".join(shared + [f"o{seed}x{i}x{j}" for j in range(own)])) for i in range(n)]


@pytest.mark.parametrize("n", [1000])
def test_documents_of_one_template_do_not_ask_each_other(spark, monkeypatch, n):
    asked = []
    whole = minhash._mixed
    monkeypatch.setattr(minhash, "_mixed", lambda *a: asked.append(r := whole(*a)) or r)
    docs = template(n)
    near = [(10_000 + i, docs[7 * i][1] + " " + " ".join(f"e{i}x{k}" for k in range(3))) for i in range(20)]
    got = run(spark, docs + near)
    links = {i: 7 * (i - 10_000) for i, _ in near}
    assert [(r[0], r[2]) for r in got] == sorted(((i, links.get(i, i)) for i, _ in docs + near), key=str)
    assert asked[0].count() <= 2 * n


@pytest.mark.parametrize("seed", [0, 1])
def test_similar_templates_against_brute_force(spark, monkeypatch, seed):
    """Buckets of many components, with pairs on both sides of the threshold."""
    monkeypatch.setattr(minhash, "FEW", 2)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = np.random.default_rng(seed)
    shared, docs = [f"t{i}" for i in range(60)], []
    for i in range(90):
        w = shared + [f"o{int(rng.integers(0, 30))}x{j}" for j in range(int(rng.integers(5, 25)))]
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = f"z{int(rng.integers(9))}"
        docs.append((i, " ".join(w)))
    assert run(spark, docs) == brute(docs)


def test_rare_shingles_are_shared_by_similar_sets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i, np.unique(rng.integers(0, 400, int(rng.integers(1, 60))).astype(np.uint64) << np.uint64(54)).tobytes()) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, w long, s binary")
    lead, probe = {}, {}
    for r in minhash.rare_shingles(df, 75).collect():
        probe.setdefault(r.id, set()).add(r.key)
        if r.leads:
            lead.setdefault(r.id, set()).add(r.key)
    sets = {i: set(np.frombuffer(s, np.uint64).tolist()) for i, _, s in rows}
    for i, j in combinations(sets, 2):
        a, b = sorted((i, j), key=lambda x: (len(sets[x]), x))
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            assert lead[a] & probe[b]
    assert minhash.rare_first(df.select("s")).sum() == sum(map(len, sets.values()))
