import re
from collections import Counter, defaultdict

import pytest

from velumen.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes):
    """Targets by resharing the excess over and over."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        free = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        target = {s: 3.0 * sizes[s] for s in capped} | {s: free * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def check(docs, got, block=2048):
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    per = Counter()
    for (_, _, s), n in zip(docs, size, strict=True):
        per[s] += n
    target, taken = reshared(dict(per)), Counter()
    assert sorted((str(i), n) for (i, _, _), n in zip(docs, size, strict=True)) == sorted((str(r.doc_id), r.size) for r in got)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == per[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in target)


def corpus(n=60):
    sources = ["a", "b", "B", "é", None, "tiny"]
    return [(i, None if i % 11 == 0 else "w " * (i * 7 % 90), "tiny" if i == 59 else sources[i % 5]) for i in range(n)]


@pytest.mark.parametrize("block", [7, 2048])
def test_targets_and_takes(spark, block):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int").repartition(4)
    got = mixing.Mix(df, block=block).taken().collect()
    check(docs, got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.Mix(df.repartition(2), block=block).taken().collect()))


def test_defined_cases(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.Mix(spark.createDataFrame([], kind)).taken().collect() == []
    nothing = mixing.Mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], kind)).taken().collect()
    assert [(r.size, r.taken) for r in nothing] == [(0, 0), (0, 0)]
    docs = [(1, "a b c", "x")] * 3 + [(None, "d e", "x"), (None, "f", None)]
    check(docs, mixing.Mix(spark.createDataFrame(docs, kind), block=2).taken().collect())


def test_every_stretch_of_the_schedule_is_in_proportion(spark):
    docs = [(i, "w " * 100, "abcd"[i % 4]) for i in range(200)]
    mix = mixing.Mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), block=20)
    slots = mix.slots(mix.totals()[1]).orderBy("slot").collect()
    share = {r.source: r.take / 20_000 for r in mix.sources.collect()}
    assert len(slots) == mix.totals()[1]
    ranks, seen = defaultdict(list), Counter()
    for n, r in enumerate(slots, 1):
        seen[r.source] += 1
        ranks[r.source].append(r["rank"])
        assert all(abs(seen[s] - share[s] * n) <= 8 for s in share)
    assert all(x == list(range(len(x))) for x in ranks.values())


def test_pieces_are_blocks_of_equal_tokens(spark):
    mix = mixing.Mix(spark.createDataFrame(corpus(), "doc_id long, text string, source string"), block=50)
    words, last = Counter(), {r.source: r.take for r in mix.sources.collect()}
    source = {}
    for r in mix.pieces().collect():
        words[r.slot] += r.words
        source[r.slot] = r.source
    short = Counter(source[s] for s, n in words.items() if n != 50)
    assert all(n <= 50 for n in words.values()) and all(n <= 1 for n in short.values()) and sum(words.values()) == sum(last.values())


def test_mixed_documents(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in docs], "doc_id long, text string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixing.Mix(df).taken().collect()}
    got, text = Counter(), {i: WORD.findall(t or "") for i, t, _ in docs}
    for r in mixing.mixed_documents(df).collect():
        w = WORD.findall(r.text)
        assert w == text[r.doc_id][: len(w)] and r.n_chars == len(r.text)
        got[r.doc_id] += len(w)
    assert got == Counter({i: n for i, n in taken.items() if n})


def test_alike_rows_and_clashing_columns(spark):
    docs = [(1, f"a{i} b c d e", "x", i) for i in range(3)] + [(None, "p q", "x", 8), (None, "r s", "x", 9), (2, "u v w", "y", 1)]
    kind = "doc_id long, text string, source string, _size int, _taken int, _part int, n int, slot int, t int"
    df = spark.createDataFrame([(*d, 1, 2, 3, 4, 5) for d in docs], kind)
    want = sum(r.taken for r in mixing.Mix(df, block=2).taken().collect())
    rows = mixing.mixed_documents(df, block=2).collect()
    assert sum(len(WORD.findall(r.text)) for r in rows) == want == 22 and {(r._taken, r.n, r.slot, r.t) for r in rows} == {(1, 3, 4, 5)}
    whole = {d[1]: d[3] for d in docs}
    assert all(whole.get(r.text, r._size) == r._size for r in rows)


def test_the_mixture_is_in_the_order_of_the_schedule(spark):
    docs = [(i, f"w{i} " * 30, "abcd"[i % 4]) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    first = {r.doc_id: r.first_slot for r in mixing.Mix(df, block=10).taken().collect()}
    got = [r.doc_id for r in mixing.mixed_documents(df, block=10).collect()]
    once = list(dict.fromkeys(got))
    assert [first[i] for i in once] == sorted(first[i] for i in once)
    # Sources alternate in proportion to their share from the start.
    head = Counter("abcd"[i % 4] for i in got[:30])
    assert set(head) == set("abcd") and head["a"] > head["c"]
