import math
import zlib
from collections import Counter

import numpy as np

from velumen.llm import langid

SYLLABLES = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "ein", "ung", "ber"], "zz": ["ção", "nho", "lha", "dade"]}


def corpus(seed, n=240):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(rng.integers(3, 60))]
        rows.append((i, " ".join(words), None if i % 17 == 0 else lang, lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, known) for i, t, known, _ in rows], "doc_id long, text string, lang string").repartition(3)
    truth = {i: lang for i, _, _, lang in rows}
    got = langid.identify(df).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and 40 < len(held) < 120
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95 and all(0 <= r.score <= 1 for r in got)


def test_defined_cases(spark):
    rows = [(i, t, lang) for i, t, _, lang in corpus(2, 90)]
    odd = [(1000, None, "xx"), (1001, "", None), (1002, " 12 … 3!", "yy"), (1003, "漢字かな", None), (None, "karomi tuka", "xx"), (1005, "k", None), (1006, "schein " * 100_000, None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows + odd], "doc_id long, text string, lang string, source string, score double")
    got = {}
    for r in langid.identify(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000][0].score == 0 and got[1002][0].rejected
    assert got[1003][0].lang_pred in SYLLABLES and got[1006][0].lang_pred == "yy" and got[None][0].held_out is False
    assert got[1003][0].rejected and len(got[0]) == 2


def test_far_texts_are_rejected_and_predictions_ignore_other_columns(spark):
    rows = [(i, t, lang) for i, t, _, lang in corpus(3, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.select("text", "lang"))
    probe = spark.createDataFrame([(1, "qqqq wwww xxxx zzzz vvvv"), (2, "karomi tuka mitu")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(probe, model).collect()}
    assert got[1].rejected and got[1].distance > got[2].distance and got[2].lang_pred == "xx"


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(5, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(df.where("doc_id < 0")).collect() == []


def slow_prediction(text, model):
    """(language, cosine) of one text, trigram by trigram."""
    raw = [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in raw]
    counts = Counter()
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        if (a, b) != (32, 32):
            counts[((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - langid.BITS] += 1
    weight = {g: math.log1p(n) * float(model.idf[g]) for g, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in weight.values()))
    if not any(ch.isalpha() for ch in text or "") or not norm:
        return "und", 0.0
    cosines = [sum(x / norm * float(c[g]) for g, x in weight.items()) for c in model.centroids]
    best = max(range(len(cosines)), key=cosines.__getitem__)
    return model.langs[model.owner[best]], cosines[best]


def test_against_a_slow_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("lang is not null").where(~langid.held_out()).select("text", "lang"))
    assert len(model.langs) > 1 and len(model.centroids) > len(model.langs)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.predict(docs.select("doc_id", "text"), model).collect():
        lang, cosine = slow_prediction(texts[r.doc_id], model)
        assert r.lang_pred == lang and (lang == "und" or abs(1 - r.distance - cosine) < 1e-4)


def test_document_frequencies(spark):
    texts = ["abc abc", "xabc", None, "", "abd é"]
    df, n = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    c = langid.counts(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))[0]
    assert n == len(texts) and df[int(np.argmax(c))] == 2


def test_whole_table(spark, sf):
    from velumen.llm.registry import QUERIES

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op2_nearest_centroid_language"](spark, sf).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    told = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id]]
    assert len(told) > 20 and np.mean(told) >= 0.95


def test_repeated_texts_do_not_fill_the_sample(spark):
    rows = [("karo mitu " * 3, "xx")] * 900 + [(t, lang) for _, t, _, lang in corpus(4, 120)]
    df = spark.createDataFrame(rows, "text string, lang string")
    one, two = (langid.fit(df.repartition(n), per_lang=30) for n in (2, 5))
    assert np.allclose(one.centroids, two.centroids, atol=1e-5) and (one.owner == langid_owner(one, "xx")).sum() > 1


def langid_owner(model, lang):
    return model.langs.index(lang)
