import re
from collections import Counter, defaultdict

import corpus_pipeline
from velumen.llm import toxicity
from velumen.llm.scratch import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows(texts):
    words = [WORD.findall(t or "") for t in texts]
    return words, Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))


def test_each_stage_on_what_the_last_one_kept(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    seen = [docs.toPandas()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path / name)
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(at)
        docs = spark.read.parquet(at)
        seen.append(docs.toPandas())
    raw, clean, unique, cut, mixed, packed = seen
    model = toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).toPandas()
    assert set(clean.doc_id) == set(model[model.predicted == 0].doc_id) and 0 < len(clean) <= len(raw)
    sets = {}
    for r in unique.itertuples():
        w = WORD.findall((r.text or "").lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    ids = sorted(sets)
    assert not any(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :])
    words, counts = windows(list(unique.text))
    left = dict(zip(cut.doc_id, cut.text, strict=True))
    for i, w in zip(unique.doc_id, words, strict=True):
        gone = {p for k in range(len(w) - 34) if counts[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        assert WORD.findall(left[i] or "") == [x for p, x in enumerate(w) if p not in gone]
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in cut.itertuples()}
    got = Counter()
    for r in mixed.itertuples():
        got[r.doc_id] += len(WORD.findall(r.text or ""))
    assert all(n <= 3 * size[i] for i, n in got.items())
    assert abs(sum(got.values()) - sum(size.values())) <= 0.01 * sum(size.values())
    per = defaultdict(int)
    for r in packed.itertuples():
        per[r.doc_id] += r.length
    tokens = packed.groupby("sequence_id").length.sum()
    assert set(per) == set(mixed.doc_id) and all(n == 2048 or n & (n - 1) == 0 for n in tokens)


def test_run_gives_the_packed_rows(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def stages(spark, docs, folder):
    """What each stage returns, each on the written result of the last one."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        got.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(got.schema).parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_odd_tables(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and columns whose names the operators use themselves; then no rows at all."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, id long, score double, rank int, slot long, words array<string>"
    rest = (1, "k", 2, 0.5, 3, 4, ["w"])
    rows = [(i, f"some words of text {i} and {i * i}", "en", "a", 9, *rest) for i in range(8)] + [(None, None, None, None, None, *([None] * 7)), (9, "", None, "a", 0, *rest), (9, "", None, "a", 0, *rest), (10, None, "en", None, 0, *rest), (None, "lone words", None, None, 1, *rest)]
    for name, docs, labels in (("some", rows, [(1, 1, 0), (2, 0, None), (None, None, 1)]), ("none", [], [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.createDataFrame(docs, kind)
        docs.write.parquet(f"{folder}/documents.parquet")
        got = stages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert all(g.columns == docs.columns for g in got[:-1])
        kept = [g.count() for g in got[:-1]]
        if name == "none":
            assert kept == [0, 0, 0, 0] and got[-1].count() == 0
        else:
            assert kept[:3] == [13, 13, 13]  # nothing here is toxic, near another or repeated
            assert {r.doc_id for r in got[3].collect()} <= {None, *range(8)} and got[4].count() >= got[3].count()
