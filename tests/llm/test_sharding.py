import hashlib

import pytest

from velumen.llm.scratch import Scratch
from velumen.llm.sharding import Conflict, Store, stored_digest

DOCS = "doc_id long, text string, bytes int"


def make(spark, **kw):
    return Store(spark, Scratch(spark, "test").root, **kw)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_append_compact_read(spark):
    store, want = make(spark, target_bytes=4000), []
    for k in range(9):
        part = [(k * 10 + i, None if i == 3 else f"text {k} {i}", i) for i in range(10)] + [(None, "x", None)]
        want += part
        store.append(spark.createDataFrame(part, DOCS).coalesce(1))
    first = store.manifest()
    assert first["version"] == 9 and len(first["shards"]) == 9
    version = store.compact()
    now = store.manifest()
    assert version == now["version"] == 10 and len(now["shards"]) < 9 and sum(s["rows"] for s in now["shards"]) == len(want)
    assert rows(store.read()) == sorted(want, key=str)
    assert rows(store.read(store.manifest(3))) == sorted(want[:33], key=str)
    assert store.compact() == version
    assert store.expire() > 0 and store.versions() == [10] and rows(store.read()) == sorted(want, key=str)


def test_empty_and_missing(spark):
    store = make(spark)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.append(spark.createDataFrame([(1, "a", 1)] * 2, DOCS))
    before = store.manifest()["version"]
    assert store.append(spark.createDataFrame([], DOCS)) == before and rows(store.read()) == [(1, "a", 1)] * 2


def test_concurrent_commit_conflicts_and_late_compaction_gives_way(spark):
    store = make(spark)
    for i in range(4):
        store.append(spark.createDataFrame([(i, "t", 0)], DOCS).coalesce(1))
    base = store.manifest()
    store.append(spark.createDataFrame([(9, "u", 0)], DOCS))
    with pytest.raises(Conflict):
        store.commit(base["version"], [], base["schema"])
    assert len(rows(store.read())) == 5


def test_expire_beside_an_append_that_is_not_committed(spark):
    store, other = make(spark), None
    store.append(spark.createDataFrame([(1, "a", 1)], DOCS).coalesce(1))
    other = Store(spark, store.root)
    change, n = other._change, []

    def late(schema, edit):
        n.append(store.expire())  # after the files are written, before they are committed
        return change(schema, edit)

    other._change = late
    other.append(spark.createDataFrame([(2, "b", 2)], DOCS).coalesce(1))
    assert n == [0] and rows(store.read()) == [(1, "a", 1), (2, "b", 2)]
    assert store.expire() == 0 and rows(store.read()) == [(1, "a", 1), (2, "b", 2)]


def test_files_of_writers_that_are_gone_expire(spark):
    store = make(spark)
    store.append(spark.createDataFrame([(1, "a", 1)], DOCS).coalesce(1))
    store._write(spark.createDataFrame([(2, "b", 2)], DOCS).coalesce(1))
    assert store.expire() == 0 and store.expire(abandoned=-1) == 1 and rows(store.read()) == [(1, "a", 1)]


def test_compaction_beside_appends_and_expiry(spark):
    store = make(spark)
    for i in range(4):
        store.append(spark.createDataFrame([(i, "t", 0)], DOCS).coalesce(1))
    other, change = Store(spark, store.root), store._change

    def late(schema, edit):
        store._change = change
        other.append(spark.createDataFrame([(9, "u", 0)], DOCS).coalesce(1))
        other.expire()
        return change(schema, edit)

    store._change = late
    store.compact()
    other.expire()
    assert rows(store.read()) == [(0, "t", 0), (1, "t", 0), (2, "t", 0), (3, "t", 0), (9, "u", 0)]


def test_a_taken_version_is_refused(spark):
    store = make(spark)
    store.append(spark.createDataFrame([(1, "a", 1)], DOCS).coalesce(1))
    store.versions = lambda: []  # a writer that has not seen version 1
    with pytest.raises(Conflict):
        store.commit(0, [], spark.createDataFrame([], DOCS).schema.json())


def test_arrivals_by_one_scan_and_older_versions(spark):
    store = make(spark)
    store.append_arrivals(spark.createDataFrame([(i, f"t{i}", i, i % 3) for i in range(30)], DOCS + ", part int").repartition(4), "part")
    assert store.versions() == [1, 2, 3] and len(rows(store.read())) == 30 and len(rows(store.read(store.manifest(2)))) == 20
    store.compact()
    store.expire(keep=2)
    assert store.versions() == [3, 4] and len(rows(store.read(store.manifest(3)))) == len(rows(store.read())) == 30
    assert store.append_arrivals(spark.createDataFrame([], DOCS + ", part int"), "part") == 4


def test_digest_of_odd_rows(spark):
    text = "é" * 3_000_000
    docs = spark.createDataFrame([(1, text, "en", "a", 7), (1, text, "en", "a", 7), (None, None, None, None, None), (2, "", "de", "b", 1)], "doc_id long, text string, lang string, source string, batch0 int")
    got = rows(stored_digest(docs, Scratch(spark, "test").root).select("doc_id", "n_bytes", "text_sha256"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, 6_000_000, sha(text))] * 2 + [(None, 0, sha("")), (2, 0, sha(""))], key=str)
    assert rows(stored_digest(docs.limit(0), Scratch(spark, "test").root)) == []


def test_tiers_are_planned_apart(spark):
    store = make(spark, target_bytes=1000)
    size = lambda *n: [{"file": f"f{i}", "bytes": b, "rows": 1} for i, b in enumerate(n)]
    runs = store.plan(size(5, 6, 7, 8, 300, 310, 900, 5000))
    assert [[s["bytes"] for s in r] for r in runs] == [[5, 6, 7, 8]]
    runs = store.plan(size(300, 310, 320, 330, 340))
    assert [[s["bytes"] for s in r] for r in runs] == [[300, 310, 320], [330, 340]]


def test_whole_table(spark, sf):
    from velumen.llm.registry import QUERIES

    assert QUERIES["op10_tiered_compaction"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
