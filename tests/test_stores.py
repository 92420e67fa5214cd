"""Journals and what stands on them: the event log, the pair table, counters, re-embedding, layouts, rules and clones."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from velumen.functions import encoder
from velumen.operators import eventlog, events, numbering, pairs, pairtable, reindex, search
from velumen.operators.sequences import Sequences
from velumen.sources import clone, layout, rules, schema
from velumen.sources.journal import Busy, Journal


def at(tmp_path, name="store"):
    return f"file://{tmp_path}/{name}"


# Journal and numbers -----------------------------------------------------------------------------------------------


def test_journal_gives_each_number_once(spark, tmp_path):
    writers = [Journal(spark, at(tmp_path)) for _ in range(4)]
    run = lambda j, k: [j.commit(lambda now, i=i: {"kind": "x", "who": [k, i], "seen": len(now)}) for i in range(6)]
    threads = [threading.Thread(target=run, args=(j, k)) for k, j in enumerate(writers)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    entries = Journal(spark, at(tmp_path)).entries()
    assert [e["number"] for e in entries] == list(range(1, 25)) and [e["seen"] for e in entries] == list(range(24))
    assert sorted(tuple(e["who"]) for e in entries) == [(k, i) for k in range(4) for i in range(6)]
    assert writers[0].commit(lambda now: None) is None
    writers[1].commit(lambda now: {"kind": "base", "base": True})
    assert [e["number"] for e in writers[2].entries()] == [25]
    stuck = Journal(spark, at(tmp_path), publish=lambda aside, place: False, tries=3)
    with pytest.raises(Busy):
        stuck.commit(lambda now: {"kind": "x"})


def test_numbers_of_a_table_with_a_hot_row(spark, monkeypatch):
    kept, whole = [], numbering.shared.keep
    rows = [("{}",)] * 3000 + [(f"p{i}",) for i in range(1000)]
    df = spark.createDataFrame(rows, "payload string").repartition(7)
    got = numbering.numbered(df, "payload")
    assert sorted(r.number for r in got.collect()) == list(range(1, 4001))
    assert [r.payload for r in got.orderBy("number").collect()] == sorted(p for (p,) in rows)
    assert numbering.numbered(df.limit(0), "payload").collect() == []
    monkeypatch.setattr(numbering.shared, "keep", lambda df, label: kept.append(whole(df, label)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbering.numbered(df.withColumn("payload", F.lit("{}")), "payload").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in kept[-1].groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 3000


# Event log ---------------------------------------------------------------------------------------------------------


def batch(spark, rows):
    return spark.createDataFrame(rows, "event_type string, payload string, created_at timestamp_ntz")


def told(spark, *rows):
    return batch(spark, [(kind, f'{{"id":"{i}"}}', None) for kind, i, _ in rows]).drop("created_at") if rows and rows[0][2] is None else spark.createDataFrame([(kind, f'{{"id":"{i}"}}', t) for kind, i, t in rows], "event_type string, payload string, t int").select("event_type", "payload", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, t)").alias("created_at"))


def images(spark, n=6):
    return spark.createDataFrame([(i, False, None if i == 2 else True) for i in range(n)], "id long, deleted boolean, searchable boolean")


def flags(df):
    return sorted((r.id, r.deleted, r.searchable) for r in df.collect())


def test_batches_count_once_and_ids_are_given_once(spark, tmp_path):
    one, two = (eventlog.EventLog(spark, at(tmp_path)) for _ in range(2))
    rows = [("a", "{}")] * 5 + [("b", None)]
    df = spark.createDataFrame(rows, "event_type string, payload string")
    results = []
    send = lambda log, key: results.append(log.append(df, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), batch=key))
    threads = [threading.Thread(target=send, args=x) for x in ((one, "x"), (two, "y"), (one, "x"))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(results) == [False, True, True]
    assert not two.append(df, F.current_timestamp(), batch="x")
    got = one.read().collect()
    assert sorted(r.id for r in got) == list(range(1, 13)) and one.published("y") and not one.published("z")
    assert two.append(df.limit(0), F.current_timestamp(), batch="none") and not two.append(df.limit(0), F.current_timestamp(), batch="none")
    with pytest.raises(ValueError):
        one.reserve(7, "x")


def test_an_attempt_that_died_leaves_its_range_to_the_next(spark, tmp_path):
    log = eventlog.EventLog(spark, at(tmp_path))
    assert log.reserve(3, "slow").first == 1 and log.reserve(2, "quick").first == 4
    assert log.append(told(spark, ("imageDeleted", 1, None), ("imageDeleted", 2, None)), F.current_timestamp(), batch="quick")
    assert log.read().count() == 2 and sorted(r.id for r in log.read().collect()) == [4, 5]
    assert log.append(told(spark, *[("imageDeleted", 3, None)] * 3), F.current_timestamp(), batch="slow")
    assert sorted(r.id for r in log.read().collect()) == [1, 2, 3, 4, 5]


def test_snapshot_and_tail_equal_the_whole_log(spark, tmp_path):
    rng = np.random.default_rng(7)
    log, kinds = eventlog.EventLog(spark, at(tmp_path)), [k for pair in eventlog.FLAGS.values() for k in pair] + ["getRandom"]
    for i in range(5):
        rows = [(kinds[rng.integers(0, 5)], int(rng.integers(0, 6)), int(rng.integers(0, 50))) for _ in range(12)]
        log.append(told(spark, *rows), batch=str(i))
        if i in (1, 2):
            log.snapshot()
        if i == 3:
            log.compact()
            assert log.tail().count() == 12  # of the batch after the second snapshot
        assert flags(log.images(images(spark))) == flags(eventlog.replayed(images(spark), log.read()))
    assert log.tail().count() == 24 and log.read().count() == 60 and not log.append(told(spark, ("getRandom", 1, 1)), batch="0")
    assert sorted(r.id for r in log.read().collect()) == list(range(1, 61))
    log.append(told(spark, ("getRandom", 1, 1)), batch="more")
    assert log.read().agg(F.max("id")).first()[0] == 61


def test_a_late_event_counts_by_its_time(spark, tmp_path):
    """An event of an older time in the tail changes nothing; a batch reserved before the snapshot and published after it counts."""
    log = eventlog.EventLog(spark, at(tmp_path))
    log.reserve(1, "reserved")
    log.append(told(spark, ("imageDeleted", 1, 20), ("imageDeleted", 3, 20)), batch="a")
    log.snapshot()
    log.append(told(spark, ("imageUndeleted", 1, 10), ("imageUndeleted", 3, 30)), batch="late")
    log.append(told(spark, ("setImageNotSearchable", 2, 5)), batch="reserved")
    assert log.read().where("id = 1").first().event_type == "setImageNotSearchable"
    assert flags(log.images(images(spark))) == [(0, False, True), (1, True, True), (2, False, False), (3, False, True), (4, False, True), (5, False, True)]
    assert log.tail().count() == 3
    empty = eventlog.EventLog(spark, at(tmp_path, "empty"))
    assert empty.read().collect() == [] and flags(empty.images(images(spark))) == flags(images(spark)) and empty.snapshot() == 0


def test_append_numbers_equal_payloads(spark):
    log = spark.createDataFrame([(5,)], "id long")
    new = spark.createDataFrame([("adminUserLogout", "{}")] * 500 + [("a", None)], "event_type string, payload string")
    got = events.append(log, new, F.current_timestamp()).orderBy("id").collect()
    assert [r.id for r in got] == list(range(6, 507)) and got[0].event_type == "a"


# Pair table --------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def same_pairs(table, df):
    plain = lambda x: sorted((r.id1, r.id2, None if r.distance is None else round(r.distance, 9)) for r in x.collect())
    got = plain(table.read())
    assert got == plain(pairs.image_neighbor(df)) and len({g[:2] for g in got}) == len(got)


def test_refresh_equals_a_full_rewrite(spark, tmp_path):
    rng = np.random.default_rng(8)
    now = {i: None if i % 9 == 0 else rng.normal(size=4).tolist() for i in range(30)}
    table = pairtable.PairTable(spark, at(tmp_path), block=8)
    with pytest.raises(RuntimeError):
        table.read()
    for step in range(3):
        df = vectors(spark, sorted(now.items()))
        before = table.journal.entries()
        number = table.refresh(df)
        same_pairs(table, df)
        assert table.refresh(df) == number and number == (before[-1]["number"] if before else 0) + 1
        for i in rng.choice(sorted(now), 4, replace=False):  # changed, gone, emptied, new
            kind = rng.integers(0, 4)
            now[int(i)] = rng.normal(size=4).tolist() if kind < 2 else None
            if kind == 3:
                del now[int(i)]
        now[100 + step] = rng.normal(size=4).tolist()
    table.compact()
    assert len(table.journal.entries()) == 1
    table.refresh(vectors(spark, sorted(now.items())))
    same_pairs(table, vectors(spark, sorted(now.items())))
    table.refresh(vectors(spark, []))
    assert table.read().collect() == []


def test_refresh_reads_and_makes_no_old_pair(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    table = pairtable.PairTable(spark, at(tmp_path), block=64)
    table.refresh(vectors(spark, rows))
    old, hidden = tmp_path / "store" / "pairs", tmp_path / "hidden"
    old.rename(hidden)  # no pair of the older generation can be read
    changed = vectors(spark, [(i, [1.0, 2.0, 3.0, float(i)] if i in (3, 150) else v) for i, v in rows])
    table.refresh(changed)
    new = table.journal.entries()[-1]["pairs"]
    assert spark.read.parquet(new).count() == 199 + 198
    for d in hidden.iterdir():
        d.rename(old / d.name)
    same_pairs(table, changed)
    stale = table.journal.entries()[-1]["number"] - 1
    with pytest.raises(pairtable.Conflict):
        table._commit({"kind": "refresh"}, stale)


# Counters ----------------------------------------------------------------------------------------------------------


def test_counters(spark, tmp_path):
    s = Sequences(spark, at(tmp_path))
    assert s.last("image") == 0 and [s.take("image"), s.take("image", 5), s.take("image")] == [1, 2, 7]
    table = f"{tmp_path}/table"
    spark.createDataFrame([(41, "x"), (7, "y")], "id long, name string").write.parquet(table)
    df = spark.read.parquet(table)
    assert s.resync_to({"t": (df, "id"), "none": (df.limit(0), "id")}) == {"t": 41, "none": 0}
    assert s.take("none") == 1
    s.insert(spark.createDataFrame([("b",), ("a",)], "name string"), table, "t", "id", "name")
    s.insert(spark.createDataFrame([], "name string"), table, "t", "id", "name")
    assert sorted((r.id, r.name) for r in spark.read.parquet(table).collect()) == [(7, "y"), (41, "x"), (42, "a"), (43, "b")]
    s.compact()
    assert s.last("t") == 43 and s.take("image") == 8 and len(s.journal.entries()) == 2
    got, threads = [], [threading.Thread(target=lambda: got.append(Sequences(spark, at(tmp_path)).take("many", 10))) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [1, 11, 21, 31, 41]
    with pytest.raises(ValueError):
        s.resync({"t": -1})
    with pytest.raises(ValueError):
        s.take("t", 0)


# Re-embedding ------------------------------------------------------------------------------------------------------


def test_a_broken_job_goes_on_and_embeds_equal_inputs_once(spark, tmp_path):
    rows = [(i, None if i % 4 else [9.0] * 8, None if i % 7 == 0 else f"https://x/{i % 10}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, source string")
    job, seen = reindex.Job(spark, at(tmp_path)), []
    with pytest.raises(RuntimeError):
        job.run(encoder.HashEncoder(8))
    assert job.start(df, size=2)["slices"] == 6  # ten addresses and the missing one

    def breaks(k):
        seen.append(k)
        if len(seen) == 4:
            raise InterruptedError

    with pytest.raises(InterruptedError):
        job.run(encoder.HashEncoder(8), told=breaks, seed=1)
    assert job.progress().where("done").count() == 3 and job.filled(df).where("embedding is null").count() > 0
    again, more = reindex.Job(spark, at(tmp_path)), []
    again.start(df.limit(0))
    assert again.run(encoder.HashEncoder(8), told=more.append) == 3 and sorted(seen[:3] + more) == list(range(6))
    assert again.run(encoder.HashEncoder(8)) == 0
    assert again.vectors().count() == again.vectors().select("input").distinct().count() == 11
    e, got = encoder.HashEncoder(8), {r.id: r.embedding for r in again.filled(df).collect()}
    assert len(got) == 60 and all(got[i] == pytest.approx(v if v else e.embed_batch([s or ""])[0]) for i, v, s in rows)


def test_two_workers_commit_a_slice_once(spark, tmp_path):
    df = spark.createDataFrame([(i, None, f"t{i}") for i in range(40)], "id long, embedding array<float>, source string")
    jobs = [reindex.Job(spark, at(tmp_path)) for _ in range(2)]
    [j.start(df, size=8) for j in jobs]
    done, threads = [], []
    for j in jobs:
        threads.append(threading.Thread(target=lambda j=j: done.append(j.run(encoder.HashEncoder(4)))))
        threads[-1].start()
    [t.join() for t in threads]
    assert sum(done) == 5 and jobs[0].vectors().count() == 40 and jobs[1].progress().where("not done").count() == 0


def test_jobs_do_not_grow_with_the_slices(spark, tmp_path):
    df = spark.createDataFrame([(i, None, f"t{i}") for i in range(90)], "id long, embedding array<float>, source string")
    job, seen = reindex.Job(spark, at(tmp_path)), []
    assert job.start(df, size=3)["slices"] == 30
    assert job.run(encoder.HashEncoder(4), most=2, seed=1, told=seen.append) == 2 and len(seen) == 2
    assert job.run(encoder.HashEncoder(4), seed=2, told=seen.append) == 28 and sorted(seen) == list(range(30))
    assert len(job.journal.entries()) == 1 + 2 + 5  # waves of 1 and 1, then of 1, 2, 4, 8 and 13
    assert not [d for d in (tmp_path / "store" / "inputs").rglob("*") if d.is_dir() and "slice=" in d.name]
    assert sorted(r.input for r in job.vectors().collect()) == sorted(f"t{i}" for i in range(90))


def test_a_wave_that_another_worker_has_begun_commits_the_rest(spark, tmp_path):
    df = spark.createDataFrame([(i, None, f"t{i}") for i in range(60)], "id long, embedding array<float>, source string")
    one, two = (reindex.Job(spark, at(tmp_path)) for _ in range(2))
    one.start(df, size=10)
    said = []

    def meanwhile(k):
        said.append(k)
        if len(said) == 3:  # the second wave has two slices; the other worker commits the first of them
            assert two.run(encoder.HashEncoder(4), most=1, seed=5) == 1

    assert one.run(encoder.HashEncoder(4), seed=5, told=meanwhile) == 5
    assert [e["whole"] for e in one.journal.entries() if e["kind"] == "slices"].count(False) == 1
    assert one.progress().where("not done").count() == 0 and sorted(r.input for r in one.vectors().collect()) == sorted(f"t{i}" for i in range(60))


# Layouts -----------------------------------------------------------------------------------------------------------


def test_lookups_read_one_row_group(spark, tmp_path):
    n, group = 40_000, 1000
    ids = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("id"), F.md5(F.concat(F.lit("h"), "id")).alias("hash"), F.lit("jpg").alias("extension"))
    layout.write(ids, at(tmp_path, "image"), layout.LAYOUTS["image"], group_rows=group, files=4)
    target = ids.where(F.col("hash") == F.md5(F.lit("h77"))).first()
    whole = spark.read.parquet(at(tmp_path, "image"))
    assert whole.count() == n and len(layout.files(spark, at(tmp_path, "image"), target.id, target.id)) == 1
    for found in (search.by_id(whole, target.id), layout.lookup(spark, at(tmp_path, "image"), layout.LAYOUTS["image"], target.id), whole.where(F.col("hash") == target.hash)):
        assert [r.id for r in found.collect()] == [target.id]
        assert layout.rows_read(found) <= 4 * group  # of 40 groups: one, and by the Bloom filters seldom one that has not the value
    low = layout.between(spark, at(tmp_path, "image"), layout.LAYOUTS["image"], "00", "02")
    assert low.count() == ids.where("id between '00' and '02'").count() and layout.lookup(spark, at(tmp_path, "image"), layout.LAYOUTS["image"], "zz").count() == 0


def test_session_check_reads_one_row_group_of_each_table(spark, tmp_path):
    from velumen.operators import auth

    sessions = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("session_id"), (F.col("id") % 5000).cast("int").alias("user_id"), F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'").alias("expires_at"))
    users = spark.range(5000).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("u"), "id").alias("username"), F.lit("x").alias("password_hash"))
    for name, df in (("session", sessions), ("web_user", users)):
        layout.write(df, at(tmp_path, name), layout.LAYOUTS[name], group_rows=500, files=2)
    found = auth.authenticated(layout.lookup(spark, at(tmp_path, "session"), layout.LAYOUTS["session"], sessions.first().session_id), spark.read.parquet(at(tmp_path, "web_user")).where("id = 0"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), username="u0")
    assert found.count() == 1 or found.collect() == []
    rows = found.collect()
    assert [r.username for r in rows] == ["u0"] and layout.rows_read(found) <= 2 * 500


# Rules and clones --------------------------------------------------------------------------------------------------

RULES = {
    "web_user": rules.Rules(key=("id",), unique=(("username",),), not_null=("username",), layout=layout.LAYOUTS["web_user"], sequence="id"),
    "session": rules.Rules(key=("session_id",), not_null=("user_id",), references={"user_id": ("web_user", "id")}),
    "image": rules.Rules(key=("id",), checks={"kind": "extension <> 'exe'"}, defaults={"searchable": "true", "source": "concat('src.', 'x')"}),
}


@pytest.fixture
def source(spark, tmp_path):
    spark.sql("CREATE DATABASE src_rules")
    made = {
        "web_user": spark.createDataFrame([(1, "ann"), (5, "bob")], "id int, username string"),
        "session": spark.createDataFrame([("s", 1)], "session_id string, user_id int"),
        "image": spark.createDataFrame([(1, "jpg", True, None), (2, None, None, "x")], "id long, extension string, searchable boolean, source string"),
    }
    for t, df in made.items():
        df.write.saveAsTable(f"src_rules.{t}")
        rules.put(spark, "src_rules", t, RULES[t])
        rules.put_references(spark, "src_rules", t, RULES[t])
    yield "src_rules"
    spark.sql("DROP DATABASE src_rules CASCADE")
    for d in spark.catalog.listDatabases():
        if d.name.startswith("copy_of_rules"):
            spark.sql(f"DROP DATABASE {d.name} CASCADE")


def test_rules_live_in_the_catalogue(spark, source):
    assert {t: rules.get(spark, source, t) for t in rules.base_tables(spark, source)} == RULES
    assert rules.edges(spark, source) == [("session", "web_user")]
    found = {tuple(r) for r in rules.scan(spark, source).collect()}
    assert ("session", "references", "user_id", "web_user.id") in found and ("image", "check", "kind", "extension <> 'exe'") in found and len(found) == 12
    rules.insert(spark, source, "image", spark.createDataFrame([(3, "png")], "id long, extension string"))
    assert tuple(spark.table("src_rules.image").where("id = 3").first()) == (3, "png", True, "src.x")
    for table, rows, kind in (("image", [(3, "png")], "id long, extension string"), ("image", [(4, "exe")], "id long, extension string"), ("session", [("t", 2)], "session_id string, user_id int"), ("web_user", [(9, None)], "id int, username string")):
        with pytest.raises(schema.ConstraintError):
            rules.insert(spark, source, table, spark.createDataFrame(rows, kind))
    assert rules.broken(spark, source, references=True).count() == 0
    rules.insert(spark, source, "session", spark.createDataFrame([("u", 5)], "session_id string, user_id int"))
    assert spark.table("src_rules.session").count() == 2


def whole(target):
    """A version's tables, views, rules and counters."""
    spark, db = target.spark, target.database()
    return {
        "tables": {t: sorted(map(str, target.table(t).collect())) for t in rules.base_tables(spark, db) if not t.startswith("mv")},
        "rules": sorted(map(str, rules.scan(spark, db).collect())),
        "view": sorted(map(str, target.table("names").collect())),
        "last": target.sequences().last("web_user"),
    }


VIEWS = {"names": "SELECT username FROM src_rules.web_user", "again": "SELECT * FROM src_rules.names"}
MATERIALIZED = {"mv_pairs": "SELECT a.id AS id1, b.id AS id2 FROM src_rules.image a JOIN src_rules.image b ON a.id < b.id WITH NO DATA;"}


def test_clone_of_everything(spark, source, tmp_path):
    target = clone.Target(spark, "copy_of_rules", at(tmp_path))
    with pytest.raises(LookupError):
        target.database()
    made = target.clone_of(source, views=VIEWS, materialized=MATERIALIZED)
    assert target.database() == made and target.table("again").count() == 2 and target.table("mv_pairs").count() == 0
    assert rules.get(spark, made, "image").defaults == RULES["image"].defaults | {"source": "concat('src.', 'x')"}
    assert {t: rules.get(spark, made, t) for t in RULES} == RULES
    assert target.sequences().take("web_user") == 6
    # A reader of the old version is not disturbed by a new one.
    old = target.table("web_user")
    rules.insert(spark, source, "web_user", spark.createDataFrame([(8, "cem")], "id int, username string"))
    target.clone_of(source, views=VIEWS)
    assert old.count() == 2 and target.table("web_user").count() == 3 and target.sequences().take("web_user") == 9
    assert target.vacuum() == [made] and target.table("names").count() == 3


def test_a_failure_at_any_step_leaves_the_old_version_whole(spark, source, tmp_path):
    target, steps = clone.Target(spark, "copy_of_rules", at(tmp_path)), []
    target.clone_of(source, views=VIEWS, materialized=MATERIALIZED, step=steps.append)
    before = whole(target)
    assert len(steps) == 16 and steps[0] == "database" and steps[-1] == "switch"
    rules.insert(spark, source, "web_user", spark.createDataFrame([(8, "cem")], "id int, username string"))
    for k in (0, 3, 5, 7, 9, 11, 13, 15):
        seen = []

        def fails(what, k=k, seen=seen):
            seen.append(what)
            if len(seen) == k + 1:
                raise OSError(what)

        with pytest.raises(OSError):
            target.clone_of(source, views=VIEWS, materialized=MATERIALIZED, step=fails)
        assert whole(target) == before
    assert [d.name for d in spark.catalog.listDatabases() if d.name.startswith("copy_of_rules")] == [target.database()]
    # Data that break a rule do not become current either.
    spark.createDataFrame([("lost", 77)], "session_id string, user_id int").write.insertInto("src_rules.session")
    with pytest.raises(schema.ConstraintError):
        target.clone_of(source, views=VIEWS)
    assert whole(target) == before


def test_of_two_clones_at_once_one_becomes_current(spark, source, tmp_path):
    target = clone.Target(spark, "copy_of_rules", at(tmp_path))
    inner = []

    def other(what):
        if what == "switch" and not inner:
            inner.append(target.clone_of(source, step=lambda w: inner.append(w)))

    with pytest.raises(RuntimeError):
        target.clone_of(source, step=other)
    assert target.database() == inner[-1]
