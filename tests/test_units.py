import base64
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from velumen.functions import blurhash, encoder, shape, vector
from velumen.operators import auth, events, pairs, reindex, search, stats
from velumen.sources import catalog, schema
from velumen.streaming import events as streaming

IMAGE = "id long, embedding array<double>, searchable boolean, deleted boolean, extension string, source string, from_old_database boolean"


def images(spark, rows):
    return spark.createDataFrame([(i, e, s, d, "jpg", None, False) for i, e, s, d in rows], IMAGE)


def test_cosine_distance_edges(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [-1.0, 0.0]), (3, [0.0, 0.0], [1.0, 0.0]), (4, None, [1.0, 0.0])]
    d = {r.k: r.d for r in spark.createDataFrame(rows, "k int, a array<double>, b array<double>").select("k", vector.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert d[1] == 0 and d[2] == 2 and math.isnan(d[3]) and d[4] is None
    with pytest.raises(PySparkException):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vector.cosine_distance(F.col("a"), F.col("b"))).collect()


def test_visibility_and_order(spark):
    df = images(spark, [(1, [1.0, 0.0], True, False), (2, [1.0, 0.1], None, False), (3, [1.0, 0.2], True, True), (4, None, True, False), (5, [0.0, 1.0], True, False), (6, [0.0, 2.0], True, False), (7, [1.0, 0.0], False, False)])
    assert [r.id for r in search.similar(df, 7).collect()] == [1, 5, 6, 4]
    assert search.similar(df, 3).collect() == [] and search.similar(df, 99).collect() == []
    assert [r.id for r in search.within(df, [1.0, 0.0], threshold=0.0).collect()] == [1]
    assert {r.id for r in search.random_gallery(df, limit=9).collect()} == {1, 4, 5, 6}
    assert [(r["rank"], r.id) for r in search.with_target_first(df, 7).collect()] == [(0, 7), (1, 1), (2, 5), (3, 6), (4, 4)]


def test_empty_tables_and_contracts(spark):
    none = images(spark, [])
    assert stats.overall(none).first().total == 0 and math.isnan(stats.percentages(none).first().deleted_percent)
    assert pairs.image_neighbor(none).collect() == [] and pairs.near_duplicates(none).collect() == []
    with pytest.raises(search.NotFound):
        search.many(stats.by_extension(none))
    assert search.maybe_one(search.by_id(none, 1)) is None


@pytest.mark.parametrize("block", [3, 1000])
def test_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    df = images(spark, [(i, None if i == 4 else rng.normal(size=5).tolist(), True, False) for i in range(11)])
    got = pairs.image_neighbor(df, block=block).collect()
    assert len(got) == 55 == len({(r.id1, r.id2) for r in got}) and all(r.id1 < r.id2 for r in got)
    assert sum(r.distance is None for r in got) == 10 and all(0 <= r.distance <= 2 for r in got if r.distance is not None)
    top = [(r.image1.id, r.image2.id) for r in pairs.near_duplicates(df, limit=7, block=block).collect()]
    assert top == [(r.id1, r.id2) for r in sorted((r for r in got if r.distance is not None), key=lambda r: (r.distance, r.id1, r.id2))[:7]]


def test_pairs_of_text_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{i:08x}-0000-4000-8000-{i:012x}", rng.normal(size=4).tolist(), True, False, "jpg", None, False) for i in range(30)]
    df = spark.createDataFrame(rows, IMAGE.replace("id long", "id string"))
    got = pairs.image_neighbor(df, block=8).collect()
    assert len(got) == 435 and all(r.id1 < r.id2 for r in got)
    top = [(r.image1.id, r.image2.id) for r in pairs.near_duplicates(df, limit=9, block=8).collect()]
    assert top == [(r.id1, r.id2) for r in sorted(got, key=lambda r: (r.distance, r.id1, r.id2))[:9]]


def test_pair_table_must_be_refreshed(spark, tmp_path):
    at = str(tmp_path / "pairs")
    with pytest.raises(RuntimeError):
        pairs.read_image_neighbor(spark, at)
    df = images(spark, [(1, [1.0, 0.0], True, False), (2, [1.0, 0.1], True, False), (3, [1.0, 0.0], None, False)])
    pairs.refresh_image_neighbor(df, at)
    assert pairs.read_image_neighbor(spark, at).count() == 3
    assert [(r.image1.id, r.image2.id) for r in pairs.review(pairs.read_image_neighbor(spark, at), df).collect()] == [(1, 2)]


def test_encoder_contract(spark):
    e = encoder.HashEncoder(32)
    assert len(e.embed("one\ntwo\n\n")) == 2 and np.isclose(np.linalg.norm(e.embed("x")[0]), 1)
    with pytest.raises(ValueError):
        e.embed("   ")
    assert e.embed("https://a.b/c") != e.embed("a.b/c") and e.embed("Abc") == e.embed("abc")
    df = images(spark, [(1, [1.0] * 32, True, False)])
    assert search.search_text(df, "", e).collect() == []
    got = encoder.dispatch(spark.createDataFrame([(1, " a\r\nhttp://x \n"), (2, "  "), (3, None)], "k int, text string")).collect()
    assert [(r.k, r.line, r.input, r.kind) for r in got] == [(1, 0, "a", "text"), (1, 1, "http://x", "image")]


def test_reindex_fills_only_what_is_missing(spark):
    df = images(spark, [(1, None, True, False), (2, [1.0, 0.0], True, False)])
    done = {r.id: r.embedding for r in reindex.reindexed(df, reindex.embedded(df, encoder.HashEncoder(2))).collect()}
    assert done[2] == [1.0, 0.0] and len(done[1]) == 2 and reindex.backlog(df).count() == 1


def test_events(spark, tmp_path):
    with pytest.raises(ValueError):
        events.payload("imageDownloaded", x=F.lit(1))
    log = spark.createDataFrame([], "id long, event_type string, payload string, created_at timestamp")
    new = spark.createDataFrame([("b", "{}"), ("a", "{}")], "event_type string, payload string")
    at = str(tmp_path / "log")
    events.append_to(at, log, new, F.current_timestamp())
    events.append_to(at, spark.read.parquet(at), new, F.current_timestamp())
    assert [(r.id, r.event_type) for r in spark.read.parquet(at).orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    df = images(spark, [(1, None, True, False), (2, None, True, True), (3, None, True, True)])
    changes = spark.createDataFrame([(1, 1, "imageDeleted", 5), (2, 1, "imageUndeleted", 5), (3, 2, "imageUndeleted", 4), (4, 2, "other", 9)], "id long, image_id long, event_type string, created_at int")
    assert {r.id: r.deleted for r in events.with_deleted(df, changes).collect()} == {1: False, 2: False, 3: True}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS event_type, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) AS created_at FROM range(60)")
    at = str(tmp_path / "in")
    rows.write.parquet(at)
    stream = streaming.counts_by_window(streaming.read(spark, at, rows.schema))
    got = streaming.run_once(stream, str(tmp_path / "cp"), "windows_test").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, streaming.counts_by_window(rows).collect()))


def test_auth(spark):
    users = spark.createDataFrame([(1, "ann", auth.hash_password("pw"))], "id int, username string, password_hash string")
    assert auth.login(users, "bob", "x")[0] == "usernameNotFound" and auth.login(users, "ann", "x")[0] == "passwordIncorrect"
    assert auth.login(users, "ann", "pw")[0] == "success"
    now = F.lit("2024-01-01").cast("timestamp")
    sessions = auth.new_sessions(spark.createDataFrame([("s", 1)], "session_id string, user_id int"), now)
    assert auth.is_authenticated({"sessionId": "s", "username": "ann"}, sessions, users, now)["isAuthenticated"]
    later = now + F.expr("INTERVAL 1 DAY")
    assert not auth.is_authenticated({"sessionId": "s", "username": "ann"}, sessions, users, later)["isAuthenticated"]
    assert not auth.is_authenticated(None, sessions, users, now)["isAuthenticated"]
    gone = spark.createDataFrame([("s",), (None,)], "session_id string")
    assert auth.end_session(sessions, gone).count() == 0


def test_shaping(spark):
    rows = [("https://reddit.com/a/https://reddit.com/b",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(shape.rewrite_source(F.col("s"))).collect()]
    assert got == ["https://redd.it/a/https://reddit.com/b", "x", ""]
    names = spark.createDataFrame([("a/b.png",), ("a/",), (None,)], "s string").select(shape.filename(F.col("s"))).collect()
    assert [r[0] for r in names] == ["b.png", "cover", "cover"]
    assert len(shape.token()) == 64 and shape.quote_ident("a`b") == "`a``b`" and spark.sql(f"SELECT {shape.quote_literal(chr(39) + chr(92))}").first()[0] == "'\\"


def reference_pixels(text, size=8):
    """Pixel by pixel, from the format's definition."""
    n = lambda s: sum(blurhash.DIGITS.index(c) * 83**i for i, c in enumerate(reversed(s)))
    w, h, scale = n(text[0]) % 9 + 1, n(text[0]) // 9 + 1, (n(text[1]) + 1) / 166
    lin = lambda v: v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4
    dc = n(text[2:6])
    parts = [[lin(dc >> 16), lin(dc >> 8 & 255), lin(dc & 255)]]
    for k in range(1, w * h):
        v = n(text[4 + 2 * k : 6 + 2 * k])
        parts.append([math.copysign(((q - 9) / 9) ** 2, q - 9) * scale for q in (v // 361, v // 19 % 19, v % 19)])
    out = []
    for y in range(size):
        for x in range(size):
            px = [sum(math.cos(math.pi * x * i / size) * math.cos(math.pi * y * j / size) * parts[j * w + i][c] for j in range(h) for i in range(w)) for c in range(3)]
            px = [min(1, max(0, p)) for p in px]
            out.append([int((p * 12.92 if p <= 0.0031308 else 1.055 * p ** (1 / 2.4) - 0.055) * 255 + 0.5) for p in px])
    return np.array(out).reshape(size, size, 3)


def test_blurhash():
    text = "LEHV6nWB2yk8pyo0adR*.7kCMdnj"
    got = blurhash.decode(text, 8, 8)
    assert np.abs(got[:, :, :3].astype(int) - reference_pixels(text)).max() <= 1 and (got[:, :, 3] == 255).all()
    raw = base64.b64decode(blurhash.data_url(text).partition(",")[2])
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (32, 32)
    size = struct.unpack(">I", raw[33:37])[0]
    rows = np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(32, -1)
    assert (rows[:, 0] == 0).all() and np.array_equal(rows[:, 1:].reshape(32, 32, 4), blurhash.decode(text))
    assert blurhash.data_url("") == "" and not blurhash.is_valid("LEHV") and blurhash.primary_colour("00OZZy")[1] >= 0


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet=blurhash.DIGITS, max_size=40))
def test_blurhash_never_decodes_what_is_invalid(text):
    if blurhash.is_valid(text):
        assert blurhash.decode(text).shape == (32, 32, 4)
    else:
        with pytest.raises(ValueError):
            blurhash.decode(text)


def test_catalog(spark):
    assert catalog.load_order(["a", "b", "c"], [("a", "b"), ("b", "c")]) == ["c", "b", "a"]
    with pytest.raises(ValueError):
        catalog.load_order(["a"], [("a", "a")])
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert [r.k for r in catalog.not_in(rows, "k", spark.createDataFrame([(1,)], "x int"), "x").collect()] == [2]
    assert catalog.not_in(rows, "k", spark.createDataFrame([(1,), (None,)], "x int"), "x").collect() == []
    assert catalog.not_in(rows, "k", spark.createDataFrame([], "x int"), "x").count() == 3
    assert catalog.next_id(spark.createDataFrame([], "k int"), "k").first() == (0, 1)


def test_clone(spark):
    for db in ("clone_src", "clone_dst"):
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
    spark.sql("CREATE DATABASE clone_src")
    spark.range(3).write.saveAsTable("clone_src.child")
    spark.range(2).write.saveAsTable("clone_src.parent")
    assert catalog.copy_tables(spark, "clone_src", "clone_dst", [("child", "parent")]) == ["parent", "child"]
    assert spark.table("clone_dst.child").count() == 3
    for db in ("clone_src", "clone_dst"):
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_schema_rules(spark):
    df = schema.with_defaults(spark.createDataFrame([("a",), ("a",)], "id string"), schema.IMAGE, schema.CONSTRAINTS["image"].defaults)
    assert df.schema.fieldNames() == schema.IMAGE.fieldNames() and df.first().searchable is True
    assert [(r.rule, r.n) for r in schema.violations(df, schema.CONSTRAINTS["image"]).collect()] == [("unique(id)", 1)]
    assert schema.model_column("mobileclip_b") == "embedding_mobileclip_b" and schema.model_column("?") == "embedding_mobileclip_s0"


def test_similar_without_limit_keeps_the_null_tail(spark, tmp_path):
    from velumen.plans import catalogue

    spark.range(140_000).selectExpr("id AS vec_id", "array(1F, float(id)) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = schema.images(spark, str(tmp_path)).where(search.visible()).where("id != 1")
    assert seen.count() > 100_000
    got = catalogue.QUERIES["similar_null_tail"](spark, str(tmp_path))
    assert (got.count(), got.where("distance is null").count()) == (seen.count(), seen.where("embedding is null").count())


def test_lines_are_those_of_the_encoder(spark):
    texts = [" a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i\r\nj\rk\n\nl ", "　\xa0x  \n y \n", "\x1f \t", "", None, "one\x1ftwo", "https://a/b \n c"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(encoder.lines(F.col("t"))).collect()]
    want = [[x.strip() for x in (t or "").strip().splitlines()] for t in texts]
    assert got == want


def test_service_tells_what_it_does(spark, tmp_path):
    from velumen.operators import service

    df = images(spark, [(1, [1.0, 0.0], True, False), (2, [1.0, 0.1], True, False), (3, [0.0, 1.0], True, False)]).withColumn("blurhash", F.lit(None).cast("string"))
    users = spark.createDataFrame([(7, "ann", auth.hash_password("pw"))], "id long, username string, password_hash string")
    sessions = spark.createDataFrame([], "session_id string, user_id long, expires_at timestamp")
    s, now = service.Service(df, users, sessions), F.lit("2024-01-01").cast("timestamp")
    assert len(s.similar(1)) == 3 and s.similar(99) == [] and s.search("", None) == [] and len(s.random()) == 3
    assert s.login("ann", "no", now) == {"status": 401} and s.login("bob", "x", now) == {"status": 401}
    got = s.login("ann", "pw", now)
    assert got["status"] == 303 and got["max_age"] == 28_800 and s.sessions.count() == 1
    s.set_deleted(got["cookie"], now, 2, True)
    assert [r.id for r in s.similar(1)] == [1, 3]
    with pytest.raises(service.NotAuthorized):
        s.set_searchable(None, now, 3, False)
    for bad in (None, "", "!!", base64.b64encode(b'{"sessionId": "x", "username": "ann"}').decode()):
        assert s.authenticated(bad, now) == {"isAuthenticated": False}
    s.logout(next(p["sessionId"] for k, p in s.told if k == "adminUserLoginSuccess"))
    assert s.authenticated(got["cookie"], now) == {"isAuthenticated": False}
    kinds = [k for k, _ in s.told]
    assert kinds == ["getImageByIdAndSimilar", "getRandom", "adminUserLoginFailure", "adminUserLoginFailure", "adminUserLoginSuccess", "adminUserAuthSuccess", "imageDeleted", "getImageByIdAndSimilar", "adminUserLogout"]
    with pytest.raises(ValueError):
        s.tell("imageDownloaded", x=1)
    at, log = str(tmp_path / "log"), spark.createDataFrame([], "id long, event_type string, payload string, created_at timestamp")
    s.flush(at, log, now)
    told = spark.read.parquet(at)
    assert sorted(r.id for r in told.collect()) == list(range(1, 10)) and s.told == []
    assert told.where("event_type = 'getRandom'").select(F.get_json_object("payload", "$.results").cast("double")).first()[0] == 3


def test_event_ids_are_given_out_over_partitions(spark):
    log = spark.createDataFrame([(41, "x", "{}", None)], "id long, event_type string, payload string, created_at timestamp")
    new = spark.createDataFrame([(f"t{i % 3}", None if i == 5 else f'{{"i":{i % 30}}}') for i in range(100)], "event_type string, payload string").repartition(4)
    got = events.append(log, new, F.current_timestamp()).orderBy("id").collect()
    assert [r.id for r in got] == list(range(42, 142)) and [r.event_type for r in got] == sorted(r.event_type for r in got)


def test_writes_obey_constraints(spark, tmp_path):
    at, users = str(tmp_path / "session"), spark.createDataFrame([(1, "ann", "h")], "id int, username string, password_hash string")
    row = lambda key, user: spark.sql(f"SELECT '{key}' AS session_id, {user} AS user_id, timestamp'2024-01-01' AS expires_at")
    schema.write(row("a", 1), at, "session", {"web_user": users})
    for key, user in (("a", 1), ("b", 2), ("c", "CAST(NULL AS INT)")):
        with pytest.raises(schema.ConstraintError):
            schema.write(row(key, user), at, "session", {"web_user": users})
    schema.write(row("b", 1), at, "session", {"web_user": users})
    assert sorted(r.session_id for r in spark.read.parquet(at).collect()) == ["a", "b"]


def test_a_failed_clone_leaves_the_target(spark, tmp_path):
    for db in ("clone_a", "clone_b"):
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
        spark.sql(f"CREATE DATABASE {db}")
    spark.range(3).write.saveAsTable("clone_a.good")
    spark.range(5).write.saveAsTable("clone_b.old")
    lost = tmp_path / "lost"
    spark.range(1).write.parquet(str(lost))
    spark.sql(f"CREATE TABLE clone_a.zlost USING parquet LOCATION '{lost}'")
    for f in lost.iterdir():
        f.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        catalog.copy_tables(spark, "clone_a", "clone_b", [])
    assert spark.table("clone_b.old").count() == 5
    spark.sql("DROP TABLE clone_a.zlost")
    catalog.copy_tables(spark, "clone_a", "clone_b", [])
    assert spark.table("clone_b.good").count() == 3 and not spark.catalog.tableExists("clone_b.old")
    # A view that reads a later one, and a materialised view without data.
    made = catalog.copy_views(spark, {"v1": "SELECT * FROM clone_a.v2", "v2": "SELECT id FROM clone_a.good WITH NO DATA;"}, "clone_a", "clone_b")
    assert made == ["v2", "v1"] and spark.table("clone_b.v1").count() == 3
    assert catalog.copy_materialized(spark, {"mv": "SELECT id, id * 2 AS twice FROM clone_a.good"}, "clone_a", "clone_b") == ["mv"]
    assert spark.table("clone_b.mv").columns == ["id", "twice"] and spark.table("clone_b.mv").count() == 0
    for db in ("clone_a", "clone_b"):
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_ranked_lists_are_bounded(spark):
    df = images(spark, [(1, [1.0], True, False), (2, [2.0], True, False)])
    for ranked in (search.with_target_first, search.similar_records):
        with pytest.raises(ValueError):
            ranked(df, 1, limit=None)


def test_blanks_are_stripped_as_the_class_says(spark):
    import re

    assert all(re.match(f"[{encoder.BLANK.replace('x{85}', 'x85').replace('x{a0}', 'xa0').replace('x{', 'u').replace('}', '')}]", c) for c in encoder.BLANKS) and len(set(encoder.BLANKS)) == len(encoder.BLANKS) == 29
    df = spark.createDataFrame([(f"{encoder.BLANKS}a{encoder.BLANKS}b​{encoder.BLANKS}",)], "text string")
    assert [r.input for r in encoder.dispatch(df).collect()][0] == "a" and [r.input for r in encoder.dispatch(df).collect()][-1] == "b​"
