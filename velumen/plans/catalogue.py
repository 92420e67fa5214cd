"""Registered catalogue queries and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumen.functions import blurhash, encoder, shape, vector
from velumen.operators import auth, eventlog, events, nearest, pairs, pairtable, reindex, search, sequences, service, stats
from velumen.sources import catalog, clone, layout, rules, schema, shared
from velumen.streaming import events as streaming

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_IMAGES = f"image AS ({schema.IMAGE_DUCK})"
_VISIBLE = "searchable IS TRUE AND deleted IS FALSE"
_DISTANCE = """CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE
  greatest(0.0, least(2.0, 1 - list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))
    / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x)))))) END"""


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_now():
    return F.expr(f"TIMESTAMP_NTZ '{schema.NOW_EVENTS}'")


def _session_now():
    return F.expr(f"TIMESTAMP_NTZ '{schema.NOW_SESSIONS}'")


# Gallery, lookup and search -------------------------------------------------------------------------------------


@query(f"""WITH {_IMAGES} SELECT id, source, extension, from_old_database FROM image WHERE {_VISIBLE}
ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT 54""")
def random_gallery_seeded(spark, sf_dir):
    return search.random_gallery(schema.images(spark, sf_dir), seed=42)


@query()
def random_gallery(spark, sf_dir):
    return search.random_gallery(schema.images(spark, sf_dir))


@query(f"WITH {_IMAGES} SELECT id, source, extension, searchable, deleted FROM image WHERE id = 10")
def image_by_id(spark, sf_dir):
    return search.by_id(schema.images(spark, sf_dir), 10).select("id", "source", "extension", "searchable", "deleted")


def _similar_sql(target: int, limit: int | None, column: str = "embedding") -> str:
    d = _DISTANCE.format(a="i.embedding", b="t.embedding").replace("i.embedding", column.replace("embedding", "i.embedding")).replace("t.embedding", column.replace("embedding", "t.embedding"))
    return f"""WITH {_IMAGES}, target AS (SELECT embedding FROM image WHERE id = {target} AND deleted IS FALSE)
SELECT i.id, round({d}, 6) AS distance FROM image i CROSS JOIN target t
WHERE {_VISIBLE} AND i.id <> {target} ORDER BY distance NULLS LAST, i.id {"" if limit is None else f"LIMIT {limit}"}"""


@query(_similar_sql(1, 96))
def similar_by_id(spark, sf_dir):
    return search.similar(schema.images(spark, sf_dir), 1, digits=6)


@query(_similar_sql(10, 96))
def similar_to_unsearchable(spark, sf_dir):
    return search.similar(schema.images(spark, sf_dir), 10, digits=6)


@query(_similar_sql(1, None))
def similar_null_tail(spark, sf_dir):
    return search.similar(schema.images(spark, sf_dir), 1, digits=6, limit=None)


@query(
    f"""SELECT 0 AS rank, CAST(1 AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS distance
UNION ALL SELECT CAST(row_number() OVER (ORDER BY distance NULLS LAST, id) AS INT), id, distance FROM ({_similar_sql(1, 96)})"""
)
def similar_with_target_first(spark, sf_dir):
    return search.with_target_first(schema.images(spark, sf_dir), 1, digits=6)



@query("SELECT 0 AS rank, CAST(7 AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS distance")
def similar_deleted_target(spark, sf_dir):
    return search.with_target_first(schema.images(spark, sf_dir), 7, digits=6)


_RECORD = "id, source, extension, blurhash, from_old_database, searchable"
_RECORDS = f"""WITH {_IMAGES}, near AS ({_similar_sql(1, 96)})
SELECT 0 AS rank, {_RECORD}, CAST(NULL AS DOUBLE) AS distance FROM image WHERE id = 1
UNION ALL SELECT CAST(row_number() OVER (ORDER BY distance NULLS LAST, id) AS INT), {_RECORD}, distance FROM image JOIN near USING (id)"""


@query(_RECORDS)
def similar_records(spark, sf_dir):
    return search.similar_records(schema.images(spark, sf_dir), 1, digits=6)


#: What each preview hash of the fixture decodes to, worked out pixel by pixel from the format's definition: checksum of
#: the data address, and hue, saturation and lightness of the mean of its fullest cell of 32 levels a channel.
LOOKS = {
    "LEHV6nWB2yk8pyo0adR*.7kCMdnj": ("5f6cb7e2d65a0010c30dbff201f4ae67", 218.416, 0.807, 56.067),
    "LGF5]+Yk^6#M@-5c,1J5@[or[Q6.": ("c084e0592594d524c2868effbf01a848", 312.881, 1.429, 44.971),
    "L6PZfSi_.AyE_3t7t7R**0o#DgR4": ("0e079df731496edc0b8561573b51c7ca", 30.269, 11.499, 83.869),
    "LKO2?U%2Tw=w]~RBVZRi};RPxuwH": ("6dbc6189b978d14a1db4c556a001bd47", 16.577, 26.712, 72.918),
}
_LOOKS = "looks(hash, url_md5, h, s, l) AS (VALUES " + ", ".join(f"('{k}', '{m}', CAST({h} AS DOUBLE), CAST({s} AS DOUBLE), CAST({l} AS DOUBLE))" for k, (m, h, s, l) in LOOKS.items()) + ")"


@query(
    f"""WITH {_LOOKS}, records AS ({_RECORDS})
SELECT rank, id, '{shape.DEFAULT_PREFIX}/original/' || id || '.' || extension AS url, coalesce(url_md5, md5('')) AS blurhash_md5,
  CASE WHEN starts_with(source, 'https://reddit.com/') THEN 'https://redd.it/' || substr(source, 20) ELSE coalesce(source, '') END AS source,
  '{shape.DEFAULT_PREFIX}/jpeg/640/' || id || '.jpg' AS jpeg_640, '{shape.DEFAULT_PREFIX}/webp/1280/' || id || '.webp' AS webp_1280,
  h, s, l, searchable, distance, from_old_database
FROM records LEFT JOIN looks ON blurhash = hash"""
)
def similar_shaped(spark, sf_dir):
    found = search.shaped_records(search.similar_records(schema.images(spark, sf_dir), 1, digits=6)).select("rank", "shaped.*")
    colour = [F.round(f"primaryColor.{c}", 3).alias(c) for c in "hsl"]
    return found.select("rank", "id", "url", F.md5("blurhashUrl").alias("blurhash_md5"), "source", F.col("jpeg.640").alias("jpeg_640"), F.col("webp.1280").alias("webp_1280"), *colour, "searchable", "distance", "from_old_database")


_SQUARES = "list_transform(embedding, lambda x: x * x)"


@query(_similar_sql(1, 96, _SQUARES))
def similar_by_model(spark, sf_dir):
    return search.similar(schema.images_by_model(spark, sf_dir), 1, column=schema.model_column("mobileclip_s2"), digits=6)


@query(f"""WITH {_IMAGES} SELECT id, embedding IS NULL AS missing FROM image WHERE embedding IS NULL""")
def backlog_by_model(spark, sf_dir):
    column = schema.model_column("no such model")
    return reindex.backlog(schema.images_by_model(spark, sf_dir), column, seed=1, limit=None).select("id", F.col(column).isNull().alias("missing"))


def _query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in _table(spark, sf_dir, "embeddings").where("vec_id = 1").first().embedding]


def _near(most: float) -> str:
    return f"""WITH {_IMAGES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 1),
far AS (SELECT {_RECORD}, round({_DISTANCE.format(a='embedding', b='v')}, 6) AS distance FROM image CROSS JOIN q WHERE {_VISIBLE})
SELECT {_RECORD}, distance FROM far WHERE distance <= {most}"""


@query(_near(0.765))
def search_by_vector_threshold(spark, sf_dir):
    return search.within(schema.images(spark, sf_dir), _query_vector(spark, sf_dir), digits=6)


@query(_near(0.8))
def search_wider_threshold(spark, sf_dir):
    return search.within(schema.images(spark, sf_dir), _query_vector(spark, sf_dir), threshold=0.8, digits=6)


_WORDS = "the golden compass"
_WORDS_VECTOR = ", ".join(map(repr, encoder.HashEncoder(64).embed(_WORDS)[0]))


@query(f"""WITH {_IMAGES}, q AS (SELECT CAST([{_WORDS_VECTOR}] AS DOUBLE[]) AS v),
far AS (SELECT {_RECORD}, round({_DISTANCE.format(a='embedding', b='v')}, 6) AS distance FROM image CROSS JOIN q WHERE {_VISIBLE})
SELECT {_RECORD}, distance FROM far WHERE distance <= 2.0""")
def search_by_text(spark, sf_dir):
    return search.search_text(schema.images(spark, sf_dir), _WORDS, encoder.HashEncoder(64), threshold=2.0, digits=6)


@query(f"""SELECT id, '{{"versions":{{"png":{{"original":"{shape.DEFAULT_PREFIX}/original/' || id || '.' || extension || '"}}}}}}' AS json FROM ({_near(0.765)}) WHERE extension IS NOT NULL""")
def cover_bytext_json(spark, sf_dir):
    found = search.within(schema.images(spark, sf_dir), _query_vector(spark, sf_dir), digits=6)
    return search.api_json(found.where("extension is not null"))


# Pairs ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_IMAGES} SELECT a.id AS id1, b.id AS id2, round({_DISTANCE.format(a='a.embedding', b='b.embedding')}, 6) AS distance
FROM image a JOIN image b ON a.id < b.id""")
def image_neighbor(spark, sf_dir):
    return pairs.image_neighbor(schema.images(spark, sf_dir), digits=6)


@query(f"""WITH {_IMAGES}, seen AS (SELECT * FROM image WHERE {_VISIBLE})
SELECT a.id AS id1, a.source AS source1, b.id AS id2, b.extension AS extension2, round({_DISTANCE.format(a='a.embedding', b='b.embedding')}, 6) AS distance
FROM seen a JOIN seen b ON a.id < b.id ORDER BY distance NULLS LAST, id1, id2 LIMIT 48""")
def near_duplicates(spark, sf_dir):
    top = pairs.near_duplicates(schema.images(spark, sf_dir))
    return top.select(F.col("image1.id").alias("id1"), F.col("image1.source").alias("source1"), F.col("image2.id").alias("id2"), F.col("image2.extension").alias("extension2"), F.round("distance", 6).alias("distance"))


@query(ORACLES["near_duplicates"])
def review_of_stored_pairs(spark, sf_dir):
    images = schema.images(spark, sf_dir)
    at = shared.fresh(spark, "pairs")
    pairs.refresh_image_neighbor(images, at)
    top = pairs.review_stored(spark, at, images)
    return top.select(F.col("image1.id").alias("id1"), F.col("image1.source").alias("source1"), F.col("image2.id").alias("id2"), F.col("image2.extension").alias("extension2"), F.round("distance", 6).alias("distance"))


@query(ORACLES["image_neighbor"])
def image_neighbor_refreshed(spark, sf_dir):
    """A pair table of other vectors and fewer images, brought up to date by what has changed since."""
    images, table = schema.images(spark, sf_dir), pairtable.PairTable(spark, shared.fresh(spark, "pair-table"))
    then = images.where("extension is not null").withColumn("embedding", F.when(F.col("extension") == "webp", F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    table.refresh(then)
    table.refresh(images)
    return table.read(digits=6)


@query(f"""WITH {_IMAGES}, seen AS (SELECT id, embedding FROM image WHERE {_VISIBLE}),
far AS (SELECT t.id AS target, i.id, round({_DISTANCE.format(a='i.embedding', b='t.embedding')}, 6) AS distance FROM image t JOIN seen i ON t.id <> i.id WHERE t.deleted IS FALSE)
SELECT target, id, distance, CAST(row_number() OVER (PARTITION BY target ORDER BY distance NULLS LAST, id) AS INT) AS rank FROM far
QUALIFY rank <= 96""")
def similar_of_all(spark, sf_dir):
    """The nearest of every image that is not deleted, in one join."""
    images = schema.images(spark, sf_dir)
    return nearest.nearest_to(images.where(search.visible()), images.where("not deleted"), search.SIMILAR, digits=6)


# Statistics -----------------------------------------------------------------------------------------------------


@query(f"""WITH {_IMAGES} SELECT CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (WHERE deleted = TRUE) AS INT) AS deleted,
CAST(count(*) FILTER (WHERE searchable = TRUE) AS INT) AS searchable FROM image""")
def image_overall_stats(spark, sf_dir):
    return stats.overall(schema.images(spark, sf_dir))


@query(f"""WITH {_IMAGES} SELECT extension, CAST(count(*) AS INT) AS count FROM image WHERE extension IS NOT NULL
GROUP BY extension ORDER BY count DESC, extension LIMIT 10""")
def images_by_extension(spark, sf_dir):
    return stats.by_extension(schema.images(spark, sf_dir))


@query(f"""SELECT CAST(count(*) AS INT) AS total_events, CAST(count(*) FILTER (WHERE event_type = 'click') AS INT) AS deleted_events,
CAST(count(*) FILTER (WHERE event_type = 'view') AS INT) AS undeleted_events,
CAST(count(*) FILTER (WHERE ts > TIMESTAMP '{schema.NOW_EVENTS}' - INTERVAL 7 DAYS) AS INT) AS recent_events FROM events""")
def analytics_stats(spark, sf_dir):
    return stats.analytics(schema.events(spark, sf_dir), _event_now(), deleted="click", undeleted="view")


@query(f"""WITH {_IMAGES} SELECT round(count(*) FILTER (WHERE deleted) / count(*) * 100, 1) AS deleted_percent,
round(count(*) FILTER (WHERE searchable) / count(*) * 100, 1) AS searchable_percent FROM image""")
def percent_of_total(spark, sf_dir):
    return stats.percentages(schema.images(spark, sf_dir))


@query(f"WITH {_IMAGES} SELECT 'ok' AS status, count(*) AS images FROM image")
def heartbeat(spark, sf_dir):
    return stats.heartbeat(spark).crossJoin(schema.images(spark, sf_dir).agg(F.count("*").alias("images")))


# Sessions -------------------------------------------------------------------------------------------------------

_LIVE = f"""SELECT o_orderkey AS session_id, c_name AS username FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate + INTERVAL 1 DAY > TIMESTAMP '{schema.NOW_SESSIONS}'"""


@query(f"{_LIVE} AND c_name = 'Customer#000000001'")
def session_auth(spark, sf_dir):
    return auth.authenticated(schema.sessions(spark, sf_dir), schema.users(spark, sf_dir), _session_now(), username="Customer#000000001")


@query(_LIVE)
def sessions_live(spark, sf_dir):
    return auth.authenticated(schema.sessions(spark, sf_dir), schema.users(spark, sf_dir), _session_now())


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_name = 'Customer#000000007'")
def login_lookup(spark, sf_dir):
    return auth.lookup(schema.users(spark, sf_dir), "Customer#000000007")


@query(f"""SELECT 'new-' || CAST(c_custkey AS VARCHAR) AS session_id, c_custkey AS user_id, TIMESTAMP '{schema.NOW_SESSIONS}' + INTERVAL 1 DAY AS expires_at
FROM customer""")
def session_insert_expiry(spark, sf_dir):
    logins = schema.users(spark, sf_dir).select(F.concat(F.lit("new-"), F.col("id").cast("string")).alias("session_id"), F.col("id").alias("user_id"))
    return auth.new_sessions(logins, _session_now())


@query("""SELECT o_orderkey AS session_id, o_custkey AS user_id FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderpriority = '1-URGENT' AND e.o_orderkey = o.o_orderkey)""")
def session_delete(spark, sf_dir):
    ended = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("session_id"))
    return auth.end_session(schema.sessions(spark, sf_dir), ended).select("session_id", "user_id")


@query("SELECT o_orderkey AS session_id, o_custkey AS user_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0")
def session_cascade(spark, sf_dir):
    """Users whose account is overdrawn are deleted, and their sessions with them."""
    customer = _table(spark, sf_dir, "customer")
    gone = customer.where("c_acctbal < 0").select("c_custkey")
    users = schema.users(spark, sf_dir).join(gone, F.col("id") == F.col("c_custkey"), "left_anti")
    return schema.cascade_sessions(schema.sessions(spark, sf_dir), users).select("session_id", "user_id")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS session_id,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS username FROM customer""")
def cookie_round_trip(spark, sf_dir):
    good = shape.encode_cookie(F.col("id"), F.col("username"))
    bad = F.when(F.col("id") % 10 == 0, F.lit("not base64!")).otherwise(F.base64(F.encode(F.lit("{broken"), "UTF-8")))
    cookie = shape.decode_cookie(F.when(F.col("id") % 5 == 0, bad).otherwise(good))
    return schema.users(spark, sf_dir).select("id", cookie.alias("c")).select("id", F.col("c.sessionId").alias("session_id"), F.col("c.username").alias("username"))


@query(f"{_LIVE} AND o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderdate + INTERVAL 1 DAY > TIMESTAMP '{schema.NOW_SESSIONS}')")
def session_auth_clustered(spark, sf_dir):
    """The check of one session on tables that are clustered by their keys: one row group of each is read."""
    at = {t: shared.fresh(spark, t) for t in ("session", "web_user")}
    layout.write(schema.sessions(spark, sf_dir), at["session"], layout.LAYOUTS["session"])
    layout.write(schema.users(spark, sf_dir), at["web_user"], layout.LAYOUTS["web_user"])
    newest = spark.read.parquet(at["session"]).where(F.col("expires_at") > _session_now()).agg(F.max("session_id")).first()[0]
    live = layout.lookup(spark, at["session"], layout.LAYOUTS["session"], newest)
    owner = live.first()
    who = layout.lookup(spark, at["web_user"], layout.LAYOUTS["web_user"], owner.user_id if owner else -1)
    return auth.authenticated(live, who, _session_now())


# Embedding backlog ----------------------------------------------------------------------------------------------


@query(f"WITH {_IMAGES} SELECT id, source FROM image WHERE embedding IS NULL ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT 10")
def reindex_backlog(spark, sf_dir):
    return reindex.backlog(schema.images(spark, sf_dir), seed=42).select("id", "source")


#: The CRC-32 of {x} as SQL, byte by byte and bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS INT), 2))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""
#: The stand-in's vectors of the addresses of images without one: sixteen signed hits, to unit length; a missing address hits the first place.
_EMBEDDED = f"""hits AS (SELECT id, {_CRC32.format(x="'image:' || source || ':' || k")} AS h FROM image, range(16) AS t(k) WHERE embedding IS NULL AND source IS NOT NULL),
summed AS (SELECT id, h % 64 AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM hits GROUP BY ALL
  UNION ALL SELECT id, 0, 1 FROM image WHERE embedding IS NULL AND source IS NULL),
places AS (SELECT id, place, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM summed),
whole AS (SELECT id, CAST(p AS INT) AS place, round(CASE WHEN embedding IS NULL THEN coalesce(x, 0) ELSE embedding[p + 1] END, 5) AS value, embedding IS NULL AS was_missing
  FROM image CROSS JOIN range(64) AS t(p) LEFT JOIN places USING (id) WHERE embedding IS NOT NULL OR place = p OR place IS NULL)"""
_REINDEXED = f"""WITH {_IMAGES}, {_EMBEDDED.replace("LEFT JOIN places USING (id) WHERE embedding IS NOT NULL OR place = p OR place IS NULL", "LEFT JOIN places ON places.id = image.id AND place = p").replace("SELECT id, CAST(p", "SELECT image.id, CAST(p")}
SELECT id, was_missing, place, value + 0.0 AS value FROM whole"""


def _places(done: DataFrame) -> DataFrame:
    return done.select("id", "was_missing", F.posexplode("embedding").alias("place", "x")).select("id", "was_missing", "place", (F.round("x", 5) + 0.0).alias("value"))


@query(_REINDEXED)
def reindex_in_one_pass(spark, sf_dir):
    images = schema.images(spark, sf_dir)
    new = reindex.embedded(images, encoder.HashEncoder(64))
    return _places(reindex.reindexed(images.withColumn("was_missing", F.col("embedding").isNull()), new))


@query(_REINDEXED)
def reindex_resumed(spark, sf_dir):
    """A job that stops after its first slice, and a second worker that does the rest."""
    images, at = schema.images(spark, sf_dir), shared.fresh(spark, "reindex")
    first = reindex.Job(spark, at)
    first.start(images, size=3)
    first.run(encoder.HashEncoder(64), most=1, seed=1)
    second = reindex.Job(spark, at)
    second.start(images)
    second.run(encoder.HashEncoder(64), seed=2)
    return _places(second.filled(images.withColumn("was_missing", F.col("embedding").isNull())))


# Events ---------------------------------------------------------------------------------------------------------


@query(f"""WITH top AS (SELECT coalesce(max(event_id), 0) AS m FROM events), new AS (
  SELECT 'imageDownloaded' AS event_type, '{{"id":"' || CAST(vec_id AS VARCHAR) || '"}}' AS payload FROM embeddings)
SELECT m + row_number() OVER (ORDER BY event_type, md5(payload), payload) AS id, event_type, payload, TIMESTAMP '{schema.NOW_EVENTS}' AS created_at FROM new, top""")
def event_append(spark, sf_dir):
    new = _table(spark, sf_dir, "embeddings").select(F.lit("imageDownloaded").alias("event_type"), events.payload("imageDownloaded", id=F.col("vec_id").cast("string")).alias("payload"))
    return events.append(schema.events(spark, sf_dir), new, _event_now())


@query("""SELECT row_number() OVER (ORDER BY event_type = 'view', ts, event_type, md5(props)) AS id, event_type, props AS payload, ts AS created_at
FROM events WHERE event_type IN ('click', 'view')""")
def event_log_of_writers(spark, sf_dir):
    """Two writers' batches, one of them sent twice; ids go on from batch to batch."""
    log, e = eventlog.EventLog(spark, shared.fresh(spark, "events")), schema.events(spark, sf_dir)
    for kind in ("click", "view", "click"):
        log.append(e.where(F.col("event_type") == kind).select("event_type", "payload", "created_at"), batch=kind)
    return log.read()


class _TwoWords(encoder.HashEncoder):
    """Embeds every text as the fixture's query vector."""

    def __init__(self, vector: list[float]):
        super().__init__(len(vector))
        self.vector = vector

    def embed_batch(self, inputs: list[str]) -> list[list[float]]:
        return [self.vector for _ in inputs]


@query(f"""WITH {_IMAGES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 1),
near AS (SELECT count(*) AS n FROM image CROSS JOIN q WHERE {_VISIBLE} AND {_DISTANCE.format(a='embedding', b='v')} <= 0.765),
seen AS (SELECT count(*) AS n FROM image WHERE {_VISIBLE})
SELECT * FROM (VALUES (1, 'getRandom', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), (SELECT least(54, n) FROM seen)),
 (2, 'getImageByIdAndSimilar', '1', NULL, (SELECT least(96, n - 1) FROM seen)),
 (3, 'vectorSearchByString', NULL, NULL, (SELECT n FROM near)),
 (4, 'adminUserLoginFailure', NULL, 'nobody', NULL), (5, 'adminUserLoginFailure', NULL, 'Customer#000000007', NULL),
 (6, 'adminUserLoginSuccess', NULL, 'Customer#000000007', NULL), (7, 'adminUserAuthSuccess', NULL, 'Customer#000000007', NULL),
 (8, 'imageDeleted', '1', 'Customer#000000007', NULL), (9, 'adminUserAuthSuccess', NULL, 'Customer#000000007', NULL),
 (10, 'setImageNotSearchable', '2', 'Customer#000000007', NULL), (11, 'adminUserLogout', NULL, NULL, NULL), (12, 'imageDownloaded', '3', NULL, NULL)
) AS t(position, event_type, id, username, results)""")
def events_of_actions(spark, sf_dir):
    """What the actions of one visitor and one administrator append to the log."""
    users = schema.users(spark, sf_dir).withColumn("password_hash", F.lit("plain"))
    sessions = schema.sessions(spark, sf_dir).withColumn("session_id", F.col("session_id").cast("string"))
    s, now = service.Service(schema.images(spark, sf_dir), users, sessions), _session_now()
    s.random(seed=1)
    s.similar(1)
    s.search("any", _TwoWords(_query_vector(spark, sf_dir)))
    s.search("", None)
    s.login("nobody", "x", now)
    right = lambda stored, password: password == "right"
    s.login("Customer#000000007", "wrong", now, verify=right)
    got = s.login("Customer#000000007", "right", now, verify=right)
    s.set_deleted(got["cookie"], now, 1, True)
    s.set_searchable(got["cookie"], now, 2, False)
    s.logout(s.told[-1][1]["sessionId"])
    s.downloaded(3)
    rows = [(i + 1, kind, None if p.get("id") is None else str(p["id"]), p.get("username"), p.get("results")) for i, (kind, p) in enumerate(s.told)]
    return spark.createDataFrame(rows, "position int, event_type string, id string, username string, results long")


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_payload_json(spark, sf_dir):
    return schema.events(spark, sf_dir).select("id", F.get_json_object("payload", "$.k").cast("long").alias("k"))


def _changes(spark, sf_dir, on, off):
    e = schema.events(spark, sf_dir).where("event_type in ('click', 'view')")
    return e.select("id", (F.col("id") % 500).alias("image_id"), F.when(F.col("event_type") == "click", on).otherwise(off).alias("event_type"), "created_at")


def _overlay_sql(flag: str) -> str:
    return f"""WITH {_IMAGES}, last AS (
  SELECT event_id % 500 AS image_id, arg_max(event_type, (ts, event_id)) AS t FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT id, CASE WHEN t IS NULL THEN {flag} ELSE t = 'click' END AS {flag} FROM image LEFT JOIN last ON id = image_id"""


@query(_overlay_sql("deleted"))
def flag_overlay_after_events(spark, sf_dir):
    return events.with_deleted(schema.images(spark, sf_dir), _changes(spark, sf_dir, "imageDeleted", "imageUndeleted")).select("id", "deleted")


@query(_overlay_sql("searchable"))
def searchable_overlay_after_events(spark, sf_dir):
    return events.with_searchable(schema.images(spark, sf_dir), _changes(spark, sf_dir, "setImageSearchable", "setImageNotSearchable")).select("id", "searchable")


@query(f"""WITH {_IMAGES}, kinds(event_type, flag, value, batch) AS (VALUES ('click', 'deleted', true, 1), ('view', 'deleted', false, 2), ('purchase', 'searchable', true, 2), ('error', 'searchable', false, 1)),
last AS (SELECT event_id % 500 AS image_id, flag, arg_max(kinds.value, (ts, batch, kinds.event_type)) AS v FROM events JOIN kinds USING (event_type) GROUP BY ALL)
SELECT id, coalesce(d.v, deleted) AS deleted, coalesce(s.v, searchable) AS searchable FROM image
LEFT JOIN last d ON d.image_id = id AND d.flag = 'deleted' LEFT JOIN last s ON s.image_id = id AND s.flag = 'searchable'""")
def flags_from_snapshot(spark, sf_dir):
    """Flags from a snapshot of one batch and the tail after it, whose events are in part older than the snapshot's."""
    kinds = {"click": "imageDeleted", "view": "imageUndeleted", "purchase": "setImageSearchable", "error": "setImageNotSearchable"}
    e = schema.events(spark, sf_dir)
    told = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    named = F.to_json(F.struct((F.col("id") % 500).cast("string").alias("id")))
    of = lambda *names: e.where(F.col("event_type").isin(*names)).select(told.alias("event_type"), named.alias("payload"), "created_at")
    log = eventlog.EventLog(spark, shared.fresh(spark, "events"))
    log.append(of("click", "error"), batch="first")
    log.snapshot()
    log.append(of("view", "purchase"), batch="second")
    return log.images(schema.images(spark, sf_dir)).select("id", "deleted", "searchable")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    w = streaming.counts_by_window(schema.events(spark, sf_dir))
    return w.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


# Shaping --------------------------------------------------------------------------------------------------------


@query(f"""WITH {_IMAGES} SELECT id, CASE WHEN starts_with(source, 'https://reddit.com/') THEN 'https://redd.it/' || substr(source, 20) ELSE coalesce(source, '') END AS source FROM image""")
def url_rewrite(spark, sf_dir):
    return schema.images(spark, sf_dir).select("id", shape.rewrite_source(F.col("source")).alias("source"))


_P = shape.DEFAULT_PREFIX


@query(f"""WITH {_IMAGES} SELECT id, '{_P}/original/' || id || '.' || extension AS url,
{', '.join(f"'{_P}/{k}/{w}/' || id || '.{e}' AS {k}_{w}" for k, e in shape.FORMATS.items() for w in shape.WIDTHS)} FROM image""")
def image_urls(spark, sf_dir):
    s = schema.images(spark, sf_dir).select("id", shape.shaped(F.col("id"), F.col("source"), F.col("extension")).alias("s"))
    return s.select("id", "s.url", *[F.col(f"s.{k}.`{w}`").alias(f"{k}_{w}") for k in shape.FORMATS for w in shape.WIDTHS])


@query(f"""WITH {_IMAGES} SELECT id, CASE WHEN source IS NULL OR split_part(source, '/', -1) = '' THEN 'cover' ELSE split_part(source, '/', -1) END AS filename FROM image""")
def filename(spark, sf_dir):
    return schema.images(spark, sf_dir).select("id", shape.filename(F.col("source")).alias("filename"))


@query(f"""WITH {_IMAGES} SELECT id, '{{' || concat_ws(',', '"id":' || id, CASE WHEN searchable IS NULL THEN NULL ELSE '"searchable":' || searchable END) || '}}' AS json FROM image""")
def optional_fields_json(spark, sf_dir):
    return schema.images(spark, sf_dir).select("id", F.to_json(F.struct("id", "searchable")).alias("json"))


@query("SELECT vec_id AS i, vec_id % 15 IN (1, 9, 10) AS large, vec_id % 7 = 3 AS medium FROM embeddings")
def layout_flags(spark, sf_dir):
    i = F.col("vec_id")
    return _table(spark, sf_dir, "embeddings").select(i.alias("i"), shape.wide_cell(i, True).alias("large"), shape.wide_cell(i, False).alias("medium"))


@query("SELECT c_custkey AS id, format('{:,}', c_custkey * 1000) AS grouped, round(c_acctbal, 1) AS one_digit FROM customer")
def number_format(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.format_number(F.col("c_custkey") * 1000, 0).alias("grouped"), F.round("c_acctbal", 1).alias("one_digit"))


@query("""WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '12.5' END AS raw FROM customer)
SELECT id, CASE raw WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, TRY_CAST(raw AS DOUBLE) AS number, false AS uuid FROM t""")
def value_validation(spark, sf_dir):
    raw = F.when(F.col("id") % 4 == 0, "true").when(F.col("id") % 4 == 1, "false").when(F.col("id") % 4 == 2, "12.5")
    t = schema.users(spark, sf_dir).select("id", raw.alias("raw"))
    return t.select("id", shape.parse_bool(F.col("raw")).alias("flag"), shape.parse_number(F.col("raw")).alias("number"), F.coalesce(shape.is_uuid(F.col("raw")), F.lit(False)).alias("uuid"))


@query(f"""WITH {_IMAGES} SELECT id, round(list_sum(list_transform(embedding, lambda x: (2 * x) * (2 * x))), 6) AS squared, len(embedding) AS dims FROM image""")
def vector_parse_normalize(spark, sf_dir):
    doubled = F.to_json(F.transform("embedding", lambda x: 2 * x))
    v = schema.images(spark, sf_dir).select("id", vector.parse(doubled, 64).alias("v"))
    again = F.transform(vector.l2_normalize(F.col("v")), lambda x: x * vector.norm(F.col("v")))
    return v.select("id", F.round(vector.dot(again, F.col("v")), 6).alias("squared"), F.when(F.col("v").isNotNull(), F.size("v")).cast("long").alias("dims"))


# Encoder --------------------------------------------------------------------------------------------------------

def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{encoder.BLANK}]+', ''), '[{encoder.BLANK}]+$', '')"


_LINES = f"""WITH t AS (SELECT doc_id, {_strip('text')} AS x FROM documents),
l AS (SELECT doc_id, list_transform(string_split_regex(x, '\\r\\n|[{encoder.NEW_LINE}]'), lambda p: {_strip('p')}) AS parts FROM t WHERE x <> '')
SELECT doc_id, CAST(i - 1 AS INT) AS line, md5(parts[i]) AS input_md5, CASE WHEN regexp_matches(parts[i], '^https?://') THEN 'image' ELSE 'text' END AS kind
FROM l, LATERAL unnest(range(1, len(parts) + 1)) AS u(i)"""


@query(_LINES)
def encoder_dispatch_lines(spark, sf_dir):
    d = encoder.dispatch(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "line", F.md5("input").alias("input_md5"), "kind")


@query()
def embed_text(spark, sf_dir):
    inputs = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("input"))
    return encoder.embed_column(inputs, encoder.HashEncoder(64)).select("item_id", "embedding")


def _hashed(spark, sf_dir):
    return schema.images(spark, sf_dir).select("id", F.col("blurhash").alias("hash"))


@query(f"WITH {_IMAGES}, {_LOOKS} SELECT id, url_md5 FROM image LEFT JOIN looks ON blurhash = hash")
def blurhash_png(spark, sf_dir):
    return _hashed(spark, sf_dir).select("id", F.md5(blurhash.data_url_column(F.col("hash"))).alias("url_md5"))


@query(f"""WITH {_IMAGES}, {_LOOKS} SELECT id, h, s, l, 'hsla(' || round(h, 1) || ', ' || round(s, 1) || '%, ' || round(l * 0.6, 1) || '%, 1)' AS shadow
FROM image LEFT JOIN looks ON blurhash = hash""")
def primary_color(spark, sf_dir):
    c = _hashed(spark, sf_dir).select("id", blurhash.primary_colour_column(F.col("hash")).alias("c"))
    return c.select("id", F.round("c.h", 3).alias("h"), F.round("c.s", 3).alias("s"), F.round("c.l", 3).alias("l"), shape.shadow(F.col("c.h"), F.col("c.s"), F.col("c.l")).alias("shadow"))


# Catalogue ------------------------------------------------------------------------------------------------------

#: References among the test tables: table, column, referenced table, column.
REFERENCES = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
TABLES = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]
_HOLDING = "edges(t, r) AS (" + " UNION ALL ".join(f"SELECT '{t}', '{r}' WHERE NOT EXISTS (SELECT 1 FROM {t} ANTI JOIN {r} ON {c} = {k})" for t, c, r, k in REFERENCES) + ")"


@query(" UNION ALL ".join(f"SELECT '{t}' AS relation, '{c}' AS columns, '{r}.{k}' AS target WHERE NOT EXISTS (SELECT 1 FROM {t} ANTI JOIN {r} ON {c} = {k})" for t, c, r, k in REFERENCES))
def references_found(spark, sf_dir):
    """References that the tables' own values hold to: key columns whose values all are in the unique column of that name of another table."""
    return catalog.references_held({t: _table(spark, sf_dir, t) for t in TABLES})


@query(f"""WITH RECURSIVE {_HOLDING},
tables(t) AS (VALUES {', '.join(f"('{t}')" for t in TABLES)}),
depth(t, d) AS (SELECT t, 0 FROM tables UNION SELECT e.t, d + 1 FROM edges e JOIN depth ON e.r = depth.t)
SELECT t AS table_name, CAST(row_number() OVER (ORDER BY max(d), t) AS INT) AS position FROM depth GROUP BY t""")
def fk_load_order(spark, sf_dir):
    found = references_found(spark, sf_dir).collect()  # one row a reference
    order = catalog.load_order(TABLES, [(r.relation, r.target.split(".")[0]) for r in found])
    return spark.createDataFrame([(t, i + 1) for i, t in enumerate(order)], "table_name string, position int")


@query("""SELECT 'customer' AS name, CAST(max(c_custkey) AS BIGINT) AS last, CAST(max(c_custkey) + 1 AS BIGINT) AS next FROM customer
UNION ALL SELECT 'orders', max(o_orderkey), max(o_orderkey) + 1 FROM orders UNION ALL SELECT 'events', max(event_id), max(event_id) + 1 FROM events
UNION ALL SELECT 'region', max(r_regionkey), max(r_regionkey) + 1 FROM region UNION ALL SELECT 'none', 0, 1""")
def sequences_resynced(spark, sf_dir):
    """Counters after they were set to their tables' largest ids, and what the next insert gets; an empty table's begins at 1."""
    counters = sequences.Sequences(spark, shared.fresh(spark, "counters"))
    t = lambda name: _table(spark, sf_dir, name)
    tables = {"customer": (t("customer"), "c_custkey"), "orders": (t("orders"), "o_orderkey"), "events": (t("events"), "event_id"), "region": (t("region"), "r_regionkey"), "none": (t("events").limit(0), "event_id")}
    tops = counters.resync_to(tables)
    return spark.createDataFrame([(name, top, counters.take(name)) for name, top in tops.items()], "name string, last long, next long")


@query("SELECT coalesce(max(event_id), 0) AS max_id, coalesce(max(event_id), 0) + 1 AS next_id FROM events")
def max_id_resync(spark, sf_dir):
    return catalog.next_id(schema.events(spark, sf_dir), "id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_in_catalog(spark, sf_dir):
    return catalog.not_in(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", _table(spark, sf_dir, "orders"), "o_custkey")


@query("""SELECT c_mktsegment, count(*) AS n, array_to_string(list_sort(list(c_name)), ',') AS names,
CAST(len(list_filter(list(c_name), lambda x: x <> 'Customer#000000001')) AS INT) AS others, bool_or(c_name = 'Customer#000000001') AS has_first FROM customer GROUP BY c_mktsegment""")
def array_ops(spark, sf_dir):
    g = _table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("c_name")).alias("l"))
    first = F.lit("Customer#000000001")
    return g.select("c_mktsegment", "n", F.array_join("l", ",").alias("names"), F.size(catalog.without(F.col("l"), first)).alias("others"), F.array_contains("l", first).alias("has_first"))


@query(r"""WITH v AS (SELECT c_custkey AS id, 'SELECT * FROM prod.t' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN ' WITH NO DATA;' WHEN 1 THEN ' with data' WHEN 2 THEN ';' ELSE '' END AS sql FROM customer)
SELECT id, regexp_replace(regexp_replace(sql, '\s+with\s+(no\s+)?data\s*;?\s*$', '', 'i'), ';\s*$', '') AS sql FROM v""")
def regex_strip(spark, sf_dir):
    k = F.col("id") % 4
    tail = F.when(k == 0, " WITH NO DATA;").when(k == 1, " with data").when(k == 2, ";").otherwise("")
    return schema.users(spark, sf_dir).select("id", shape.strip_view_tail(F.concat(F.lit("SELECT * FROM prod.t"), F.col("id").cast("string"), tail)).alias("sql"))


@query("""WITH v AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'nextval(prod.' || n_name || ')' ELSE n_name END AS d FROM nation)
SELECT id, d LIKE '%prod.%' AS mentions, replace(d, 'prod.', 'dev.') AS moved FROM v""")
def catalog_like(spark, sf_dir):
    d = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("nextval(prod."), F.col("n_name"), F.lit(")"))).otherwise(F.col("n_name"))
    v = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), d.alias("d"))
    return v.select("id", catalog.mentions(F.col("d"), F.lit("prod")).alias("mentions"), catalog.requalified(F.col("d"), "prod", "dev").alias("moved"))


@query("""SELECT r_name, n_name, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
WHERE r_name IN ('ASIA', 'EUROPE') AND n_nationkey <> 0 GROUP BY r_name, n_name ORDER BY r_name, n_name""")
def multiway_join(spark, sf_dir):
    r, n, c = (_table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    joined = r.where(F.col("r_name").isin("ASIA", "EUROPE")).join(n.where("n_nationkey != 0"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("customers")).orderBy("r_name", "n_name")


@query("""SELECT 'unique(c_mktsegment)' AS rule, count(*) AS n FROM (SELECT c_mktsegment FROM customer GROUP BY c_mktsegment HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'references(c_custkey, supplier.s_suppkey)', count(*) FROM customer ANTI JOIN supplier ON c_custkey = s_suppkey HAVING count(*) > 0
UNION ALL SELECT 'references(c_nationkey, nation.n_nationkey)', count(*) FROM customer ANTI JOIN nation ON c_nationkey = n_nationkey HAVING count(*) > 0""")
def constraint_violations(spark, sf_dir):
    rules = schema.Constraints(key=("c_custkey",), unique=(("c_mktsegment",),), not_null=("c_name",), references={"c_custkey": ("supplier", "s_suppkey"), "c_nationkey": ("nation", "n_nationkey")})
    return schema.violations(_table(spark, sf_dir, "customer"), rules, {t: _table(spark, sf_dir, t) for t in ("supplier", "nation")})


@query("""SELECT r_name, p_type, n_name, count(*) AS line_items, count(DISTINCT c_custkey) AS customers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def six_way_join(spark, sf_dir):
    line, o, c, n, r, p = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region", "part"))
    joined = line.join(o.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("r_name", "p_type", "n_name").agg(F.count("*").alias("line_items"), F.countDistinct("c_custkey").alias("customers"))


#: Rules of the fixture's database, whose tables are made of the test tables.
FIXTURE_RULES = {
    "web_user": rules.Rules(key=("id",), unique=(("username",),), not_null=("id", "username"), layout=layout.LAYOUTS["web_user"], sequence="id"),
    "session": rules.Rules(key=("session_id",), not_null=("user_id", "expires_at"), references={"user_id": ("web_user", "id")}, layout=layout.LAYOUTS["session"]),
    "image": rules.Rules(key=("id",), not_null=("deleted",), checks={"extension": "extension IN ('jpg', 'png', 'webp')"}, defaults={"searchable": "true", "from_old_database": "false", "deleted": "false"}, layout=layout.LAYOUTS["image"]),
    "analytics_event": rules.Rules(key=("id",), not_null=("event_type", "payload", "created_at"), defaults={"created_at": "now()"}, layout=layout.LAYOUTS["analytics_event"], sequence="id"),
}


def fixture_database(spark: SparkSession, sf_dir: str, name: str) -> None:
    """A database of the fixture's relations, with their rules in the catalogue."""
    at = shared.fresh(spark, name)
    made = {"web_user": schema.users(spark, sf_dir), "session": schema.sessions(spark, sf_dir), "image": schema.images(spark, sf_dir).withColumn("hash", F.md5(F.col("id").cast("string"))), "analytics_event": schema.events(spark, sf_dir)}
    spark.sql(f"CREATE DATABASE {shape.quote_ident(name)}")
    for table, df in made.items():
        df.write.parquet(f"{at}/{table}")
        spark.sql(f"CREATE TABLE {shape.quote_ident(name)}.{shape.quote_ident(table)} USING parquet LOCATION {shape.quote_literal(f'{at}/{table}')}")
        rules.put(spark, name, table, FIXTURE_RULES[table])
        rules.put_references(spark, name, table, FIXTURE_RULES[table])


def _cloned(spark: SparkSession, sf_dir: str) -> clone.Target:
    """A clone of the fixture's database that has replaced an older one."""
    key = uuid.uuid4().hex[:12]
    source, target = f"fixture_{key}", clone.Target(spark, f"copy_{key}", shared.fresh(spark, "clones"))
    fixture_database(spark, sf_dir, source)
    try:
        target.clone_of(source)
        target.clone_of(source)
        target.vacuum()
    finally:
        spark.sql(f"DROP DATABASE {shape.quote_ident(source)} CASCADE")
    return target


@query("""SELECT * FROM (VALUES
 ('image', 'key', 'id', NULL), ('image', 'not null', 'deleted', NULL), ('image', 'check', 'extension', 'extension IN (''jpg'', ''png'', ''webp'')'), ('image', 'default', 'searchable', 'true'),
 ('image', 'default', 'from_old_database', 'false'), ('image', 'default', 'deleted', 'false'), ('image', 'layout', 'id', 'hash'),
 ('web_user', 'key', 'id', NULL), ('web_user', 'unique', 'username', NULL), ('web_user', 'not null', 'id', NULL), ('web_user', 'not null', 'username', NULL), ('web_user', 'layout', 'id', 'username'), ('web_user', 'sequence', 'id', NULL),
 ('session', 'key', 'session_id', NULL), ('session', 'not null', 'user_id', NULL), ('session', 'not null', 'expires_at', NULL), ('session', 'references', 'user_id', 'web_user.id'), ('session', 'layout', 'session_id', 'user_id'),
 ('analytics_event', 'key', 'id', NULL), ('analytics_event', 'not null', 'event_type', NULL), ('analytics_event', 'not null', 'payload', NULL), ('analytics_event', 'not null', 'created_at', NULL),
 ('analytics_event', 'default', 'created_at', 'now()'), ('analytics_event', 'layout', 'id', 'event_type'), ('analytics_event', 'sequence', 'id', NULL)
) AS t(relation, kind, columns, target), (SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM orders) AS sessions, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM embeddings) AS images)""")
def catalog_constraints(spark, sf_dir):
    """Rules as a clone of the fixture's database has them in the catalogue, beside the sizes of its tables."""
    target = _cloned(spark, sf_dir)
    made = target.database()
    sizes = {"users": "web_user", "sessions": "session", "events": "analytics_event", "images": "image"}
    found = rules.scan(spark, made)
    for name, table in sizes.items():
        found = found.crossJoin(target.table(table).agg(F.count("*").alias(name)))
    return found


@query(f"""SELECT o_orderkey AS session_id, c_name AS username, o_orderdate + INTERVAL 1 DAY AS expires_at, (SELECT max(event_id) + 1 FROM events) AS next_event FROM orders JOIN customer ON o_custkey = c_custkey""")
def cloned_sessions(spark, sf_dir):
    """Rows of a clone, and the id that its next event gets."""
    target = _cloned(spark, sf_dir)
    next_ = target.sequences().take("analytics_event")
    return target.table("session").join(target.table("web_user"), F.col("user_id") == F.col("id")).select("session_id", "username", "expires_at", F.lit(next_).alias("next_event"))
