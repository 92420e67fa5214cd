"""Relations of the catalogue: schemas, constraints, and views of the test tables in their shape."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_vector = T.ArrayType(T.FloatType())

#: Embedding models by name, with column and dimensions.
MODELS = {
    "mobileclip_s0": ("embedding_mobileclip_s0", 512),
    "mobileclip_s1": ("embedding_mobileclip_s1", 512),
    "mobileclip_s2": ("embedding_mobileclip_s2", 512),
    "mobileclip_b": ("embedding_mobileclip_b", 512),
    "mobileclip_blt": ("embedding_mobileclip_blt", 512),
}
DEFAULT_MODEL = "mobileclip_s0"

IMAGE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("extension", T.StringType()),
        T.StructField("old_hash", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("embedding", _vector),
        T.StructField("searchable", T.BooleanType()),
        T.StructField("blurhash", T.StringType()),
        *[T.StructField(column, _vector) for column, _ in MODELS.values()],
        T.StructField("from_old_database", T.BooleanType()),
        T.StructField("deleted", T.BooleanType(), False),
    ]
)
WEB_USER = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("username", T.StringType(), False), T.StructField("password_hash", T.StringType(), False)])
SESSION = T.StructType([T.StructField("session_id", T.StringType(), False), T.StructField("user_id", T.IntegerType(), False), T.StructField("expires_at", T.TimestampType(), False)])
ANALYTICS_EVENT = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("event_type", T.StringType(), False), T.StructField("payload", T.StringType()), T.StructField("created_at", T.TimestampType(), False)])
IMAGE_NEIGHBOR = T.StructType([T.StructField("id1", T.StringType(), False), T.StructField("id2", T.StringType(), False), T.StructField("distance", T.DoubleType())])


def model_column(model: str | None) -> str:
    """The vector column of a model; unknown names fall back to the default model."""
    return MODELS.get(model or DEFAULT_MODEL, MODELS[DEFAULT_MODEL])[0]


RELATIONS = {"image": IMAGE, "web_user": WEB_USER, "session": SESSION, "analytics_event": ANALYTICS_EVENT, "image_neighbor": IMAGE_NEIGHBOR}


@dataclass(frozen=True)
class Constraints:
    """What a written table must satisfy."""

    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, column)
    defaults: dict[str, object] = field(default_factory=dict)


CONSTRAINTS = {
    "image": Constraints(key=("id",), not_null=("deleted",), defaults={"searchable": True, "from_old_database": False, "deleted": False}),
    "web_user": Constraints(key=("id",), unique=(("username",),), not_null=("username", "password_hash")),
    "session": Constraints(key=("session_id",), not_null=("user_id", "expires_at"), references={"user_id": ("web_user", "id")}),
    "analytics_event": Constraints(key=("id",), not_null=("event_type", "created_at")),
    "image_neighbor": Constraints(unique=(("id1", "id2"),), not_null=("id1", "id2")),
}


def with_defaults(df: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """df in a relation's schema: absent columns take their default, or null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def violations(df: DataFrame, rules: Constraints, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, n): how many rows or key values break each rule; no rows if all hold."""
    found = []
    for columns in ([rules.key] if rules.key else []) + list(rules.unique):
        repeated = df.groupBy(*columns).agg(F.count("*").alias("c")).where("c > 1")
        found.append(repeated.agg(F.lit(f"unique({', '.join(columns)})").alias("rule"), F.count("*").alias("n")))
    nulls = dict.fromkeys((*rules.key, *rules.not_null))
    if nulls:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in nulls])
        found.append(counts.select(F.inline(F.array(*[F.struct(F.lit(f"not null({c})").alias("rule"), F.col(c).alias("n")) for c in nulls]))))
    for column, (table, target) in rules.references.items():
        parent = (tables or {})[table].select(F.col(target).alias("_parent"))
        lost = df.where(F.col(column).isNotNull()).join(parent, df[column] == F.col("_parent"), "left_anti")
        found.append(lost.agg(F.lit(f"references({column}, {table}.{target})").alias("rule"), F.count("*").alias("n")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


class ConstraintError(ValueError):
    pass


def write(df: DataFrame, path: str, table: str, tables: dict[str, DataFrame] | None = None, *, mode: str = "append") -> None:
    """Write rows of a relation in its schema, with defaults filled in, after its constraints were checked.

    With what is there already, keys must stay unique; nothing is written where a rule is broken.
    """
    relation, rules = RELATIONS[table], CONSTRAINTS[table]
    rows = with_defaults(df, relation, rules.defaults)
    there = df.sparkSession.read.schema(relation).parquet(path) if mode == "append" and _exists(df.sparkSession, path) else None
    broken = violations(rows if there is None else there.unionByName(rows), rules, tables).collect()  # one row a rule at most
    if broken:
        raise ConstraintError("; ".join(f"{r.rule}: {r.n}" for r in broken))
    rows.write.mode(mode).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def described(spark: SparkSession) -> DataFrame:
    """(relation, kind, columns, target): keys, unique and not-null rules, references and defaults of all relations."""
    rows = []
    for name, c in CONSTRAINTS.items():
        rows += [(name, "key", ",".join(c.key), None)] if c.key else []
        rows += [(name, "unique", ",".join(u), None) for u in c.unique] + [(name, "not null", x, None) for x in c.not_null]
        rows += [(name, "references", x, ".".join(t)) for x, t in c.references.items()]
        rows += [(name, "default", x, json.dumps(v)) for x, v in c.defaults.items()]
    return spark.createDataFrame(rows, "relation string, kind string, columns string, target string")


def cascade_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions of users that still exist."""
    return sessions.join(users, sessions["user_id"] == users["id"], "left_semi")


# Views of the test tables ---------------------------------------------------------------------------------------

NOW_EVENTS = "2024-01-31 00:00:00"
NOW_SESSIONS = "1998-01-01 00:00:00"

#: Valid preview hashes of the fixture, by number.
HASHES = ("LEHV6nWB2yk8pyo0adR*.7kCMdnj", "LGF5]+Yk^6#M@-5c,1J5@[or[Q6.", "L6PZfSi_.AyE_3t7t7R**0o#DgR4", "LKO2?U%2Tw=w]~RBVZRi};RPxuwH")

#: Columns of the fixture's image relation; <T> is a list of doubles and <STR> text in the engine at hand.
_IMAGE = {
    "id": "vec_id",
    "embedding": "CASE WHEN vec_id % 97 = 0 THEN NULL ELSE CAST(embedding AS <T>) END",
    "searchable": "CASE WHEN vec_id % 37 = 0 THEN NULL WHEN vec_id % 10 = 0 THEN false ELSE true END",
    "deleted": "vec_id % 7 = 0",
    "extension": "CASE WHEN vec_id % 53 = 0 THEN NULL WHEN label < 5 THEN 'jpg' WHEN label < 8 THEN 'png' ELSE 'webp' END",
    "source": """CASE WHEN vec_id % 3 = 0 THEN concat('https://reddit.com/', CAST(vec_id AS <STR>))
       WHEN vec_id % 3 = 1 THEN concat('https://example.org/', CAST(vec_id AS <STR>)) END""",
    "from_old_database": "vec_id % 2 = 0",
    "blurhash": "CASE WHEN vec_id % 41 = 0 THEN NULL " + " ".join(f"WHEN vec_id % {len(HASHES)} = {i} THEN '{h}'" for i, h in enumerate(HASHES)) + " END",
}


def _columns(kind: str, text: str) -> list[str]:
    return [e.replace("<T>", kind).replace("<STR>", text) + f" AS {name}" for name, e in _IMAGE.items()]


IMAGE_DUCK = f"SELECT {', '.join(_columns('double[]', 'varchar'))} FROM embeddings"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(*_columns("array<double>", "string"))


def images_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """images() with a vector column for two models: the first has the fixture's vectors, the third their squares."""
    one, three = model_column("mobileclip_s0"), model_column("mobileclip_s2")
    return images(spark, sf_dir).withColumn(one, F.col("embedding")).withColumn(three, F.transform("embedding", lambda x: x * x))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "event_type", F.col("props").alias("payload"), F.col("ts").cast("timestamp_ntz").alias("created_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
