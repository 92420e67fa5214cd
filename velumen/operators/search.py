"""Gallery, lookup, more-like-this and range search over images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velumen.functions import blurhash, shape, vector

GALLERY, SIMILAR, THRESHOLD = 54, 96, 0.765


class NotFound(LookupError):
    pass


def visible() -> Column:
    """Searchable beyond doubt, and not deleted."""
    return F.col("searchable").eqNullSafe(F.lit(True)) & F.col("deleted").eqNullSafe(F.lit(False))


def many(df: DataFrame) -> list:
    """All rows; none is an error."""
    rows = df.collect()
    if not rows:
        raise NotFound("no rows")
    return rows


def maybe_one(df: DataFrame):
    """The row, or None; several are an error."""
    rows = df.take(2)
    if len(rows) > 1:
        raise ValueError("several rows")
    return rows[0] if rows else None


def random_gallery(images: DataFrame, *, seed: int | None = None, limit: int = GALLERY) -> DataFrame:
    """Visible images in random order; with a seed, an order that every engine can repeat."""
    order = F.rand() if seed is None else F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return images.where(visible()).select("id", "source", "extension", "from_old_database", order.alias("_o")).orderBy("_o", "id").limit(limit).drop("_o")


def by_id(images: DataFrame, id_) -> DataFrame:
    """The image, visible or not."""
    return images.where(F.col("id") == F.lit(id_))


def similar(images: DataFrame, id_, *, column: str = "embedding", limit: int | None = SIMILAR, digits: int | None = None) -> DataFrame:
    """(id, distance) of the nearest visible images, of all without a limit; none if the target is missing or deleted. Missing embeddings come last."""
    target = by_id(images, id_).where(F.col("deleted").eqNullSafe(F.lit(False))).select(F.col(column).alias("_t"))
    distance = vector.cosine_distance(F.col(column), F.col("_t"))
    distance = distance if digits is None else F.round(distance, digits)
    near = images.where(visible() & (F.col("id") != F.lit(id_))).select("id", column).crossJoin(F.broadcast(target.limit(1)))
    ordered = near.select("id", distance.alias("distance")).orderBy(F.col("distance").asc_nulls_last(), "id")
    return ordered if limit is None else ordered.limit(limit)


def _bounded(limit: int | None) -> None:
    if limit is None or limit > 10_000:
        raise ValueError("ranks are those of a bounded list: name a limit of 10000 at most")


def with_target_first(images: DataFrame, id_, **options) -> DataFrame:
    """(rank, id, distance): the target at rank 0, its neighbours after it."""
    _bounded(options.get("limit", SIMILAR))
    near = similar(images, id_, **options)
    # A bounded list: ranks are those of a top-k.
    ranked = near.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("distance").isNull().alias("last"), "distance", "id"))).alias("l"))
    ranked = ranked.select(F.posexplode("l")).select((F.col("pos") + 1).alias("rank"), F.col("col.id").alias("id"), F.col("col.distance").alias("distance"))
    first = by_id(images, id_).select(F.lit(0).alias("rank"), "id", F.lit(None).cast("double").alias("distance"))
    return first.unionByName(ranked)


#: Columns of the record of an image, beside its distance.
RECORD = ("id", "source", "extension", "blurhash", "from_old_database", "searchable")


def similar_records(images: DataFrame, id_, *, column: str = "embedding", limit: int = SIMILAR, digits: int | None = None) -> DataFrame:
    """(rank, the record's columns, distance): the target's record at rank 0, even if deleted, and those of its nearest."""
    _bounded(limit)
    near = similar(images, id_, column=column, limit=limit, digits=digits).withColumnRenamed("id", "_id")
    found = images.join(near, images["id"] == near["_id"]).select(*RECORD, "distance")
    # A bounded list: ranks are those of a top-k.
    listed = found.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("distance").isNull().alias("last"), "distance", *RECORD))).alias("l"))
    ranked = listed.select(F.posexplode("l")).select((F.col("pos") + 1).alias("rank"), *[F.col(f"col.{c}").alias(c) for c in (*RECORD, "distance")])
    return by_id(images, id_).select(F.lit(0).alias("rank"), *RECORD, F.lit(None).cast("double").alias("distance")).unionByName(ranked)


def shaped_records(records: DataFrame, prefix: str = shape.DEFAULT_PREFIX) -> DataFrame:
    """Records with the whole response record as `shaped`: addresses, preview, primary colour and the optional fields."""
    # Equal previews are decoded once; there are no more of them than records.
    seen = records.select("blurhash").where("blurhash is not null").distinct()
    looks = seen.select(F.col("blurhash").alias("_h"), blurhash.data_url_column(F.col("blurhash")).alias("_u"), blurhash.primary_colour_column(F.col("blurhash")).alias("_c"))
    joined = records.join(looks, records["blurhash"] == looks["_h"], "left")
    optional = {c: F.col(c) for c in ("searchable", "distance", "from_old_database") if c in records.columns}
    record = shape.shaped(F.col("id"), F.col("source"), F.col("extension"), prefix, blurhashUrl=F.coalesce("_u", F.lit("")), primaryColor=F.col("_c"), **optional)
    return joined.select(*records.columns, record.alias("shaped"))


def within(images: DataFrame, query: list[float] | Column, *, threshold: float = THRESHOLD, column: str = "embedding", digits: int | None = None) -> DataFrame:
    """Records with distance of all visible images no farther than the threshold, nearest first."""
    query = query if isinstance(query, Column) else vector.literal(query)
    distance = vector.cosine_distance(F.col(column), query)
    distance = distance if digits is None else F.round(distance, digits)
    found = images.where(visible()).withColumn("distance", distance).where(F.col("distance") <= threshold)
    return found.select(*[c for c in RECORD if c in images.columns], "distance").orderBy("distance", "id")


def search_text(images: DataFrame, text: str, encoder, **options) -> DataFrame:
    """Range search by the embedding of a text or of the image at an address; empty text finds nothing."""
    if text == "":
        return within(images.limit(0), [1.0], **options)
    vectors = encoder.embed(text)
    if not vectors:
        raise ValueError("the encoder gave no embedding")
    return within(images, vectors[0], **options)


def api_json(found: DataFrame, prefix: str = shape.DEFAULT_PREFIX) -> DataFrame:
    """One JSON text per hit, as the search address answers."""
    url = shape.original_url(F.col("id"), F.col("extension"), prefix)
    return found.select("id", F.to_json(F.struct(F.struct(F.struct(url.alias("original")).alias("png")).alias("versions"))).alias("json"))
