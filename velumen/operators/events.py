"""The append-only event log, and image flags as its overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velumen.operators.numbering import numbered

#: Event types and the keys of their payloads, fixed values of the log format.
VOCABULARY: dict[str, tuple[str, ...]] = {
    "getRandom": ("results", "time"),
    "getImageByIdAndSimilar": ("id", "results", "time"),
    "vectorSearchByString": ("model", "q", "results", "embedTime", "dbTime", "totalTime"),
    "imageDeleted": ("id", "username", "sessionId"),
    "imageUndeleted": ("id", "username", "sessionId"),
    "setImageSearchable": ("id", "username", "sessionId"),
    "setImageNotSearchable": ("id", "username", "sessionId"),
    "adminUserAuthSuccess": ("sessionId", "username"),
    "adminUserLoginFailure": ("username", "reason"),
    "adminUserLoginSuccess": ("username", "sessionId"),
    "adminUserLogout": (),
    "imageDownloaded": ("id",),
}


def payload(event_type: str, **fields: Column) -> Column:
    """JSON payload of an event. Types are free text; a known type's keys are checked."""
    known = VOCABULARY.get(event_type)
    if known is not None and set(fields) != set(known):
        raise ValueError(f"{event_type} has the keys {known}")
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])) if fields else F.lit("{}")


def append(log: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Rows to append for new (event_type, payload), with ids after the log's largest, in order of type and scrambled payload.

    The log is only asked for its maximum; for several writers there is eventlog.EventLog. Equal payloads spread over tasks.
    """
    key = F.md5(F.coalesce("payload", F.lit("")))
    lined = numbered(new.select("event_type", "payload", key.alias("_key")), "event_type", "_key", "payload")
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    return lined.crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("number")).alias("id"), "event_type", "payload", now.alias("created_at"))


def append_to(path: str, log: DataFrame, new: DataFrame, now: Column) -> None:
    append(log, new, now).write.mode("append").parquet(path)


def overlay(images: DataFrame, changes: DataFrame, flag: str, on: str, off: str) -> DataFrame:
    """images with a flag as the last event of each image set it. changes: id (event), image_id, event_type, created_at."""
    last = changes.where(F.col("event_type").isin(on, off)).groupBy("image_id").agg(F.max_by("event_type", F.struct("created_at", "id")).alias("_last"))
    joined = images.join(last, images["id"] == last["image_id"], "left")
    value = F.when(F.col("_last").isNull(), F.col(flag)).otherwise(F.col("_last") == on)
    return joined.select(*[value.alias(c) if c == flag else images[c] for c in images.columns])


def with_deleted(images: DataFrame, changes: DataFrame) -> DataFrame:
    return overlay(images, changes, "deleted", "imageDeleted", "imageUndeleted")


def with_searchable(images: DataFrame, changes: DataFrame) -> DataFrame:
    return overlay(images, changes, "searchable", "setImageSearchable", "setImageNotSearchable")
