"""Catalogue and event statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velumen.functions.shape import percent

TOP_EXTENSIONS = 10


def overall(images: DataFrame) -> DataFrame:
    """One row: total, deleted, searchable; an unknown flag counts for neither."""
    n = lambda c: c.cast("int")
    return images.agg(n(F.count("*")).alias("total"), n(F.count_if("deleted")).alias("deleted"), n(F.count_if("searchable")).alias("searchable"))


def by_extension(images: DataFrame, limit: int = TOP_EXTENSIONS) -> DataFrame:
    return images.where(F.col("extension").isNotNull()).groupBy("extension").agg(F.count("*").cast("int").alias("count")).orderBy(F.desc("count"), "extension").limit(limit)


def percentages(images: DataFrame) -> DataFrame:
    """Deleted and searchable images in percent of all, to one decimal."""
    o = overall(images)
    return o.select(percent(F.col("deleted"), F.col("total")).alias("deleted_percent"), percent(F.col("searchable"), F.col("total")).alias("searchable_percent"))


def analytics(events: DataFrame, now: Column, *, deleted: str = "imageDeleted", undeleted: str = "imageUndeleted") -> DataFrame:
    """One row of event counts; the last seven days begin after now less seven days."""
    n = lambda c: c.cast("int")
    return events.agg(
        n(F.count("*")).alias("total_events"),
        n(F.count_if(F.col("event_type") == deleted)).alias("deleted_events"),
        n(F.count_if(F.col("event_type") == undeleted)).alias("undeleted_events"),
        n(F.count_if(F.col("created_at") > now - F.expr("INTERVAL 7 DAYS"))).alias("recent_events"),
    )


def heartbeat(spark) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))
