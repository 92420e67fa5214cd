"""Filling missing embeddings: in one pass, or as a job that goes on where it was broken off.

A job writes down once which inputs it has to embed, each different input once, dealt to slices by their hash. A slice that
is embedded is written and committed to a journal; a job that starts again, or several at once, leave committed slices alone. Of
two workers that embed one slice at a time, one is committed. Small slices go in waves, each one Spark job and one entry of
the journal: the first has one slice, the next twice as many, up to the inputs of a full slice. So what breaks loses little, and the number of
jobs does not grow with that of the slices.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumen.functions.encoder import Encoder
from velumen.sources.journal import Journal

BATCH = 10
#: Inputs of a slice.
SLICE = 100_000
#: Slices of a wave at most.
WAVE = 4096


def backlog(images: DataFrame, column: str = "embedding", *, seed: int | None = None, limit: int | None = BATCH) -> DataFrame:
    """Images without an embedding, in random order (repeatable with a seed)."""
    order = F.rand() if seed is None else F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    found = images.where(F.col(column).isNull()).withColumn("_o", order).orderBy("_o", "id")
    return (found if limit is None else found.limit(limit)).drop("_o")


def embedded(images: DataFrame, encoder: Encoder, *, text_col: str = "source", column: str = "embedding") -> DataFrame:
    """(id, embedding) for every image without one; the encoder loads once per task."""
    kind = images.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": encoder.embed_batch(batch["t"].fillna("").tolist())})

    return images.where(F.col(column).isNull()).select("id", F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, embedding array<float>")


def reindexed(images: DataFrame, new: DataFrame, column: str = "embedding") -> DataFrame:
    """images with the new vectors (id, embedding) where they have one."""
    fresh = new.select(F.col("id").alias("_id"), F.col("embedding").alias("_new"))
    joined = images.join(fresh, images["id"] == F.col("_id"), "left")
    return joined.select(*[F.coalesce("_new", images[c]).cast(images.schema[c].dataType).alias(c) if c == column else images[c] for c in images.columns])


class Job:
    """Embeds the inputs of images without a vector, slice by slice."""

    def __init__(self, spark: SparkSession, root: str, **options):
        self.spark, self.root = spark, root.rstrip("/")
        self.journal = Journal(spark, self.root, **options)

    def _started(self) -> dict | None:
        return next((e for e in self.journal.entries() if e["kind"] == "start"), None)

    @staticmethod
    def _committed(entries: list[dict]) -> set[int]:
        return {k for e in entries if e["kind"] == "slices" for k in e["slices"]}

    def start(self, images: DataFrame, *, text_col: str = "source", column: str = "embedding", size: int = SLICE) -> dict:
        """Write down the different inputs of images without a vector, unless that was done before."""
        started = self._started()
        if started:
            return started
        todo = images.where(F.col(column).isNull()).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("input")).distinct()
        slices = max(1, -(-todo.count() // size))
        path = f"{self.root}/inputs/{uuid.uuid4().hex}"
        # In the order of slices, so that a wave reads the row groups that can hold its own; a folder for each would be listed again and again.
        todo.withColumn("slice", F.pmod(F.xxhash64("input"), F.lit(slices)).cast("int")).repartitionByRange("slice").sortWithinPartitions("slice").write.parquet(path)
        self.journal.commit(lambda now: None if now else {"kind": "start", "slices": slices, "size": size, "path": path})
        return self._started()

    def run(self, encoder: Encoder, *, most: int | None = None, parallel: int | None = None, seed: int | None = None, told: Callable[[int], None] = lambda slice_: None) -> int:
        """Embed slices that are not committed, in an order by lot, `most` of them at most; how many this call has committed.

        parallel: tasks of a slice. told is called with each slice before it is embedded.
        """
        started = self._started()
        if started is None:
            raise RuntimeError("the job has not been started")
        order = list(range(started["slices"]))
        random.Random(seed).shuffle(order)
        largest = max(1, min(WAVE, SLICE // started["size"]))
        done, waves = 0, 0
        while most is None or done < most:
            gone = self._committed(self.journal.entries())  # another worker may have been faster
            order = [k for k in order if k not in gone]
            wave = order[: min(largest, 1 << waves, len(order) if most is None else most - done)]
            if not wave:
                break
            for k in wave:
                told(k)
            inputs = self.spark.read.schema("input string, slice int").parquet(started["path"]).where(F.col("slice").isin(wave))
            path = f"{self.root}/vectors/{uuid.uuid4().hex}"
            self._embedded(inputs.repartition(parallel) if parallel else inputs, encoder).write.parquet(path)

            def entry(now: list[dict], wave=wave, path=path) -> dict | None:
                left = sorted(set(wave) - self._committed(now))
                return {"kind": "slices", "slices": left, "whole": len(left) == len(wave), "path": path} if left else None

            done += len((self.journal.commit(entry) or {"slices": []})["slices"])
            waves += 1
        return done

    @staticmethod
    def _embedded(inputs: DataFrame, encoder: Encoder) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"input": batch["input"], "embedding": encoder.embed_batch(batch["input"].tolist()), "slice": batch["slice"]})

        return inputs.mapInPandas(run, "input string, embedding array<float>, slice int")

    def progress(self) -> DataFrame:
        """(slice, done) of all slices."""
        started, done = self._started(), self._committed(self.journal.entries())
        n = started["slices"] if started else 0
        return self.spark.createDataFrame([(k, k in done) for k in range(n)], "slice int, done boolean")

    def vectors(self) -> DataFrame:
        """(input, embedding) of the committed slices."""
        kind = "input string, embedding array<float>, slice int"
        waves = [e for e in self.journal.entries() if e["kind"] == "slices"]
        found = self.spark.createDataFrame([], kind)
        if whole := [e["path"] for e in waves if e["whole"]]:
            found = self.spark.read.schema(kind).parquet(*whole)
        for e in waves:
            if not e["whole"]:  # others committed some of its slices
                found = found.unionByName(self.spark.read.schema(kind).parquet(e["path"]).where(F.col("slice").isin(e["slices"])))
        return found.drop("slice")

    def filled(self, images: DataFrame, *, text_col: str = "source", column: str = "embedding") -> DataFrame:
        """images with the vectors there are so far where they had none; equal inputs have equal ones."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        fresh = self.vectors().select(F.col("input").alias("_input"), F.col("embedding").alias("_new"))
        joined = images.join(fresh, images[column].isNull() & (text == F.col("_input")), "left")
        return joined.select(*[F.coalesce(images[c], F.col("_new").cast(images.schema[c].dataType)).alias(c) if c == column else images[c] for c in images.columns])
