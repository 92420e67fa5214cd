"""Connected components of link tables, without gathering links or nodes anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velumen.llm.scratch import Scratch


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node reachable from each over the given edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        after = after[after]
        if np.array_equal(after, root):
            return nodes, nodes[root]
        root = after


def contracted(edges: DataFrame) -> DataFrame:
    """The same components by fewer edges: each task joins its nodes to the least one it can reach by its own edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, root = _roots(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
            some = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(root[some])], names=["a", "b"])

    return edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def _large(both: DataFrame, least: DataFrame) -> DataFrame:
    """Neighbours above a node move to its least neighbour, or to itself if it is less."""
    return both.join(least.select("a", F.least("low", "a").alias("m")), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it move to the least of them. edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node reachable, for every node with an edge. edges: a, b, whole numbers; nulls link nothing.

    Tasks contract what they hold; then large and small star steps alternate until every node hangs on its least
    one. Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    now = scratch.keep(contracted(edges), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.when(F.col("b") < F.col("a"), F.col("b"))).alias("below")), "least")
        # In a star no node has neighbours on both sides, nor two below it.
        if least.where("low < a and (high > a or below != low)").isEmpty():
            return least.select(F.col("a").alias("node"), F.least("low", "a").alias("component"))
        after = scratch.keep(contracted(_small(_large(both, least))), "edges")
        scratch.drop(now, least)
        now = after
