"""A corpus from raw documents to packed sequences: toxicity, near-duplicates, repeats, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads, written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumen.llm import minhash, mixing, packing, repeats, toxicity
from velumen.llm.scratch import Scratch, table


def toxic_segments(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least id stays."""
    return minhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur elsewhere go; every document stays, with what is left of its text."""
    cut = repeats.remove_repeats(docs)
    kept = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cut.select(*kept)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mixture takes them."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_segments),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mix", source_mixture),
    ("packing", packed_sequences),
]

#: Learned scores and the tokenizer are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
