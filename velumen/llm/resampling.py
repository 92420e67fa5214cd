"""Importance resampling towards a target distribution of hashed words.

A feature is a run of words (digits, letters and every character beyond ASCII, A-Z lower-cased), a bucket its bytes' CRC-32 modulo the
number of buckets. Documents are read once: each block of them becomes a sparse matrix of documents by buckets in CSR form
(row offsets, bucket ids, counts), written to the shared folder. Column sums of all blocks are the corpus's distribution, those
of the target texts' blocks the target's. A bucket's gain is the log of how much more often the target has it, both smoothed
by one count a bucket; the product of a block with the vector of gains is its documents' weights. A weight and a Gumbel variate
that follows from the document's id make its score; the highest scores are a draw without replacement.

Only the sums by bucket, a vector of bounded length, are gathered. Ranks are running numbers in range partitions plus the counts of the
partitions before, so no task orders more than its share.

Defined results: null text has no features; a null id draws by the empty text and comes after all others among ties; rows without features
weigh 0; repeated rows have equal scores and follow one another; an empty corpus gives no rows, and an empty target makes rare buckets gain; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velumen.llm import textcore as tc
from velumen.llm.scratch import Scratch

BUCKETS, RUNS, SEED = 10_000, 1, "2024"
MIN_WORDS, PERCENT = 20, 10
#: Bytes between words: all but digits, lower-case ASCII letters and those of multi-byte characters.
APART = np.ones(256, dtype=bool)
APART[48:58] = APART[97:123] = APART[128:] = False

_CSR = "ids array<long>, words array<long>, offsets array<int>, buckets binary, counts binary"


def csr_blocks(docs: DataFrame, *, id_col: str | None = "doc_id", text_col: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """Blocks of documents as sparse matrices: ids, words per document, row offsets, bucket ids (uint32) and counts (uint32)."""
    ids = F.lit(None).cast("long") if id_col is None else F.col(id_col).cast("long")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for at, end, data, off in tc.blocks(batch.column(1)):
                low = tc.LOWER[data]
                starts, ends, rows = tc.spans(low, off, APART)
                place = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
                words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(low[~APART[low]])])
                row = np.repeat(np.arange(end - at), np.diff(rows))
                cells, run, last = [], words, row
                for k in range(runs):
                    if k:
                        # A run of one word more, where it stays in its document.
                        run = pc.binary_join_element_wise(run.slice(0, max(0, len(run) - 1)), words.slice(k), pa.scalar(b" ", pa.large_binary()))
                        last = row[: len(run)]
                        inside = row[k : k + len(run)] == last
                    else:
                        inside = np.ones(len(run), dtype=bool)
                    coded = run.dictionary_encode()
                    # Each different feature of a block is hashed once.
                    of = np.array([zlib.crc32(x) % buckets for x in coded.dictionary.to_pylist()], dtype=np.int64)
                    if len(of):
                        cells.append((last * buckets + of[coded.indices.to_numpy(zero_copy_only=False)])[inside])
                cell, n = np.unique(np.concatenate(cells) if cells else np.zeros(0, np.int64), return_counts=True)
                offsets = np.searchsorted(cell, np.arange(end - at + 1) * buckets).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names.slice(at, end - at).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(rows)], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int32())), pa.array([(cell % buckets).astype("<u4").tobytes()]), pa.array([n.astype("<u4").tobytes()])],
                    names=["ids", "words", "offsets", "buckets", "counts"],
                )

    return docs.select(ids.alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(block, _CSR)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts by bucket over all blocks; a vector of bounded length comes to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b, n in zip(batch.column(0), batch.column(1), strict=True):
                # Weights in doubles are exact: a block's counts are far below 2^53.
                total += np.bincount(np.frombuffer(b.as_buffer(), "<u4"), weights=np.frombuffer(n.as_buffer(), "<u4"), minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = blocks.select("buckets", "counts").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in got:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) by bucket, in doubles."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    of = lambda s, t: math.floor(1000 * math.log((float(t + 1) * float(s_all + b)) / (float(s + 1) * float(t_all + b))))
    return np.array([of(s, t) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(id_: int | None, seed: str = SEED) -> int:
    """A Gumbel variate in thousandths that follows from the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(blocks: DataFrame, gain: np.ndarray, *, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, words) by the product of each block with the gains."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, b, n in zip(*batch.columns, strict=True):
                off, n = offsets.values.to_numpy().astype(np.int64), np.frombuffer(n.as_buffer(), "<u4").astype(np.int64)
                cell = gain[np.frombuffer(b.as_buffer(), "<u4")] * n
                upto = lambda x: np.concatenate([[0], np.cumsum(x)])[off]
                weight, features = np.diff(upto(cell)), np.diff(upto(n))
                score = weight + np.array([noise(i, seed) for i in ids.values.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(features), pa.array(weight), pa.array(score), words.values], names=["doc_id", "n_features", "weight", "score", "words"])

    return blocks.mapInArrow(product, "doc_id long, n_features long, weight long, score long, words long")


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, runs: int = RUNS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null where it is not drawn)."""
    if not 0 <= percent <= 100 or buckets < 1 or runs < 1:
        raise ValueError("percent is of 100, buckets and runs are positive")
    scratch = Scratch(docs.sparkSession, "resampling")
    blocks = scratch.keep(csr_blocks(docs, id_col=id_col, text_col=text_col, buckets=buckets, runs=runs), "csr")
    wanted = csr_blocks(target, id_col=None, text_col=target_text_col, buckets=buckets, runs=runs)
    scored = scratch.keep(weighed(blocks, gains(column_sums(blocks, buckets), column_sums(wanted, buckets)), seed=seed), "scores")
    may = scored.where(F.col("words") >= min_words)
    draw = percent * may.count() // 100

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = pa.array(np.arange(n + 1, n + 1 + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), own], names=[*batch.schema.names, "part", "own"])

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    sorted_ = may.drop("words").repartitionByRange(*order).sortWithinPartitions(*order)
    lined = scratch.keep(sorted_.mapInArrow(number, "doc_id long, n_features long, weight long, score long, part int, own long"), "order")
    # One row a partition.
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = lined.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    rank = F.col("before") + F.col("own")
    ranked = lined.join(F.broadcast(counts), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))
    return ranked.unionByName(scored.where(F.col("words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, with the columns of docs; of repeated ids all rows are taken if any is. Rows without id are not drawn."""
    ids = resampled(docs, target, id_col=id_col, **options).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, docs[id_col] == F.col("_drawn"), "left_semi")
