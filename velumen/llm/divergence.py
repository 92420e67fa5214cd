"""How far sources of one language differ in their words.

Terms are runs of letters (all of A-Z, a-z and every character beyond ASCII), A-Z lower-cased. Each language keeps the terms that
enough of its documents have. Counts per language, source and term are range-partitioned by language and term, so that a
partition holds sorted runs of kept terms; a run of up to CHUNK terms of one language is a chunk. Within a chunk the terms are a sorted array,
a row's term is an id by binary search in it, and counts of a source are one dense vector by bincount. Ids preserve
the order of UTF-8 bytes, so equal values are ordered by them. Shares of two sources meet vector by vector, in blocks of sources,
and sums over chunks are added up. All arithmetic is on integers, exact at any count.

Nothing is gathered: counts are summed before they are shuffled, a chunk's vectors are of bounded length, and of each chunk only the
first terms of a source go on. The report of pairs is, by its definition, one row for every two sources of a language.

Defined results: null text, language and source are empty strings; a source without any kept term has the same share for
every term; a language without kept terms has pairs of value 0 and no terms; repeated rows are documents of their own; an empty
table gives no rows; further columns are ignored, ids are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velumen.llm import textcore as tc
from velumen.llm.scratch import Scratch

#: Terms of a chunk, rows after which it takes no further term, sources of a block.
CHUNK, ROWS, SOURCES = 4096, 1 << 19, 64
SCALE, PRIOR = 1_000_000_000, 5


def _terms(data: np.ndarray, off: np.ndarray, apart: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a block of lower-cased bytes, and each one's row."""
    starts, ends, rows = tc.spans(data, off, apart)
    ink = data[~apart[data]]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(ink)])
    return words, np.repeat(np.arange(len(off) - 1), np.diff(rows))


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term; a null term stands for each group once a block."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
            code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            for at, end, data, off in tc.blocks(batch.column(0)):
                words, row = _terms(tc.LOWER[data], off, tc.NO_LETTER)
                coded = words.dictionary_encode()
                term, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
                here = code[at:end]
                pairs, first = np.unique(row * size + term, return_counts=True)
                own = here[pairs // size] * size + pairs % size
                cell, where = np.unique(own, return_inverse=True)
                n = np.bincount(where, weights=first, minlength=len(cell)).astype(np.int64)
                have = np.bincount(where, minlength=len(cell)).astype(np.int64)
                empty = np.unique(here)
                who = np.concatenate([cell // size, empty])
                names = pa.concat_arrays([coded.dictionary.take(pa.array(cell % size)).cast(pa.string()), pa.nulls(len(empty), pa.string())])
                zero = np.zeros(len(empty), np.int64)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(who // len(sources.dictionary))), sources.dictionary.take(pa.array(who % len(sources.dictionary))), names, pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([have, zero]))], names=["lang", "source", "term", "n", "docs"])

    rows = docs.select(text.alias("text"), lang.alias("lang"), source.alias("source"))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def dense_chunks(kept: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(lang, chunk, source, terms, counts): a dense vector of each source in each chunk it has terms of, and one of the whole language (source null).

    kept: lang, source, term, n. Only the language's row carries the terms.
    """
    rows = kept.repartitionByRange(F.col("lang"), F.col("term")).sortWithinPartitions("lang", "term").select("lang", "term", "source", "n", F.spark_partition_id().alias("part"))
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("source", pa.string()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, 0

        def vectors(t: pa.Table) -> pa.RecordBatch:
            """One chunk: rows of one language, sorted by term."""
            lang = t.column("lang")[0].as_py()
            terms = pc.unique(t.column("term"))  # sorted, as the rows are
            sorted_terms = np.array([x.encode() for x in terms.to_pylist()], dtype=object)
            ids = np.searchsorted(sorted_terms, np.array([x.encode() for x in t.column("term").to_pylist()], dtype=object))
            who = t.column("source").combine_chunks().dictionary_encode()
            n, code = t.column("n").to_numpy(), who.indices.to_numpy()
            high = np.bincount(code * len(terms) + ids, weights=n >> 26, minlength=len(who.dictionary) * len(terms)).astype(np.int64)
            low = np.bincount(code * len(terms) + ids, weights=n & ((1 << 26) - 1), minlength=len(who.dictionary) * len(terms)).astype(np.int64)
            dense = ((high << 26) + low).reshape(len(who.dictionary), len(terms))
            counts = [dense.sum(axis=0), *dense]
            name = f"{t.column('part')[0].as_py()}-{number}"
            return pa.RecordBatch.from_pydict({"lang": [lang] * len(counts), "chunk": [name] * len(counts), "source": [None, *who.dictionary.to_pylist()], "terms": [terms.to_pylist()] + [None] * (len(counts) - 1), "counts": counts}, schema=schema)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            while held.num_rows:
                lang, term = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (held.column("lang"), held.column("term")))
                same = lang.dictionary_encode().indices.to_numpy() if len(lang) else np.zeros(0)
                place = term.dictionary_encode().indices.to_numpy()
                new = np.zeros(len(place), dtype=np.int64)
                new[1:] = (place[1:] != place[:-1]) | (same[1:] != same[:-1])
                # Rows of the first language and of its first terms; they are whole if others follow.
                over = np.flatnonzero((same != same[0]) | (new > 0) & ((np.cumsum(new) >= chunk) | (np.arange(len(new)) >= ROWS)))
                if not len(over):
                    break
                yield vectors(held.slice(0, int(over[0])))
                number += 1
                held = held.slice(int(over[0]))
        if held is not None and held.num_rows:
            yield vectors(held)

    return rows.mapInArrow(run, "lang string, chunk string, source string, terms array<string>, counts array<long>")


def shares(count: np.ndarray, total: np.ndarray | int, size: int, *, prior: int = PRIOR) -> np.ndarray:
    """1 + floor(10^9 (count + prior) / (total + prior * size)), by long division so that no product overflows."""
    over = np.asarray(total, dtype=np.int64) + prior * size
    rest, out = count + prior, np.zeros(np.broadcast(count, over).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // over
        rest = rest % over
    return 1 + out


def divergence(docs: DataFrame, *, min_docs: int = 30, top: int = 50, prior: int = PRIOR, chunk: int = CHUNK, block: int = SOURCES, **columns) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources, and the terms a source has too often."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.keep(term_counts(docs, **columns), "counts")
    have = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    kept = counts.join(have, ["lang", "term"]).select("lang", "source", "term", "n")
    dense = scratch.keep(dense_chunks(kept, chunk=chunk), "dense")

    total = F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")
    per = dense.where("source is not null").groupBy("lang", "source").agg(total)
    groups = counts.where("term is null").select("lang", "source").join(per, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    size = dense.where("source is null").groupBy("lang").agg(F.sum(F.size("terms")).alias("size"), total.alias("lang_total"))
    # Sources are numbered within their language through blocks of their hashes, so that no task has to order them all.
    groups = groups.join(size, "lang", "left").select("lang", "source", "total", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    many = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    blocks = F.ceil(F.col("sources") / block)
    groups = scratch.keep(groups.join(many, "lang").select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).alias("block")), "groups")

    # Every chunk of a language meets every source of it, with or without terms there, in pairs of blocks.
    chunks = dense.where("source is null").select("lang", "chunk", F.size("terms").alias("width"))
    rows = groups.join(chunks, "lang").join(dense.where("source is not null").select("lang", "chunk", "source", "counts"), ["lang", "chunk", "source"], "left")
    paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("lang", "chunk", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "source", "total", "size", "width", "counts")

    def matrix(t: pa.Table) -> np.ndarray:
        width = t.column("width")[0].as_py()
        n = np.zeros((t.num_rows, width), dtype=np.int64)
        vectors = t.column("counts").combine_chunks()
        n[np.asarray(vectors.is_valid())] = vectors.drop_null().flatten().to_numpy().reshape(-1, width)
        return shares(n, t.column("total").to_numpy()[:, None], t.column("size")[0].as_py(), prior=prior)

    def meet(t: pa.Table) -> pa.Table:
        lang, p, q = t.column("lang")[0].as_py(), t.column("p")[0].as_py(), t.column("q")[0].as_py()
        share, block_of, source = matrix(t), t.column("block").to_numpy(), np.array(t.column("source").to_pylist(), dtype=object)
        left, right = np.flatnonzero(block_of == p), np.flatnonzero(block_of == q)
        one, two, far = [], [], []
        for i in left:
            d = np.abs(share[right] - share[i]).sum(axis=1)
            for j, v in zip(right.tolist(), d.tolist(), strict=True):
                if i != j:
                    one.append(source[i])
                    two.append(source[j])
                    far.append(v)
        if p != q:
            one, two, far = one + two, two + one, far + far
        return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": pa.array(one, pa.string()), "item": pa.array(two, pa.string()), "value": pa.array(far, pa.int64())})

    met = paired.groupBy("lang", "chunk", "p", "q").applyInArrow(meet, "lang string, source string, item string, value long")
    # Where a language keeps no term there is no chunk: its pairs are at 0.
    none = groups.where("size = 0").select("lang", "source")
    zero = none.join(none.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = met.unionByName(zero).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    whole = dense.where("source is null").select("lang", "chunk", "terms", F.col("counts").alias("lang_counts"))
    own = dense.where("source is not null").select("lang", "chunk", "source", "counts").join(groups.select("lang", "source", "total", "size", "lang_total"), ["lang", "source"]).join(whole, ["lang", "chunk"])

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for r in range(batch.num_rows):
                lang, source, n, total, size, lang_total, n_lang, terms = (batch.column(c)[r] for c in ("lang", "source", "counts", "total", "size", "lang_total", "lang_counts", "terms"))
                n, n_lang = n.values.to_numpy(), n_lang.values.to_numpy()
                p, q = shares(n, total.as_py(), size.as_py(), prior=prior), shares(n_lang, lang_total.as_py(), size.as_py(), prior=prior)
                more = np.flatnonzero((n > 0) & (p > q))
                # Ids are in the order of the terms' bytes, so a stable sort breaks ties by them.
                more = more[np.argsort(q[more] - p[more], kind="stable")][:top]
                out[0].extend([lang.as_py()] * len(more))
                out[1].extend([source.as_py()] * len(more))
                out[2].extend(terms.values.take(pa.array(more)).to_pylist())
                out[3].extend((p[more] - q[more]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "item", "value"])

    terms = own.select("lang", "source", "counts", "total", "size", "lang_total", "lang_counts", "terms").mapInArrow(telling, "lang string, source string, item string, value long")
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", ranked)
    return shape(pairs, "pair").unionByName(shape(terms, "term").where(F.col("rank") <= top))
