"""Language identification by the nearest of several centroids per language.

Texts are vectors of hashed byte trigrams of their lower-cased letters, weighted log(1 + count) * idf and normalised.
Document frequencies come from all training rows. Each language's centroids are found by spherical k-means on a
sample of `per_lang` different training texts at most (a documented bound; the rest of the operator covers all rows). A text takes
the language of the centroid of largest cosine; beyond the distance that all but `reject_share` of that centroid's own
sample lie within, it is marked rejected.

Defined results: null text, empty text and text without letters are `und` with score 0; with no training rows
everything is `und`; a null id is carried and never held out; repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velumen.llm import textcore as tc

BITS = 13
SIZE = 1 << BITS
#: Rows and bytes whose dense vectors are held at once.
ROWS, BYTES = 256, 1 << 20


def _letters_only() -> np.ndarray:
    fold = tc.LOWER.copy()
    fold[tc.NO_LETTER] = 32
    return fold


_FOLD = _letters_only()


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Trigram counts of each row of a block, one row each."""
    n = len(off) - 1
    a = _FOLD[data].astype(np.uint32)
    if len(a) < 3:
        return np.zeros((n, SIZE), dtype=np.float32)
    g = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))[: len(g)]
    at = row * SIZE + g
    # A trigram over the end of a row, or of blanks alone, counts for none.
    inside = np.ones(len(g), dtype=bool)
    for k in (1, 2):
        cut = off[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(g))]] = False
    inside &= (a[:-2] != 32) | (a[1:-1] != 32)
    return np.bincount(at[inside], minlength=n * SIZE).reshape(n, SIZE).astype(np.float32)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; a row without trigrams stays zero."""
    v = np.log1p(c, out=c)
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(norm > 0, norm, 1)[:, None]


def has_letter(text: pa.Array, first: int, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row holds a letter of any script."""
    ascii_ = np.zeros(len(data) + 1, dtype=np.int64)
    low = tc.LOWER[data]
    np.cumsum((low >= 97) & (low <= 122), out=ascii_[1:])
    found = ascii_[off[1:]] > ascii_[off[:-1]]
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(ch.isalpha() for ch in text[first + int(i)].as_py().decode())
    return found


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each trigram occurs, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE, dtype=np.int64), 0
        for batch in batches:
            for _, _, data, off in tc.blocks(batch.column(0), BYTES, ROWS):
                df += (counts(data, off) > 0).sum(axis=0)
                n += len(off) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), SIZE)), pa.array(np.append(df[df > 0], n))], names=["g", "n"])

    sums = train.select(F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    df = np.zeros(SIZE + 1, dtype=np.int64)
    for g, n in sums.collect():  # one row per trigram at most
        df[g] = n
    return df[:SIZE], int(df[SIZE])


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; unit centroids."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # language of each centroid
    reach: np.ndarray  # smallest accepted cosine of each centroid


def fit(train: DataFrame, *, per_lang: int = 400, clusters: int = 4, reject_share: float = 0.005) -> Model | None:
    """train: text and lang, one row per training document with non-null lang."""
    df, n = document_frequencies(train)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # Of each language, the texts of least hash among about twice as many as are wanted; repeated texts count once.
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    # One number a language; the model holds centroids of every language, so they are few.
    shares = {r.lang: min(1.0, 2 * per_lang / r.n) for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    most = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("lang")) * (1 << 30)
    near = train.withColumn("place", place).where(F.col("place") <= most).dropDuplicates(["lang", "place"])
    least = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("place"))).where(F.col("rank") <= per_lang)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, off in tc.blocks(batch.column(0), BYTES, ROWS):
                c = counts(data, off)
                rows = [np.flatnonzero(r) for r in c]
                got = [pa.array([r.astype("<u2").tobytes() for r in rows]), pa.array([c[i, r].astype("<f4").tobytes() for i, r in enumerate(rows)])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, end - at), *got], names=["lang", "g", "c"])

    sample = least.select(F.encode("text", "UTF-8").alias("text"), "lang").mapInArrow(sparse, "lang string, g binary, c binary")
    by: dict[str, list] = {}
    for r in sample.collect():  # per_lang rows of a language at most
        by.setdefault(r.lang, []).append((np.frombuffer(r.g, "<u2"), np.frombuffer(r.c, "<f4")))
    langs, cs, owner, reach = sorted(by), [], [], []
    for k, lang in enumerate(langs):
        x = np.zeros((len(by[lang]), SIZE), dtype=np.float32)
        for i, (g, v) in enumerate(sorted(by[lang], key=lambda t: (len(t[0]), t[0].tobytes(), t[1].tobytes()))):
            x[i, g] = v
        x = vectors(x, idf)
        x = x[np.einsum("ij,ij->i", x, x) > 0]
        if not len(x):
            continue
        c = kmeans(x, clusters)
        cos = x @ c.T
        own = np.argmax(cos, axis=1)
        for i in range(len(c)):
            mine = cos[own == i, i]
            cs.append(c[i])
            owner.append(k)
            reach.append(float(np.quantile(mine, reject_share)) if len(mine) else 1.0)
    return Model(langs, idf, np.stack(cs), np.array(owner), np.array(reach)) if cs else None


def predict(docs: DataFrame, model: Model | None, *, keep: tuple[str, ...] = ("doc_id",), temperature: float = 0.05) -> DataFrame:
    """docs' kept columns with lang_pred, score (0 to 1), distance (1 - cosine) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = batch.column(0)
            for at, end, data, off in tc.blocks(text, BYTES, ROWS):
                n = end - at
                if m is None:
                    pred, score, far, rejected = ["und"] * n, np.zeros(n), np.ones(n), np.ones(n, dtype=bool)
                else:
                    cos = vectors(counts(data, off), m.idf) @ m.centroids.T
                    best = np.full((n, len(m.langs)), -1.0)
                    for k in range(len(m.langs)):
                        if (m.owner == k).any():
                            best[:, k] = cos[:, m.owner == k].max(axis=1)
                    some, near = has_letter(text, at, data, off), np.argmax(cos, axis=1)
                    odds = np.exp((best - best.max(axis=1, keepdims=True)) / temperature)
                    top = best.argmax(axis=1)
                    score = np.where(some, (odds / odds.sum(axis=1, keepdims=True))[np.arange(n), top], 0.0)
                    pred = [m.langs[k] if s else "und" for k, s in zip(top, some, strict=True)]
                    far = 1.0 - cos[np.arange(n), near]
                    rejected = ~some | (cos[np.arange(n), near] < m.reach[near])
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + i).slice(at, n) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "distance", "rejected"])

    return docs.select(F.encode("text", "UTF-8").alias("text"), *keep).mapInArrow(run, f"{kinds}, lang_pred string, score double, distance double, rejected boolean")


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1):
    """Whether a document's fold is the held-out one; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the documents outside the held-out fold, and predict all."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out())
    model = fit(base.where(~F.col("held_out") & F.col("lang").isNotNull()).select("text", "lang"), **options)
    return predict(base.select("doc_id", "text", "held_out"), model, keep=("doc_id", "held_out"))
