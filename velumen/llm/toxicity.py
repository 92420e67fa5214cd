"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are lower-cased runs of letters, hashed. A token's log-odds of toxic against clean labelled text are smoothed
by a Dirichlet prior whose shape is the token's share of all documents, and shrunk by their standard error; a token
takes the score of its most telling unit, itself or one of its beginnings. A drift, the same for all tokens, makes the
expected exponential score of clean text one; that is the equation whose solution is the rate of the extreme-value law of
segment scores, which is therefore one. One linear scan finds the best segment of a text; where it is significant, the linear-time search for
all maximal segments (Ruzzo and Tompa) lists every significant passage. A text's evidence is its passages' scores
above what a text of its length reaches by chance (Karlin and Altschul), made a probability by a logistic fit.

Counts cover all documents and all labelled training rows. Only the fit of the extreme-value constants and of the
logistic curve uses a sample, of about `sample` training rows (a documented bound), each scored by counts that it took no
part in.

Defined results: null and empty text have no passages and get the score of no evidence; documents without label teach
nothing but their words' shares; with labels of one kind only, or none, all scores are the share of label 1; a null id
has no label and is not held out; several labels of one document count as toxic if any is; repeated rows repeat; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velumen.llm import textcore as tc
from velumen.llm.scratch import Scratch

BITS = 18
SIZE = 1 << BITS
SLICES = 64
#: Rows of a block whose segments are searched at once.
ROWS = 512
#: Parts of the training labels; each is scored by the counts of the others to fit the curve.
PARTS = 4


#: Units of a token besides the whole: its first so many letters, where it is longer. Inflected and compound forms share them.
PREFIXES = (5, 6, 7)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each token's units (SIZE where there is none), starts and ends of tokens, and the offsets of each row's."""
    low = tc.LOWER[data]
    starts, ends, rows = tc.spans(low, off, tc.NO_LETTER)
    units = np.full((1 + len(PREFIXES), len(starts)), SIZE, dtype=np.int64)
    units[0] = tc.word_hashes(low, starts, ends) >> tc.U(64 - BITS)
    begins = np.flatnonzero((low & 0xC0) != 0x80)  # of letters
    first, after = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
    for i, k in enumerate(PREFIXES):
        long = np.flatnonzero(after - first > k)
        units[i + 1, long] = tc.mix(tc.word_hashes(low, starts[long], begins[first[long] + k])) >> tc.U(64 - BITS)
    return units, starts, ends, rows


def token_counts(docs: DataFrame, parts: int = 1) -> np.ndarray:
    """Counts by bucket: of toxic and of clean documents, part by part, and of all documents.

    docs: text, label (1, 0 or null: not taught from), and for several parts the part of each labelled document.
    """
    width = 2 * parts + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, SIZE), dtype=np.int64)
        for batch in batches:
            label, part = (batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for i in (1, 2))
            kind = np.where((label < 0) | (part < 0), -1, 2 * part + 1 - label)
            for at, end, data, off in tc.blocks(batch.column(0)):
                units, _, _, rows = tokens(data, off)
                own = np.repeat(kind[at:end], np.diff(rows))
                for k in np.unique(kind[at:end]):
                    if k >= 0:
                        sums[k] += np.bincount(units[:, own == k].ravel(), minlength=SIZE + 1)[:SIZE]
                sums[-1] += np.bincount(units.ravel(), minlength=SIZE + 1)[:SIZE]
        blobs = [zlib.compress(np.ascontiguousarray(s).tobytes(), 1) for s in np.split(sums, SLICES, axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.int64).reshape(width, -1)
                sums[k] = sums[k] + got if k in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["slice", "counts"])

    kind = "slice int, counts binary"
    part = F.col("part") if "part" in docs.columns else F.lit(0)
    sliced = docs.select(F.encode("text", "UTF-8").alias("text"), F.col("label").cast("int").alias("label"), part.cast("int").alias("part")).mapInArrow(count, kind)
    out = np.zeros((width, SLICES, SIZE // SLICES), dtype=np.int64)
    for k, blob in sliced.repartitionById(SLICES, F.col("slice")).mapInArrow(add, kind).collect():  # 64 rows of bounded size
        out[:, k] += np.frombuffer(zlib.decompress(blob), dtype=np.int64).reshape(width, -1)
    return out.reshape(width, SIZE)


def log_odds(counts: np.ndarray, prior: float, errors: float) -> np.ndarray:
    """Shrunk log-odds of each bucket, and 0 for no unit."""
    toxic, clean, every = counts.astype(np.float64)
    share = (every + 1e-9) / (every.sum() + 1e-9 * SIZE)
    a, b = toxic + prior * share, clean + prior * share
    delta = np.log(a / (toxic.sum() + prior - a)) - np.log(b / (clean.sum() + prior - b))
    sigma = np.sqrt(1 / a + 1 / b)
    return np.append(np.sign(delta) * np.maximum(0, np.abs(delta) - errors * sigma), 0.0)


def best_segments(scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Largest segment sum of each row (0 for the empty segment), in one scan of a block."""
    n = len(rows) - 1
    if not len(scores):
        return np.zeros(n)
    length = np.diff(rows)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # One place before each row's first token; each row lies so far below the last that running minima start anew.
    index = np.repeat(np.arange(n), length + 1)
    at = np.arange(len(index)) - index
    fall = np.abs(scores).sum() * 2 + 1
    level = sums[at] - index * fall
    return np.maximum.reduceat(level - np.minimum.accumulate(level), np.concatenate([[0], np.cumsum(length + 1)[:-1]]))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time; between positive scores only sums matter."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    found: list[list] = []  # start, end, sum before it, sum up to its end, last candidate with a smaller sum before it
    for run in np.split(places, cut):
        now = [int(run[0]), int(run[-1]) + 1, float(sums[run[0]]), float(sums[run[-1] + 1]), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            now[4] = j
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3], found[j][4]]
            del found[j:]
    return [(s, e, r - left) for s, e, left, r, _ in found]


@dataclass
class Model:
    scores: np.ndarray
    log_k: float
    rate: float
    curve: np.ndarray  # logistic weights of (1, excess of the best passage, log of all excess)
    share: float  # of label 1; alone if there is nothing to tell labels apart by
    alpha: float  # expected number of passages by chance in a text
    drift: float = 0.0

    def token_scores(self, units: np.ndarray) -> np.ndarray:
        """A token's score is that of its most telling unit, less the drift.

        Scores are whole multiples of 1/65536, so sums are exact and do not depend on what shares a block.
        """
        s = self.scores[units]
        s = s[np.argmax(np.abs(s), axis=0), np.arange(s.shape[1])] - self.drift
        return np.round(s * 65536) / 65536

    def evidence(self, s: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[tuple]]]:
        """Per row: score, number of significant passages, passages (token start, token end, score)."""
        best, length = best_segments(s, rows), np.diff(rows)
        chance = self.log_k + np.log(np.maximum(length, 1))
        excess = excess_score(best, length, self.log_k, self.rate)
        total, lists = np.maximum(excess, 0.0), [[] for _ in best]
        for i in np.flatnonzero(excess > -np.log(self.alpha)):
            lists[i] = [x for x in segments(s[rows[i] : rows[i + 1]]) if self.rate * x[2] - chance[i] > -np.log(self.alpha)]
            total[i] = max(total[i], sum(self.rate * x[2] - chance[i] for x in lists[i]))
        return excess, total, lists

    def probability(self, excess: np.ndarray, total: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(excess, total, length) @ self.curve, -30, 30))) if len(self.curve) else np.full(len(excess), self.share)


def features(excess: np.ndarray, total: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(excess)), np.clip(excess, -20, 20), np.log1p(np.minimum(total, 1e6)), np.log1p(length) / 4], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def known_labels(labels: DataFrame, fold: tuple[int, int]) -> DataFrame:
    """One row per labelled document outside the held-out fold: doc_id, label, and one of PARTS parts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % fold[0] != fold[1]))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    return known.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(PARTS)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, *, fold: tuple[int, int] = (4, 2), sample: int = 8000, prior: float = 20_000.0, errors: float = 2.5, alpha: float = 0.05) -> Model:
    """All training labels count tokens. About `sample` of them fit the constants and the curve, each scored by the counts of the other parts."""
    texts, known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known_labels(labels, fold)
    # Texts meet labels by a shuffle at every size; labels grow with the corpus, so they are not sent around.
    # Rows without id meet no label, and stay where they are.
    labelled = texts.where("doc_id is not null").join(known.hint("merge"), "doc_id", "left").select("text", "label", "part")
    none = F.lit(None).cast("int")
    counts = token_counts(labelled.unionByName(texts.where("doc_id is null").select("text", none.alias("label"), none.alias("part"))), PARTS)
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    model = Model(np.zeros(SIZE + 1), 0.0, 1.0, np.zeros(0), ones / n if n else 0.0, alpha)
    taught = np.stack([counts[0:-1:2].sum(axis=0), counts[1:-1:2].sum(axis=0), counts[-1]])
    if not taught[0].sum() or not taught[1].sum():
        return model
    scored = Model(log_odds(taught, prior, errors), 0.0, 1.0, np.zeros(0), model.share, alpha)
    others = [Model(log_odds(taught - np.stack([counts[2 * k], counts[2 * k + 1], 0 * counts[-1]]), prior, errors), 0.0, 1.0, np.zeros(0), model.share, alpha) for k in range(PARTS)]
    # The sample's ids and labels, whose number is bounded, are sent to the texts; ids decide, so reruns agree.
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(min(1.0, sample / n) * 1_000_000 + 1)
    kept = Scratch(docs.sparkSession, "toxicity")
    seen = kept.keep(texts.join(F.broadcast(known.where(chosen)), "doc_id"))

    def unseen() -> DataFrame:
        """What the scan finds in each text by counts that it took no part in."""
        return reduce(DataFrame.unionByName, [measure(seen.where(F.col("part") == k), m, ("label",)) for k, m in enumerate(others)])

    lift, m = unseen().where("label = 0").agg(F.sum("lift"), F.sum("tokens")).first()
    scored.drift = max(1e-3, float(np.log(lift / m))) if m else 1e-3
    for o in others:
        o.drift = scored.drift
    found = unseen().toPandas().sort_values(["label", "tokens", "best", "total"])
    kept.drop(seen)
    y, length, best = found["label"].to_numpy(), found["tokens"].to_numpy(), found["best"].to_numpy()
    if not 0 < y.sum() < len(y):
        return model
    clean = (y == 0) & (length >= 20)
    if clean.sum() >= 20:
        # Moments of the extreme-value law of clean texts: the best score less log(length) has mean (log K + 0.5772) / rate.
        scored.log_k = float(np.mean(best[clean] - np.log(length[clean])) - 0.5772156649)
    excess = excess_score(best, length, scored.log_k, scored.rate)
    # Sums over passages were taken against log K = 0; each passage's part of them moves with it.
    count = found["n_passages"].to_numpy()
    total = np.maximum(np.maximum(excess, 0), np.where(count > 0, found["total"].to_numpy() - scored.log_k * count, 0.0))
    scored.curve = logistic(features(excess, total, length), y)
    return scored


def excess_score(best: np.ndarray, length: np.ndarray, log_k: float, rate: float) -> np.ndarray:
    """Best segment score above what chance gives a text of that length, in nats."""
    chance = log_k + np.log(np.maximum(length, 1))
    return np.where(best > 0, rate * best - chance, np.minimum(0.0, -chance))


MEASURE = "tokens long, lift double, best double, excess double, total double, n_passages int, score double"


def measure(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_as: str | None = None) -> DataFrame:
    """docs' kept columns with what the scan finds. text_as: a name under which the text is given back, after the others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    back = f", {text_as} string" if text_as else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, end, data, off in tc.blocks(batch.column(0), rows=ROWS):
                units, _, _, rows = tokens(data, off)
                s, length = m.token_scores(units), np.diff(rows)
                excess, total, lists = m.evidence(s, rows)
                lift = np.diff(np.concatenate([[0.0], np.cumsum(np.exp(s))])[rows])
                out = [pa.array(length), pa.array(lift), pa.array(best_segments(s, rows)), pa.array(excess), pa.array(total), pa.array([len(x) for x in lists], pa.int32()), pa.array(m.probability(excess, total, length))]
                out += [batch.column(0).slice(at, end - at).cast(pa.string())] if text_as else []
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + i).slice(at, end - at) for i in range(len(keep))), *out], names=[*keep, *(c.split()[0] for c in MEASURE.split(", ")), *([text_as] if text_as else [])])

    return docs.select(F.encode("text", "UTF-8").alias("text"), *keep).mapInArrow(run, ", ".join(x for x in (kinds, MEASURE) if x) + back)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, start and end in bytes of the text, score, expect, passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows_out: list[tuple] = []
            for at, _, data, off in tc.blocks(batch.column(0), rows=ROWS):
                units, starts, ends, rows = tokens(data, off)
                for i, found in enumerate(m.evidence(m.token_scores(units), rows)[2]):
                    for s, e, score in found:
                        a, b = int(starts[rows[i] + s]), int(ends[rows[i] + e - 1])
                        expect = float(np.exp(m.log_k + np.log(rows[i + 1] - rows[i]) - m.rate * score))
                        rows_out.append((batch.column(1)[at + i].as_py(), a - int(off[i]), b - int(off[i]), score, expect, data[a:b].tobytes().decode()))
            columns = list(zip(*rows_out, strict=True)) if rows_out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "end", "score", "expect", "passage"])

    return docs.select(F.encode("text", "UTF-8").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, start long, end long, score double, expect double, passage string")


THRESHOLD = 0.3


def classify(docs: DataFrame, labels: DataFrame, *, fold: tuple[int, int] = (4, 2), **options) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of all documents."""
    model = fit(docs, labels, fold=fold, **options)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold[0] == fold[1], F.lit(False))
    return measure(base, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


def clean_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    model = fit(docs, labels, **options)
    names = {f"k{i}": c for i, c in enumerate(docs.columns)}
    text = next(k for k, c in names.items() if c == "text")
    scored = measure(docs.select("text", *[F.col(c).alias(k) for k, c in names.items() if k != text]), model, tuple(k for k in names if k != text), text)
    return scored.where(F.col("score") < THRESHOLD).select(*[F.col(k).alias(c) for k, c in names.items()])
