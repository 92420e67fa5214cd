"""Lines that many documents share, found by two Bloom filters.

A line's key is the line without space at its ends and in lower case (A-Z). Lines are hashed where they are read. Each
task keeps the bits of keys it has seen once and of keys it has seen in several documents; where the tasks' bits of one
stretch of the filter meet, a bit that two tasks have set once is set in the twice-seen filter. A key whose bits are all
in the twice-seen filter is suspected. Only suspected keys are shuffled, as 128-bit digests, to be counted exactly; a
filter that is too small for its input makes more keys suspected and changes no result.

Keys of enough documents are doomed: all their lines go, or (keep="first") all but the first, which stands in the document
of least id (then digest) that has the key. Doomed keys of more than a thousandth of the documents are at most a thousand
times the keys of a mean document, and are sent to all tasks; the others meet their documents by a shuffle in which none is hot.

Defined results: null text is empty text, which is one empty line; a null id is an id of its own, after all others; rows alike in
id and text are documents of their own when documents are counted, and each of them keeps a first line that one of them
keeps; an empty key is shorter than any least length of 1 or more and then stays; an empty table gives no rows; further columns, whatever
their names, stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumen.llm import textcore as tc
from velumen.llm.scratch import Scratch

#: Bits of the filters for each line, and the most there are (128 MB, which all tasks hold).
BITS_PER_LINE, MOST_BITS = 16, 1 << 30
#: Bits of a stretch of the filters; all probes of a key lie in one.
STRETCH = 1 << 22
PROBES = 2
#: Lines of a task after which it hands on its bits.
FLUSH = 1 << 20
#: A key of more than one in so many documents is hot.
HOT = 1000


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines' keys in a block, and each line's row."""
    nl = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], nl + 1]), kind="stable")
    ends = np.sort(np.concatenate([nl, off[1:]]), kind="stable")
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(nl, off)) + 1)
    ink = np.flatnonzero(~tc.SPACE[data])
    if not len(ink):
        return starts, starts, row
    first, last = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    full = last > first
    begin = np.where(full, ink[np.minimum(first, len(ink) - 1)], starts)
    return begin, np.where(full, ink[last - 1] + 1, begin), row


def _points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points between starts and ends."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return before[ends] - before[starts]


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes, each hash once a row."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The stretch of each hash, and its places in it."""
    width = min(bits, STRETCH)
    stretch = (h >> tc.U(32)) % tc.U(bits // width)
    return stretch.astype(np.int64), [(h if i == 0 else tc.mix(h + tc.U(i))).astype(np.uint32) % np.uint32(width) for i in range(PROBES)]


def _packed(places: np.ndarray, width: int) -> bytes:
    """Places as a list or as bits, whichever is shorter."""
    places = np.unique(places)
    if 4 * len(places) < width // 8:
        return b"l" + places.astype("<u4").tobytes()
    bits = np.zeros(width, dtype=bool)
    bits[places] = True
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def _bits(packed: bytes, width: int) -> np.ndarray:
    if packed[:1] == b"b":
        return np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little").view(bool)
    out = np.zeros(width, dtype=bool)
    out[np.frombuffer(packed, "<u4", offset=1)] = True
    return out


class Seen:
    """The twice-seen filter, whole: every key that two documents have is in it."""

    def __init__(self, stretches: dict[int, bytes], bits: int):
        self.bits, self.width, self.packed = bits, min(bits, STRETCH), stretches
        self.table: dict[int, np.ndarray] = {}

    def __contains__(self, h) -> bool:
        return bool(self.test(np.array([h], dtype=np.uint64))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        stretch, places = _probes(h, self.bits)
        out = np.zeros(len(h), dtype=bool)
        order = np.argsort(stretch, kind="stable")
        cuts = np.flatnonzero(np.diff(stretch[order])) + 1
        for part in np.split(order, cuts):
            if not len(part) or int(stretch[part[0]]) not in self.packed:
                continue
            s = int(stretch[part[0]])
            if s not in self.table:
                # Eight bits to a byte, as in the packed form.
                self.table[s] = np.packbits(_bits(self.packed[s], self.width), bitorder="little")
            t = self.table[s]
            out[part] = np.logical_and.reduce([(t[p[part] >> np.uint32(3)] >> (p[part] & np.uint32(7)).astype(np.uint8)) & 1 for p in places])
        return out


def seen_twice(text: DataFrame, bits: int, min_points: int) -> Seen:
    """The filter of keys that several rows of text (one column) have."""
    spark: SparkSession = text.sparkSession
    width = min(bits, STRETCH)
    schema = pa.schema([("stretch", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            stretch, places = _probes(u, bits)
            order = np.argsort(stretch, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(stretch[order])) + 1):
                again = part[c[part] > 1]
                once, twice = (np.concatenate([p[k] for p in places]) for k in (part, again))
                yield pa.RecordBatch.from_pydict({"stretch": [int(stretch[part[0]])], "once": [_packed(once, width)], "twice": [_packed(twice, width)]}, schema=schema)

        for batch in batches:
            for _, _, data, off in tc.blocks(batch.column(0)):
                low = tc.LOWER[data]
                starts, ends, row = line_spans(low, off)
                use = _points(low, starts, ends) >= min_points
                h = _distinct(row[use], tc.word_hashes(low, starts[use], ends[use]))[1]
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_pydict({"stretch": [at], "twice": [_packed(np.flatnonzero(twice), width)]}, schema=pa.schema([("stretch", pa.int32()), ("twice", pa.binary())]))
        for batch in batches:
            for s, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != at:
                    if at is not None and twice.any():
                        yield done()
                    at, once, twice = s, np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)
                new = _bits(one, width)
                twice |= once & new
                once |= new
                twice |= _bits(two, width)
        if at is not None and twice.any():
            yield done()

    parts = text.mapInArrow(local, "stretch int, once binary, twice binary")
    merged = parts.repartition("stretch").sortWithinPartitions("stretch").mapInArrow(merge, "stretch int, twice binary")
    # Bounded: MOST_BITS bits at most.
    return Seen({r.stretch: bytes(r.twice) for r in merged.collect()}, bits)


def _place(id_col: str, text_col: str):
    """What tells documents apart, but for rows alike in id and text."""
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))
    return F.unhex(F.sha2(F.concat(name, F.lit("\n"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256))


def doomed_lines(docs: DataFrame, *, min_docs: int = 2, min_points: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS, hot: int = HOT) -> DataFrame:
    """(place, lines): the numbers of the lines to drop from each document that has any; written to the shared folder."""
    if min_docs < 2 or min_points < 0 or keep not in ("none", "first") or most_bits < STRETCH:
        raise ValueError("min_docs is 2 or more, min_points 0 or more, keep 'none' or 'first', and the filter holds a stretch")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lines")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(text, F.lit("")).alias("text"), F.col(id_col).alias("id"), _place(id_col, text_col).alias("place"))
    n_docs, n_lines = rows.agg(F.count("*"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()
    bits = STRETCH
    while bits < min(BITS_PER_LINE * (n_lines or 0), most_bits):
        bits *= 2
    filter_ = spark.sparkContext.broadcast(seen_twice(rows.select("text"), bits, min_points))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ids = batch.column(1), batch.column(2)
            for at, _, data, off in tc.blocks(batch.column(0)):
                low = tc.LOWER[data]
                starts, ends, row = line_spans(low, off)
                number = np.arange(len(row)) - np.searchsorted(row, row)
                use = np.flatnonzero(_points(low, starts, ends) >= min_points)
                use = use[filter_.value.test(tc.word_hashes(low, starts[use], ends[use]))]
                if not len(use):
                    continue
                raw = low.tobytes()
                key = [hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[use].tolist(), ends[use].tolist(), strict=True)]
                found: dict[tuple[int, bytes], list[int]] = {}
                for r, k, i in zip(row[use].tolist(), key, number[use].tolist(), strict=True):
                    found.setdefault((r, k), []).append(i)
                where = pa.array([at + r for r, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array([k for _, k in found], pa.binary()), places.take(where), ids.take(where), pa.array(list(found.values()), pa.list_(pa.int32()))], names=["key", "place", "id", "lines"])

    kind = rows.schema["id"].dataType.simpleString()
    found = scratch.keep(rows.select("text", "place", "id").mapInArrow(suspects, f"key binary, place binary, id {kind}, lines array<int>"), "suspects")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "place")).alias("first")
    doomed = found.groupBy("key").agg(F.count("*").alias("n"), *([first] if keep == "first" else [])).where(F.col("n") >= min_docs)
    doomed = scratch.keep(doomed, "doomed")
    common = doomed.where(F.col("n") * hot > n_docs)
    # Few by their definition, see above.
    near = found.join(F.broadcast(common), "key")
    rest = found.join(F.broadcast(common.select("key")), "key", "left_anti").join(doomed.where(F.col("n") * hot <= n_docs), "key")
    marks = near.unionByName(rest)
    if keep == "first":
        marks = marks.withColumn("lines", F.when(F.col("place") == F.col("first.place"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines")))
    # Rows alike give equal lists.
    each = marks.groupBy("place", "key").agg(F.first("lines").alias("lines"))
    each = each.groupBy("place").agg(F.flatten(F.collect_list("lines")).alias("lines")).where(F.size("lines") > 0)
    return scratch.keep(each, "marks")


def _kept(text: str, lines: list[int] | None) -> tuple[str, int, int]:
    """What is left of a text, its lines, and how many went."""
    if not lines:
        return text, text.count("\n") + 1, 0
    gone, parts = set(lines), text.split("\n")
    return "\n".join(x for i, x in enumerate(parts) if i not in gone), len(parts), len(gone)


def _with_marks(docs: DataFrame, id_col: str, text_col: str, **options) -> tuple[DataFrame, dict[str, str]]:
    """docs under names of our own, with the lines to drop, and the names they had."""
    marks = doomed_lines(docs, id_col=id_col, text_col=text_col, **options)
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(k) for k, c in names.items()], _place(id_col, text_col).alias("_place"))
    return plain.join(marks.select(F.col("place").alias("_place"), "lines"), "_place", "left"), names


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the lines that stay, joined by line ends; columns and rows as they were. Null text stays null."""
    marked, names = _with_marks(docs, id_col, text_col, **options)
    own = next(k for k, c in names.items() if c == text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = list(names).index(own)
        for batch in batches:
            lines = batch.column(len(names)).to_pylist()
            text = [t if t is None else _kept(t, drop)[0] for t, drop in zip(batch.column(at).to_pylist(), lines, strict=True)]
            yield batch.set_column(at, own, pa.array(text, batch.schema.field(at).type)).select(list(names))

    shaped = marked.select(*names, "lines")
    out = shaped.mapInArrow(cut, shaped.drop("lines").schema)
    return out.select(*[F.col(k).alias(c) for k, c in names.items()])


def line_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the lines that stay."""
    marked, names = _with_marks(docs.select(id_col, text_col), id_col, text_col, **options)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_kept(t or "", drop) for t, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n, _ in got], pa.int64()), pa.array([n for _, _, n in got], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _, _ in got], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return marked.select("c0", "c1", "lines").mapInArrow(digest, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")
