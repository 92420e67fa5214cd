"""Near-duplicate documents by b-bit MinHash, with links confirmed on full shingle sets.

A document's set is its distinct word shingles. Documents with equal sets (128 bits of the set decide) are one class, and
each class goes on once. Of 128 minima per set, four at a time make 32 band keys, and eight low bits of each are packed
into a signature. Sets that share a band key are candidates; the share of equal low bits, corrected for chance, estimates
their similarity, and pairs more than five standard errors below the threshold go. The rest are compared set by set; the
sets of all candidates are made in one pass, by one shuffle of the texts at every size of input.

Groups are resolved without listing their pairs. First every member of a band bucket meets the bucket's least member
(a star). Confirmed links make components; a bucket within one component is done. In the other buckets only members of
different components are compared, block by block, by their packed signatures, and what comes of it is which document
may join which larger component. Where a bucket holds many components, as documents of one template do that are alike but not enough,
members are compared only if they share one of their rarest shingles, which sets of the similarity wanted always do (the
prefix filter of set joins): what a template's documents have in common is not rare among them. The full set of a document that asks
then meets the sets of all members of the component, block by block, through an index of shingles; blocks are bounded by
rows and by bytes. A miss needs two sets of similarity 0.75 or more that share none of 32 bands: five in a million at the
threshold itself.

Defined results: documents without words or with null text have no links of their own, a null id has none; fewer words
than a shingle make the whole sequence one shingle; rows with one id are one node, whatever their texts, so they share a
component and join those of their texts; repeated rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velumen.llm import textcore as tc
from velumen.llm.graph import components
from velumen.llm.scratch import Scratch, partitions

SHINGLE = 5
PERCENT = 75
BANDS, PER_BAND = 32, 4
MINIMA = BANDS * PER_BAND
LOW_BITS = 8
WORDS = MINIMA * LOW_BITS // 64
#: Estimates below this are five standard errors under the threshold.
LEAST = 0.56
#: Members of a bucket that are compared at once.
BLOCK = 512
#: Components of a bucket whose members are compared by signature alone; counters of the order of shingles.
FEW, CELLS = 16, 1 << 20
#: Documents, and bytes of their sets, of one side of a block in which full sets meet.
MEET_ROWS, MEET_BYTES = 128, 4 << 20

_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64) | tc.U(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each row of a block, end to end, and their offsets."""
    low = tc.LOWER[data]
    starts, ends, rows = tc.spans(low, off)
    h = tc.word_hashes(low, starts, ends)
    g = tc.grams(h, k)
    out, size = [], np.zeros(len(off), dtype=np.int64)
    for i in range(len(off) - 1):
        a, b = rows[i], rows[i + 1]
        if b - a >= k:
            s = np.unique(g[a : b - k + 1])
        elif b > a:
            s = tc.grams(h[a:b], int(b - a))
        else:
            continue
        out.append(s)
        size[i + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.cumsum(size)


def fingerprints(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two independent fingerprints of each nonempty row's whole set."""
    some = np.flatnonzero(np.diff(off))
    out, size = np.empty((2, len(some)), dtype=np.uint64), np.diff(off)[some].astype(np.uint64)
    for i in range(2):
        sets = tc.mix(sets + tc.U(0x9E3779B97F4A7C15))
        out[i] = tc.mix(np.add.reduceat(sets, off[:-1][some]) + size) if len(some) else 0
    return out.view(np.int64)


def signatures(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per nonempty row: band keys and packed low bits."""
    some = np.flatnonzero(np.diff(off))
    at = off[:-1][some]
    minima = np.empty((len(some), MINIMA), dtype=np.uint64)
    hold = np.empty_like(sets)
    for i in range(MINIMA):
        np.bitwise_xor(sets, _FLIP[i], out=hold)
        np.multiply(hold, _TIMES[i], out=hold)
        minima[:, i] = np.minimum.reduceat(hold, at)
    keys = np.zeros((len(some), BANDS), dtype=np.uint64)
    for k in range(PER_BAND):
        keys = tc.mix(keys + minima[:, k::PER_BAND] + np.arange(1, BANDS + 1, dtype=np.uint64))
    low = (minima & tc.U((1 << LOW_BITS) - 1)).reshape(len(some), -1, 64 // LOW_BITS)
    packed = np.bitwise_or.reduce(low << (np.arange(64 // LOW_BITS, dtype=np.uint64) * tc.U(LOW_BITS)), axis=2)
    return keys, packed


_SIGNED = "doc_id long, n long, w long, x long, keys array<long>, low array<long>"


def sign(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n (set size), w and x (fingerprints of the set), keys, low; the last four null for empty sets."""

    def lists(a: np.ndarray, some: np.ndarray, n: int) -> pa.Array:
        off = np.zeros(n + 1, dtype=np.int32)
        off[some + 1] = a.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.cumsum(off, dtype=np.int32)), pa.array(a.astype(np.int64).ravel() if a.dtype != np.uint64 else a.view(np.int64).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, off in tc.blocks(batch.column(1)):
                sets, rows = shingle_sets(data, off, k)
                n, size = end - at, np.diff(rows)
                some = np.flatnonzero(size)
                whole = np.zeros((2, n), dtype=np.int64)
                if len(some):
                    whole[:, some] = fingerprints(sets, rows)
                    keys, low = signatures(sets, rows)
                else:
                    keys, low = np.zeros((0, BANDS), np.uint64), np.zeros((0, WORDS), np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(size), *(pa.array(x, mask=size == 0) for x in whole), lists(np.ascontiguousarray(keys), some, n), lists(np.ascontiguousarray(low), some, n)], names=["doc_id", "n", "w", "x", "keys", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(run, _SIGNED)


#: Shifts that gather a lane's bits in its lowest one, and those lowest bits.
_STEPS = (4, 2, 1)
_LOWEST = 0x0101010101010101


def differing(d: np.ndarray) -> np.ndarray:
    """How many lanes of each row of exclusive-or words differ."""
    for step in _STEPS:
        d = d | d >> tc.U(step)
    return np.bitwise_count(d & tc.U(_LOWEST)).sum(axis=1, dtype=np.int64)


def _estimate(a: str, b: str) -> Column:
    """Similarity by equal low bits, corrected for chance."""
    differ = F.lit(0)
    for i in range(WORDS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for step in _STEPS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_LOWEST)))
    chance = 0.5**LOW_BITS
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def full_sets(wanted: DataFrame, docs: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(id, w, s): the whole shingle sets of the classes named by wanted (id, w), written once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of this task's documents; repeated rows give one set
        for batch in batches:
            for at, end, data, off in tc.blocks(batch.column(1)):
                values, rows = shingle_sets(data, off, k)
                some, ids = np.flatnonzero(np.diff(rows)), batch.column(0).slice(at, end - at).to_numpy()
                out = []
                for i, w in zip(some, fingerprints(values, rows)[0].tolist(), strict=True):
                    key = int(ids[i]), w
                    if key not in seen:
                        seen.add(key)
                        out.append((*key, values[rows[i] : rows[i + 1]].tobytes()))
                columns = zip(*out, strict=True) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "w", "s"])

    ids = wanted.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.join(ids.hint("merge"), "doc_id", "left_semi")
    return scratch.keep(texts.select("doc_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(sets, "id long, w long, s binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b): ids of the pairs (a, aw, b, bw) of classes whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.toDF("a", "aw", "sa"), ["a", "aw"]).join(sets.toDF("b", "bw", "sb"), ["b", "bw"])
    return scratch.keep(joined.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long"), "links")


def joining(asked: DataFrame, label: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Of (id, w, b), a class and a component it is not in, the (a, b) whose full set is similar enough to a member's.

    Members and documents meet in blocks; a block's sets are indexed by shingle, so that one document is compared with
    all of them at once, and no pairs are listed.
    """
    sized = sets.select("id", "w", F.length("s").alias("bytes"))
    labelled = sized.join(label.select(F.col("node").alias("id"), F.col("component").alias("b")), "id", "left").withColumn("b", F.coalesce("b", "id"))
    members = scratch.keep(labelled.join(asked.select("b").distinct(), "b", "left_semi").select("b", "id", "w", "bytes"), "of")
    asking = scratch.keep(asked.join(sized, ["id", "w"]).select("b", "id", "w", "bytes"), "asking")
    parts = lambda name: F.ceil(F.greatest(F.count("*") / MEET_ROWS, F.sum("bytes") / MEET_BYTES)).alias(name)
    sizes = scratch.keep(members.groupBy("b").agg(parts("nm")).join(asking.groupBy("b").agg(parts("nx")), "b"), "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id", "w"), F.col(n))
    left = members.join(sizes, "b").select("b", mine("nm").alias("p"), every("nx").alias("q"), "id", "w", F.lit(False).alias("asks"))
    right = asking.join(sizes, "b").select("b", mine("nx").alias("q"), every("nm").alias("p"), "id", "w", F.lit(True).alias("asks"))
    rows = left.unionByName(right).join(sets, ["id", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tc.grouped(batches, ["b", "p", "q"]):
            asks, ids = t.column("asks").to_numpy(), t.column("id").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s").combine_chunks()]
            own = [sets[i] for i in np.flatnonzero(~asks)]
            size = np.array([len(x) for x in own], dtype=np.int64)
            if not len(size):
                continue
            values, who = np.concatenate(own), np.repeat(np.arange(len(own)), size)
            order = np.argsort(values, kind="stable")
            values, who = values[order], who[order]
            hits = []
            for i in np.flatnonzero(asks):
                low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(who[at], minlength=len(own))
                if ((both > 0) & (100 * both >= percent * (size + len(sets[i]) - both))).any():
                    hits.append(ids[i])
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64()), pa.array([t.column("b")[0].as_py()] * len(hits), pa.int64())], names=["a", "b"])

    out = scratch.keep(rows.repartition(partitions(scratch.spark), "b", "p", "q").sortWithinPartitions("b", "p", "q").select("b", "p", "q", "id", "asks", "s").mapInArrow(run, "a long, b long"), "links")
    scratch.drop(members, asking)
    return out


def rare_first(sets: DataFrame) -> np.ndarray:
    """How many of the sets have a shingle, by the first bits of its fingerprint: the order in which shingles are told apart.

    sets: s. A table of fixed size; shingles that share a counter are in the order of their fingerprints.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                n += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) >> tc.U(64 - CELLS.bit_length() + 1)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    out = np.zeros(CELLS, dtype=np.int64)
    rows = sets.select("s").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out[rows["cell"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, w, leads): the rarest shingles of each set, of which two sets that are similar enough share one.

    In one order of all shingles, rare ones first, the smaller of two such sets has one of those that lead it (a seventh of it, at
    three quarters) in common with the first quarter of the larger one, for else what they can share is too little.
    """
    order = sets.sparkSession.sparkContext.broadcast(rare_first(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = tc.U(64 - CELLS.bit_length() + 1)
        for batch in batches:
            keys, at, leads = [], [], []
            for i, x in enumerate(batch.column(2)):
                v = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(v)
                probe, lead = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                first = v[np.lexsort((v, order.value[(v >> shift).astype(np.int64)]))[:probe]]
                keys.append(first)
                at.append(np.full(len(first), i))
                leads.append(np.arange(len(first)) < lead)
            if keys:
                rows = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(leads))], names=["key", "id", "w", "leads"])

    return sets.select("id", "w", "s").mapInArrow(run, "key long, id long, w long, leads boolean")


def _asks(rows: pa.Table, left: np.ndarray, right: np.ndarray, ordered: bool, percent: int) -> np.ndarray:
    """(id, w, b) of the pairs of a left and a right row, of different components, whose estimate allows a link.

    ordered: only pairs whose left row has the smaller set. The member of the smaller component asks the larger one; of equals, the later one asks.
    """
    label, size, ids, w, n = (rows.column(c).to_numpy() for c in ("label", "size", "id", "w", "n"))
    low = rows.column("low").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1)
    out, chance = [], 0.5**LOW_BITS
    for i in range(0, len(left), 64):
        some = left[i : i + 64]
        a, b = n[some][:, None], n[right]
        ok = (label[some][:, None] != label[right]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        if ordered:
            later = (ids[some][:, None] < ids[right]) | ((ids[some][:, None] == ids[right]) & (w[some][:, None] < w[right]))
            ok &= (a < b) | ((a == b) & later)
        x, y = np.nonzero(ok)
        x, y = some[x], right[y]
        fine = ((1 - differing(low[x] ^ low[y]) / MINIMA) - chance) / (1 - chance) >= LEAST
        x, y = x[fine], y[fine]
        asks = (size[x] < size[y]) | ((size[x] == size[y]) & (label[x] > label[y]))
        out.append(np.unique(np.stack([np.where(asks, ids[x], ids[y]), np.where(asks, w[x], w[y]), np.where(asks, label[y], label[x])]), axis=1))
    return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), dtype=np.int64)


def _met(rows: DataFrame, scratch: Scratch, ordered: bool, percent: int) -> DataFrame:
    """(id, w, b) of all (key, p, q): rows of side 0 meet rows of side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tc.grouped(batches, ["key", "p", "q"]):
            side = t.column("side").to_numpy()
            found = _asks(t, np.flatnonzero(side != 1), np.flatnonzero(side != 0), ordered, percent)
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "w", "b"])

    return rows.repartition(partitions(scratch.spark), "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "id long, w long, b long")


def _mixed(shared: DataFrame, label: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(id, w, b): a member of a bucket and a larger component in it with a member whose estimate allows a link.

    shared: key, id, w, n, low. Members of one component are not compared, and a component is named once per member. In a bucket of many
    components, as documents made from one template give, members are compared only where they share a rare shingle.
    """
    sized = label.groupBy("component").agg(F.count("*").alias("size"))
    named = shared.join(label.select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = scratch.keep(named.join(sized.withColumnRenamed("component", "label"), "label", "left").withColumn("size", F.coalesce("size", F.lit(1)).cast("long")), "named")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("m"))
    mixed = scratch.keep(sizes.groupBy("key").agg(F.count("*").alias("labels"), F.sum("m").alias("rows"), F.max(F.struct("m", "label")).alias("top")).where("labels > 1"), "mixed")

    few = mixed.where(F.col("labels") <= FEW).select("key", F.col("top.label").alias("top"), F.ceil((F.col("rows") - F.col("top.m")) / BLOCK).alias("others"), F.ceil(F.col("top.m") / BLOCK).alias("tops"))
    rows = named.join(few, "key").withColumn("is_top", F.col("label") == F.col("top"))
    # Blocks 0.. of the others and, after them, of the largest component; all pairs of blocks but those of that component.
    block = F.when(F.col("is_top"), F.col("others") + F.pmod(F.xxhash64("id", "w"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("id", "w"), F.col("others")))
    rows = rows.withColumn("block", block.cast("long"))
    meet = F.when(F.col("is_top"), F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("others") + F.col("tops") - 1))
    rows = rows.withColumn("other", F.explode(meet)).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    side = F.when(F.col("p") == F.col("q"), 2).when(F.col("block") == F.col("p"), 0).otherwise(1).alias("side")
    found = _met(rows.select("key", "p", "q", side, "id", "w", "label", "size", "n", "low"), scratch, False, percent)

    many = named.join(mixed.where(F.col("labels") > FEW).select("key"), "key", "left_semi").dropDuplicates(["id", "w"]).drop("key")
    many = scratch.keep(many, "many")
    if not many.isEmpty():
        found = found.unionByName(_sharing(many, sets, scratch, percent))
    out = scratch.keep(found.distinct(), "asked")
    scratch.drop(named, mixed, many)
    return out


def _sharing(many: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """What members of `many` (id, w, label, size, n, low) may join, of those with which they share a rare shingle."""
    rare = scratch.keep(rare_shingles(sets.join(many.select("id", "w"), ["id", "w"], "left_semi"), percent).join(many.select("id", "w", "label"), ["id", "w"]), "rare")
    # Shingles of one component, or that lead no set, tell nothing.
    keys = rare.groupBy("key").agg(F.count("*").alias("m"), F.count_if("leads").alias("leading"), F.min("label").alias("u"), F.max("label").alias("v")).where("leading > 0 and u != v")
    keys = keys.select("key", F.ceil(F.col("leading") / BLOCK).alias("np"), F.ceil(F.col("m") / BLOCK).alias("nq"))
    rows = rare.drop("label").join(keys, "key").join(many, ["id", "w"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id", "w"), F.col(n))
    columns = ["id", "w", "label", "size", "n", "low"]
    left = rows.where("leads").select("key", mine("np").alias("p"), every("nq").alias("q"), F.lit(0).alias("side"), *columns)
    right = rows.select("key", every("np").alias("p"), mine("nq").alias("q"), F.lit(1).alias("side"), *columns)
    return _met(left.unionByName(right), scratch, True, percent)


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    if percent < PERCENT:
        raise ValueError(f"bands and estimates are made for {PERCENT} percent and more")
    scratch = Scratch(docs.sparkSession, "minhash")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.keep(sign(base, shingle), "signed")
    nodes = signed.where("n > 0 and doc_id is not null")
    classes = scratch.keep(nodes.groupBy("w", "x").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("low").alias("low")), "classes")
    rows = classes.select("id", "w", F.explode("keys").alias("key"))
    hubs = rows.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("id", "w")).alias("hub")).where("m > 1").select("key", "hub")
    shared = scratch.keep(rows.join(hubs, "key"), "shared")
    sets = full_sets(shared, base, scratch, shingle)
    sig = classes.select("id", "w", "n", "low")
    pairs = shared.select(F.col("id").alias("a"), F.col("w").alias("aw"), F.col("hub.id").alias("b"), F.col("hub.w").alias("bw")).where("a != b").distinct()
    pairs = pairs.join(sig.toDF("a", "aw", "na", "la"), ["a", "aw"]).join(sig.toDF("b", "bw", "nb", "lb"), ["b", "bw"])
    pairs = pairs.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_estimate("la", "lb") >= LEAST)).select("a", "aw", "b", "bw")
    owner = classes.select("w", "x", F.col("id").alias("node"))
    # An id with several texts joins the classes of all of them.
    several = signed.groupBy("doc_id").agg(F.min(F.coalesce("w", F.lit(0))).alias("u"), F.max(F.coalesce("w", F.lit(0))).alias("v")).where("u != v and doc_id is not null").select("doc_id")
    own = nodes.join(several, "doc_id", "left_semi").select("doc_id", "w", "x").join(owner, ["w", "x"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(scratch.keep(pairs, "pairs"), sets, scratch, percent).unionByName(own)
    label = components(links, scratch)
    more = _mixed(shared.select("key", "id", "w").join(sig, ["id", "w"]), label, sets, scratch, percent)
    if not more.isEmpty():
        links = joining(more, label, sets, scratch, percent)
        label = components(links.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)
    owner = owner.join(label, "node", "left").select("w", "x", F.coalesce("component", "node").alias("component_id"))
    slim = signed.select("doc_id", "n", "w", "x")
    of_sets = slim.where("n > 0 and doc_id is not null").join(owner, ["w", "x"]).select("doc_id", "n", "component_id")
    unnamed = slim.where("doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    others = slim.where("n = 0 and doc_id is not null").join(label.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return of_sets.unionByName(others).unionByName(unnamed).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents of each group but its least id, with their columns.

    All rows of that id stay, repeated or not, for rows of one id are one document; rows without id stay.
    """
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
