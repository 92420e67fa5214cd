"""Embedding near-duplicates by robust-pruned flat graphs.

Equal vectors are one class, which goes on once with its size. Classes are dealt to regions around dispersed pivots, each
to all pivots that are not much farther than its nearest, so that two linked vectors share a region but by rare chance. A
region that is still too large is dealt again, as often as it takes; one that pivots cannot part (a great many nearly
equal vectors) is cut into blocks of which every two make a region.

A region is dealt once more, to small overlapping cluster shards. In each shard near and far candidates of every vector
are pruned robustly (a candidate goes when a kept neighbour is much nearer to it), and the adjacency lists of all shards
are united into one flat graph over the region, whose edges cross the shards. Every vector is searched for in that graph:
a greedy search with a beam starts from the shards' medoids and from the vector's own vertex, and from every hit within
range the range is expanded over the graph until nothing new turns up. No task compares all vectors of a region. Hits are
verified in double precision. A pair that shares several regions belongs to the first of them and to no other, for counts
and components alike, so links are counted without listing pairs and agree with the components.

Recall is audited by brute force against all rows for samples of about `audit` vectors and more, until enough linked ones
of small groups were seen; each counts alike, small and large groups apart, and audited vectors carry their own recall in
the output. Where the audit sees no linked vector the recall is not known, and said to be so. A recall under `least_recall` widens beam and overlap and searches again; after the second search all pairs
are compared, block against block.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have no links, nor has a
row without id; vectors of different lengths are not compared; rows of one id are one vertex, whatever their vectors, so
they share a component, while links are counted for each row's own vector; repeated rows are equal vectors; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from velumen.llm import textcore as tc
from velumen.llm.graph import _roots, components
from velumen.llm.scratch import Scratch, partitions

COSINE = 0.95
#: Vectors of a region at most, about as many of a shard, and of a task that deals them out.
REGION, SHARD, DEALT = 8192, 1024, 16_384
#: Pivots of one dealing at most, and dealings of one vector.
PIVOTS, LEVELS = 2048, 6
NEAR, FAR_, DEGREE, SLACK = 16, 8, 12, 1.2
#: Linked classes of small groups that an audit must see, classes that one pass of it looks at, links of a class in a large group.
LINKED, AUDITED, LARGE = 50, 8192, 10
#: Classes that an audit looks at in all, at most.
MOST_AUDITED = 65_536
_log = logging.getLogger(__name__)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stacked(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a column of packed vectors of one length, four or eight bytes a component."""
    raw = b"".join(x.as_buffer().to_pybytes() for x in column)
    return unit(np.frombuffer(raw, f"<f{len(raw) // (dim * len(column))}").reshape(-1, dim)) if len(column) else np.zeros((0, dim))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, k, x, dim, v): 128 bits of each usable vector's components, its length and its packed form; else nulls."""
    kind = vectors.schema["v"].dataType
    plain = vectors if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else vectors.withColumn("v", F.col("v").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(1), batch.num_rows
            off = np.asarray(lists.offsets)
            flat = lists.values.to_numpy(zero_copy_only=False) + 0.0  # null is NaN, and no zero is negative
            size = np.where(np.asarray(lists.is_valid()) & np.asarray(batch.column(0).is_valid()), np.diff(off), 0)
            keys, dims, packed = np.zeros((2, n), dtype=np.uint64), np.zeros(n, dtype=np.int32), [None] * n
            for dim in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == dim)
                m = flat[off[:-1][rows][:, None] + np.arange(dim)]
                some = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                for r, line in zip(rows[some], np.ascontiguousarray(m[some]), strict=True):
                    raw = line.tobytes()
                    h = xxhash.xxh3_128_intdigest(raw)
                    keys[0, r], keys[1, r], dims[r], packed[r] = h >> 64, h & 0xFFFFFFFFFFFFFFFF, dim, raw
            none = dims == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(k.view(np.int64), mask=none) for k in keys), pa.array(dims, mask=none), pa.array(packed, pa.binary())], names=["vec_id", "k", "x", "dim", "v"])

    return plain.select("vec_id", "v").mapInArrow(run, "vec_id long, k long, x long, dim int, v binary")


def margin(dim: int, cosine: float, wide: float) -> float:
    """By how much a pivot's cosine may stay below the nearest one's: so many standard deviations of what the difference
    between two linked vectors, in a random direction, adds to the difference between two pivots' cosines."""
    return wide * float(np.sqrt(2 * (1 - cosine**2) / max(dim - 1, 1)))


def dispersed(x: np.ndarray, most: int, apart: float = 0.9) -> np.ndarray:
    """Rows no two of which are closer than `apart`, in the given order."""
    kept: list[int] = []
    for i in range(len(x)):
        if not kept or (x[kept] @ x[i]).max() < apart:
            kept.append(i)
            if len(kept) == most:
                break
    return x[kept]


_MEMBERS = "shard long, earlier array<long>, id long, v binary, dim int, size long, settled boolean"


def deal(classes: DataFrame, scratch: Scratch, cosine: float, wide: float) -> DataFrame:
    """(shard, earlier, id, v, dim, size): every class in one or more regions of bounded size.

    earlier: the alternatives that a class had before the ones which led here. Two classes that share one of them meet there.
    """
    now = classes.select(F.xxhash64(F.lit("root"), "dim").alias("shard"), F.array().cast("array<long>").alias("earlier"), "id", "v", "dim", "size", F.lit(False).alias("settled"))
    tasks, done = partitions(scratch.spark), []
    for level in range(LEVELS):
        sizes = now.where("not settled").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > REGION)
        big = scratch.keep(sizes.withColumn("wanted", F.least(F.lit(PIVOTS), F.ceil(6 * F.col("n") / REGION))).withColumn("salts", F.ceil(F.col("n") / DEALT)), "big")
        if big.isEmpty():
            break
        at = now.where("not settled").join(big, "shard")
        # About four candidates for each pivot, chosen by id, go to every task that deals out their region's vectors.
        pick = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < 4 * F.col("wanted") / F.col("n") * (1 << 30)
        data = at.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).withColumn("pivot", F.lit(False))
        chosen = at.where(pick).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("pivot", F.lit(True))

        def nearest(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            for t in tc.grouped(batches, ["shard", "salt"]):
                t = t.combine_chunks()
                pivot, dim, shard = t.column("pivot").to_numpy(), t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
                some = t.filter(pa.array(pivot)).sort_by("id")
                p = dispersed(stacked(some.column("v").combine_chunks(), dim), t.column("wanted")[0].as_py()) if some.num_rows else np.zeros((0, dim))
                t = t.filter(pa.array(~pivot)).select(names)
                if len(p) < 2:  # a group that pivots cannot part
                    yield from t.set_column(6, "settled", pa.array([True] * t.num_rows)).to_batches()
                    continue
                s = stacked(t.column("v").combine_chunks(), dim) @ p.T
                row, k = np.nonzero(s >= s.max(axis=1, keepdims=True) - margin(dim, cosine, wide))
                new = tc.mix(np.uint64(shard & ((1 << 64) - 1)) + (k.astype(np.uint64) + tc.U(1)) * tc.U(0x9E3779B97F4A7C15)).view(np.int64)
                first = np.searchsorted(row, row)  # alternatives of a row are in order
                before, n = t.column("earlier").to_pylist(), np.arange(len(row))
                earlier = [before[r] + [level << 32 | int(x) for x in k[f:i]] for r, f, i in zip(row, first, n, strict=True)]
                out = t.take(pa.array(row)).set_column(0, "shard", pa.array(new)).set_column(1, "earlier", pa.array(earlier, pa.list_(pa.int64())))
                yield from out.to_batches()

        names = [c.split()[0] for c in _MEMBERS.split(", ")]
        rows = data.unionByName(chosen).select(*names, "wanted", "salt", "pivot")
        done.append(now.join(big.select("shard"), "shard", "left_anti"))
        now = scratch.keep(rows.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt").mapInArrow(nearest, _MEMBERS), "dealt")
        done.append(now.where("settled"))
        now = now.where("not settled")
    for part in done:
        now = now.unionByName(part)
    now = now.drop("settled")
    big = scratch.keep(now.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > REGION).select("shard", F.ceil(2 * F.col("n") / REGION).alias("blocks")), "big")
    if big.isEmpty():
        return now
    cut = now.join(big, "shard").withColumn("mine", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")))
    code = lambda j: F.least("mine", j) * F.col("blocks") + F.greatest("mine", j) + (1 << 40)
    codes = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("mine")), code)
    cut = cut.withColumn("codes", codes).withColumn("here", F.explode("codes"))
    earlier = F.concat("earlier", F.filter("codes", lambda c: c < F.col("here")))
    cut = cut.select(F.xxhash64("shard", "here").alias("shard"), earlier.alias("earlier"), "id", "v", "dim", "size")
    return now.join(big, "shard", "left_anti").unionByName(cut)


def shards(x: np.ndarray, rng: np.random.Generator, apart: float, about: int) -> list[np.ndarray]:
    """Overlapping cluster shards of a region's rows: each row around every pivot not much farther than its nearest."""
    if len(x) <= 2 * about:
        return [np.arange(len(x))]
    p = dispersed(x[rng.permutation(len(x))[: 4 * about]], -(-2 * len(x) // about))
    s = x @ p.T
    member = s >= s.max(axis=1, keepdims=True) - apart
    return [rows for k in range(len(p)) if len(rows := np.flatnonzero(member[:, k]))]


def pruned(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Adjacency lists (-1: none) of a shard: robust pruning of the nearest and of some far candidates."""
    n = len(x)
    near = min(NEAR, n - 1)
    out = np.full((n, DEGREE), -1, dtype=np.int64)
    if near < 1:
        return out
    for a in range(0, n, 256):
        m = min(256, n - a)
        rows = np.arange(m)
        s = x[a : a + m] @ x.T
        s[rows, a + rows] = -2
        cand = np.concatenate([np.argpartition(-s, near - 1, axis=1)[:, :near], rng.integers(0, n, (m, FAR_))], axis=1)
        cand.sort(axis=1)
        d = 1 - np.take_along_axis(s, cand, axis=1)
        d[:, 1:][cand[:, 1:] == cand[:, :-1]] = np.inf
        d[cand == a + rows[:, None]] = np.inf
        v = x[cand]
        between = 1 - v @ v.transpose(0, 2, 1)
        for k in range(DEGREE):
            best = np.argmin(d, axis=1)
            alive = np.isfinite(d[rows, best])
            if not alive.any():
                break
            out[a + rows[alive], k] = cand[rows[alive], best[alive]]
            d[SLACK * between[rows, best] <= d] = np.inf
            d[rows, best] = np.inf
    return out


def flat_graph(x: np.ndarray, seed: int, apart: float, about: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and neighbours of the united lists of all shards, both ways, and the shards' medoids."""
    rng, slim, edges, starts = np.random.default_rng(seed), x.astype(np.float32), [], []
    for rows in shards(slim, rng, apart, about):
        part = slim[rows]
        adj = pruned(part, rng)
        i, k = np.nonzero(adj >= 0)
        a, b = rows[i], rows[adj[i, k]]
        edges += [a * len(x) + b, b * len(x) + a]
        starts.append(rows[np.argmax(part @ part.mean(axis=0))])
    key = np.unique(np.concatenate(edges))
    a = key // len(x)
    return np.searchsorted(a, np.arange(len(x) + 1)), key % len(x), np.unique(np.concatenate([starts, medoids(slim)]))


def medoids(x: np.ndarray, most: int = 12) -> np.ndarray:
    """The most central vector, and after it those farthest from all before."""
    first = int(np.argmax(x @ x.mean(axis=0)))
    found, near = [first], x @ x[first]
    while len(found) < min(most, len(x)):
        found.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[found[-1]])
    return np.array(found)


def in_range(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray, np.ndarray], cosine: float, beam: int, step: int = 1 << 20) -> np.ndarray:
    """Symmetric matrix of the pairs that range search over the graph finds and double precision verifies.

    graph: offsets, neighbours, medoids. No more than about `step` neighbours are looked at at once.
    """
    n, (off, to, starts) = len(x), graph
    degree = np.diff(off)
    found = np.zeros((n, n), dtype=bool)
    slim = x.astype(np.float32)

    def unseen(a: int, qi: np.ndarray, v: np.ndarray, seen: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours of v that query qi has not seen, now seen: query, neighbour, cosine. once: each query stands but once."""
        m = degree[v]
        nb = to[np.repeat(off[v] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        key = np.repeat(qi, m) * n + nb
        key = key[~seen.ravel()[key]]
        key = key if once else np.unique(key)
        seen.ravel()[key] = True
        q, nb = key // n, key % n
        return q, nb, np.einsum("ij,ij->i", slim[a + q], slim[nb])

    for a in range(0, n, 256):
        size = min(256, n - a)
        rows = np.arange(size)
        seen = np.zeros((size, n), dtype=bool)
        seen[:, starts] = True
        s = slim[a : a + size] @ slim[starts].T
        hits = [(np.repeat(rows, len(starts)), np.tile(starts, size), s.ravel())]
        # The beam begins with the nearest medoids and the query's own vertex.
        top = np.argsort(-s, axis=1)[:, : max(2, beam // 2)]
        ids, sims = np.concatenate([starts[top], a + rows[:, None]], axis=1), np.concatenate([np.take_along_axis(s, top, axis=1), np.ones((size, 1), np.float32)], axis=1)
        fresh = np.ones(ids.shape, dtype=bool)
        fresh[:, :-1] &= ids[:, :-1] != ids[:, -1:]
        seen[rows, a + rows] = True
        while True:
            score = np.where(fresh, sims, -np.inf)
            at = np.argmax(score, axis=1)
            go = np.flatnonzero(score[rows, at] > -np.inf)
            if not len(go):
                break
            fresh[go, at[go]] = False
            qi, v, s = unseen(a, go, ids[go, at[go]], seen, True)
            hits.append((qi, v, s))
            place = np.arange(len(qi)) - np.searchsorted(qi, qi)
            add = np.full((size, int(place.max(initial=-1)) + 1), -1, dtype=np.int64)
            add_s = np.full(add.shape, -np.inf, dtype=np.float32)
            add[qi, place], add_s[qi, place] = v, s
            ids, sims, fresh = np.concatenate([ids, add], axis=1), np.concatenate([sims, add_s], axis=1), np.concatenate([fresh, add_s > -np.inf], axis=1)
            if ids.shape[1] > beam:
                top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, fresh = (np.take_along_axis(y, top, axis=1) for y in (ids, sims, fresh))
        qi, v, s = (np.concatenate(y) for y in zip(*hits, strict=True))
        del hits
        near = s >= cosine - 0.02
        front = [(qi[near], v[near])]
        while front:  # range expansion: neighbours of hits, of their hits, and so on
            qi, v = front.pop()
            found[a + qi, v] = True
            edges = np.append(np.flatnonzero(np.diff(np.cumsum(degree[v]) // step)) + 1, len(v))
            for i, k in zip(np.concatenate([[0], edges[:-1]]), edges, strict=True):
                q2, v2, s = unseen(a, qi[i:k], v[i:k], seen, False)
                near = s >= cosine - 0.02
                if near.any():
                    front.append((q2[near], v2[near]))
    for a in range(0, n, 512):  # either direction finds a pair
        for b in range(a, n, 512):
            part = found[a : a + 512, b : b + 512] | found[b : b + 512, a : a + 512].T
            found[a : a + 512, b : b + 512], found[b : b + 512, a : a + 512] = part, part.T
    np.fill_diagonal(found, False)
    for a in range(0, n, 512):
        i, j = np.nonzero(np.triu(found[a : a + 512], k=a + 1))
        if len(i) > 16 * n:  # a dense strip is verified by one product
            bad = found[a : a + 512] & (x[a : a + 512] @ x.T < cosine)
            found[a : a + 512] &= ~bad
            found[:, a : a + 512] &= ~bad.T
            continue
        for c in range(0, len(i), 1 << 16):
            u, w = a + i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            bad = np.einsum("ij,ij->i", x[u], x[w]) < cosine
            found[u[bad], w[bad]] = found[w[bad], u[bad]] = False
    return found


def _local_roots(found: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of each row's component within a shard. ids: in order."""
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        for a in range(0, len(ids), 512):
            part = np.where(found[a : a + 512], root, len(ids)).min(axis=1, initial=len(ids))
            low[a : a + 512] = np.minimum(low[a : a + 512], part)
        low = low[low]
        if np.array_equal(low, root):
            return ids[root]
        root = low


def search(members: DataFrame, scratch: Scratch, cosine: float, beam: int, wide: float) -> DataFrame:
    """(id, links, root): per region, the links that belong there and the least id reachable by them."""

    def explore(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        ids, size, dim = t.column("id").to_numpy(), t.column("size").to_numpy(), t.column("dim")[0].as_py()
        x = stacked(t.column("v").combine_chunks(), dim)
        found = in_range(x, flat_graph(x, int(t.column("shard")[0].as_py()) & 0xFFFFFFFF, margin(dim, cosine, wide), SHARD), cosine, beam) if len(x) > 1 else np.zeros((1, 1), dtype=bool)
        # A pair that shares an earlier alternative belongs there.
        lists = t.column("earlier").combine_chunks()
        row, codes = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
        each, code = np.unique(codes, return_inverse=True)
        inside = np.zeros((len(ids), len(each)), dtype=np.float32)
        inside[row, code] = 1
        links = np.zeros(len(ids), dtype=np.int64)
        for a in range(0, len(ids), 512):
            part = found[a : a + 512]
            if len(each):
                part &= (inside[a : a + 512] @ inside.T) == 0
            links[a : a + 512] = part @ size
        some = found.any(axis=1)
        return pa.table({"id": ids[some], "links": links[some], "root": _local_roots(found, ids)[some]})

    return scratch.keep(members.groupBy("shard").applyInArrow(explore, "id long, links long, root long"), "found")


def exact(members: DataFrame, scratch: Scratch, cosine: float) -> DataFrame:
    """(id, links, root) of all pairs, without the graph. A class goes in by the region that holds it first."""
    return across(members.where(F.size("earlier") == 0), scratch, cosine)


def _block(rows: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, unit vectors and sizes of a block's structs."""
    ids, v, size = rows.flatten()
    return ids.to_numpy(), stacked(v, dim), size.to_numpy()


def blocks(homes: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, dim, rows, centre, radius): blocks of classes, with the cap that holds each."""
    packed = homes.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(8))).groupBy(F.xxhash64("shard", "part").alias("k"), "dim").agg(F.collect_list(F.struct("id", "v", "size")).alias("rows"))

    def capped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            for r in range(batch.num_rows):
                x = _block(batch.column(2)[r].values, batch.column(1)[r].as_py())[1]
                c = x.mean(axis=0)
                c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
                centres.append(c)
                radii.append(float(np.arccos(np.clip((x @ c).min(), -1, 1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())], names=["k", "dim", "rows", "centre", "radius"])

    schema = StructType([*packed.schema.fields, StructField("centre", ArrayType(DoubleType())), StructField("radius", DoubleType())])
    return scratch.keep(packed.mapInArrow(capped, schema), "blocks")


def across(homes: DataFrame, scratch: Scratch, cosine: float) -> DataFrame:
    """(id, links, root) of all pairs, by block against block; blocks too far apart do not meet."""
    packed = blocks(homes, scratch)
    a, b = (packed.select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns]) for side in "ab")
    angle = float(np.arccos(cosine)) + 1e-6
    dot = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("a_radius") - F.col("b_radius")
    # Not an equality of dim, which would send all blocks to one task.
    wanted = (F.col("a_k") <= F.col("b_k")) & (F.abs(F.col("a_dim") - F.col("b_dim")) < 1) & (apart <= angle)
    met = a.hint("shuffle_replicate_nl").join(b, wanted).select("a_dim", "a_rows", "b_rows", (F.col("a_k") == F.col("b_k")).alias("same"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, rows_a, rows_b, same = (c[r] for c in batch.columns)
                ids_a, x_a, size_a = _block(rows_a.values, dim.as_py())
                ids_b, x_b, size_b = _block(rows_b.values, dim.as_py())
                for c in range(0, len(x_a), 512):
                    i, j = np.nonzero(x_a[c : c + 512] @ x_b.T >= cosine)
                    i += c
                    if same.as_py():
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        nodes, root = _roots(ids_a[i], ids_b[j])
                        links = np.bincount(np.searchsorted(nodes, np.concatenate([ids_a[i], ids_b[j]])), np.concatenate([size_b[j], size_a[i]]))
                        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links.astype(np.int64)), pa.array(root)], names=["id", "links", "root"])

    return scratch.keep(met.mapInArrow(meet, "id long, links long, root long"), "across")


def recall(classes: DataFrame, counts: DataFrame, scratch: Scratch, cosine: float, audit: int) -> tuple[float | None, list[DataFrame]]:
    """Recall of linked classes by brute force against all (None where no linked one was seen), and tables (id, share) of the audited ones that have links.

    Each counts alike, and the worse of small and large groups decides. Samples of about `audit` classes and more are drawn
    until LINKED linked ones in small groups were seen, or MOST_AUDITED classes.
    """
    n, at, width = classes.count(), 0, 0.0
    seen: dict[bool, list[float]] = {False: [0, 0.0], True: [0, 0.0]}
    step, tables = min(1.0, audit / max(n, 1)), []
    place = F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 30))
    end = round(min(1.0, MOST_AUDITED / max(n, 1)) * (1 << 30))
    while at < end and seen[False][0] < LINKED:
        width = min(max(step, 4 * width), max(step, AUDITED / max(n, 1)))
        to = min(end, at + max(1, round(width * (1 << 30))))
        sample = classes.where((place >= at) & (place < to)).select("id", "v", "dim").toPandas()
        at = to
        if not len(sample):
            continue
        queries = {int(d): (g["id"].to_numpy(), stacked(pa.array(list(g["v"]), pa.binary()), int(d))) for d, g in sample.groupby("dim")}
        shared = classes.sparkSession.sparkContext.broadcast(queries)

        def brute(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dim = batch.column(2).to_numpy()
                for d in np.unique(dim):
                    if int(d) not in shared.value:
                        continue
                    ids, q = shared.value[int(d)]
                    rows = batch.filter(pa.array(dim == d))
                    x, own, size = stacked(rows.column(1), int(d)), rows.column(0).to_numpy(), rows.column(3).to_numpy()
                    for c in range(0, len(ids), 512):
                        hit = (q[c : c + 512] @ x.T >= cosine) & (ids[c : c + 512, None] != own)
                        some = hit.any(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[c : c + 512][some]), pa.array(hit[some] @ size)], names=["id", "n"])

        truth = classes.select("id", "v", "dim", "size").mapInArrow(brute, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        share = F.least("n", F.coalesce("links", F.lit(0))) / F.col("n")
        each = scratch.keep(truth.join(counts, "id", "left").select("id", (F.col("n") >= LARGE).alias("large"), share.alias("share")), "audit")
        tables.append(each.select("id", "share"))
        for r in each.groupBy("large").agg(F.count("*").alias("k"), F.sum("share").alias("s")).collect():
            seen[r.large][0] += r.k
            seen[r.large][1] += r.s
        shared.destroy()
    return min([s / k for k, s in seen.values() if k], default=None), tables


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, beam: int = 6, wide: float = 1.2, audit: int = 512, least_recall: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audit_recall (null where it was not audited or has no links),
    and recall, that of the whole search as the audit measured it (null where the audit saw no links)."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    base = scratch.keep(prepared(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))), "base")
    usable = base.where("dim is not null")
    # An id with several vectors has a vertex for each, which are joined.
    classes = scratch.keep(usable.groupBy("k", "x").agg(F.min("vec_id").alias("least"), F.first("v").alias("v"), F.first("dim").alias("dim"), F.count("*").alias("size")).select("k", "x", "least", F.xxhash64("k", "x").alias("id"), "v", "dim", "size"), "classes")
    for attempt in range(2):
        members = scratch.keep(deal(classes.drop("k", "x", "least"), scratch, cosine, wide * (1 + attempt / 2)), "members")
        found = search(members, scratch, cosine, beam << 2 * attempt, wide * (1 + attempt / 2))
        counts = scratch.keep(found.groupBy("id").agg(F.sum("links").alias("links")), "counts")
        share, audited = recall(classes, counts, scratch, cosine, audit)
        if share is None or share >= least_recall:
            break
        _log.warning("recall %.3f; %s", share, "beam and overlap are widened" if attempt < 1 else "all pairs are compared")
    else:
        found = exact(members, scratch, cosine)
        counts = scratch.keep(found.groupBy("id").agg(F.sum("links").alias("links")), "counts")
        share, audited = recall(classes, counts, scratch, cosine, audit)
    if share is None and classes.count() > MOST_AUDITED:
        _log.warning("recall is not measured: no vector of the audit has links")
    least = classes.select("id", "least")
    links = found.where("id != root").join(least.toDF("id", "a"), "id").join(least.toDF("root", "b"), "root").select("a", "b")
    several = base.groupBy("vec_id").agg(F.min(F.coalesce("k", F.lit(0))).alias("u"), F.max(F.coalesce("k", F.lit(0))).alias("v")).where("u != v and vec_id is not null").select("vec_id")
    own = usable.join(several, "vec_id", "left_semi").join(classes.select("k", "x", "least"), ["k", "x"]).select(F.col("vec_id").alias("a"), F.col("least").alias("b")).distinct()
    label = components(links.unionByName(own).where("a != b"), scratch)
    shares = audited[0] if audited else None
    for t in audited[1:]:
        shares = shares.unionByName(t)
    per = classes.select("k", "x", "id", "least", "size").join(counts, "id", "left").join(label.select(F.col("node").alias("least"), "component"), "least", "left")
    per = per.join(shares, "id", "left") if shares is not None else per.withColumn("share", F.lit(None).cast("double"))
    per = per.select("k", "x", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"), F.col("share").alias("audit_recall"))
    some = usable.select("vec_id", "k", "x").join(per, ["k", "x"]).select("vec_id", "n_links", "component_id", "audit_recall")
    rest = base.where("dim is null and vec_id is not null").select("vec_id").join(label.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.lit(None).cast("double").alias("audit_recall"))
    unnamed = base.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("audit_recall"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return some.unionByName(rest).unionByName(unnamed).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", kept.alias("kept"), "audit_recall", F.lit(share).cast("double").alias("recall"))
