"""Exact substring dedup by recompression: windows of words that occur anywhere else are removed.

Each executor rewrites the word sequences of its texts in rounds: runs of one symbol become one symbol, then a symbol of
the left class and one of the right class beside it become a pair symbol, and so on. Class and name of a symbol follow
from its content alone, by hashes that are the same everywhere, so all tasks of the round name runs and pairs globally
without exchanging a dictionary. Only symbols near an end of a substring depend on what stands outside it; each symbol
carries the stretch of words that decides it, its context. The two least names among the symbols decided within a window
are the window's anchor, and equal windows have equal anchors.

One shuffle deals windows out by their anchor, in runs. Where an anchor occurs once, its windows are unique; where it is
shared, fingerprints of the whole windows verify which of them repeat. Windows in which no symbol is decided (within long
runs of one word) stand by their own fingerprint. Many different windows around a common phrase have one anchor, both of whose names lie in
the phrase; anchors with more than a bucket's share of the windows are found first, on every eighth text, and their windows
are dealt by a second fingerprint of their own words instead. Windows equal within one block are found at once and sent a
single time, so that no passage, however common, fills a task. Two windows are equal if 56 bits of their words, 32 bits of their
anchor's name (or of the second fingerprint) and the bucket that more of its bits choose are equal; no step of these hashes
is linear, and the words themselves are not sent again.

Defined results: null text has no words; documents shorter than the window lose nothing; equal rows count as separate
occurrences, and rows with one id and text get the same result; a null id is carried; an empty table gives no rows;
other columns are kept. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velumen.llm import textcore as tc
from velumen.llm.scratch import Scratch, partitions

WINDOW = 35
ROUNDS = 4
#: Windows of one run at most; buckets in all, where tasks are few.
MOST, BUCKETS = 63, 16_384
#: Bytes of a window's fingerprint that are sent.
HASH_BYTES = 7
#: Rounds that begin with merging runs.
RUNS = (0, 2)
#: One text of so many is looked at for common anchors, and the windows there that make one common at least.
LOOK, COMMON = 8, 64


def _salt(k: int) -> np.uint64:
    return tc.U((0x9E3779B97F4A7C15 * (k + 1)) & ((1 << 64) - 1))


def symbols(h: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, context starts and context ends, in words, of the symbols of a block after so many rounds."""
    n = len(h)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return h, z, z
    first = np.zeros(n + 1, dtype=bool)
    first[rows] = True
    name, head = h, first[:n]  # the first symbol of its row
    low, high = np.arange(n), np.arange(1, n + 1)
    # What hangs on there being no symbol before or after hangs on a place that no window of the row holds.
    some = np.diff(rows) > 0
    before, after = rows[:-1][some] - 1, rows[1:][some] + 1
    for k in range(rounds):
        if k in RUNS:
            name, head, low, high = _merge_runs(name, head, low, high, before, after)
        left = (tc.mix(name ^ _salt(k)) >> tc.U(63)).astype(bool)
        tail = np.append(head[1:], True)
        joins = np.zeros(len(name), dtype=bool)
        joins[:-1] = left[:-1] & ~left[1:] & ~head[1:]
        taken = np.append(False, joins[:-1])
        # What a symbol's fate hangs on: its neighbour on the side to which it could have joined.
        reach = np.where(joins | (left & ~tail), np.append(high[1:], 0), high)
        since = np.where(~left & ~head & ~taken, np.append(0, low[:-1]), low)
        name = np.where(joins, tc.mix(name * tc.U(0xC2B2AE3D27D4EB4F) + np.append(name[1:], tc.U(0))), name)
        since[head] = np.where(left[head], since[head], before)
        reach[tail] = np.where(left[tail], after, reach[tail])
        keep = ~taken
        name, head, low, high = name[keep], head[keep], since[keep], reach[keep]
    return name, low, high


def _merge_runs(name, head, low, high, before, after):
    """Runs of one name become a symbol each, decided by the symbols on both sides."""
    new = head.copy()
    new[1:] |= name[1:] != name[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(name))
    times = ends - starts
    merged = np.where(times > 1, tc.mix(name[starts] + times.astype(np.uint64) * tc.U(0xA24BAED4963EE407)), name[starts])
    since = low[starts - 1]
    since[head[starts]] = before
    over = np.minimum(ends, len(name) - 1)
    reach = high[over]
    reach[(ends == len(name)) | head[over]] = after
    return merged, head[starts], since, reach


def anchors(h: np.ndarray, rows: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, fingerprint and anchor name of every window that lies within one row of a block.

    A window's anchor is the pair of the two least names, in a scrambled order, among the symbols decided within it.
    """
    whole = tc.grams(h, window)
    inside = np.zeros(len(h) + 1, dtype=np.int64)
    length = np.diff(rows)
    some = length >= window
    np.add.at(inside, rows[:-1][some], 1)
    np.add.at(inside, (rows[1:] - window + 1)[some], -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(whole)] > 0)
    whole = whole[at]
    name, low, high = symbols(h, rows, rounds)
    rank = tc.mix(name ^ _salt(rounds))
    j, end = np.searchsorted(low, at, side="left"), np.searchsorted(high, at + window, side="right")
    held = np.flatnonzero(j < end)
    out = tc.mix(whole)
    if len(held):
        least, second = _least_two(rank, j[held], end[held])
        out[held] = tc.mix(least * tc.U(0xC2B2AE3D27D4EB4F) + second)
    return at, whole, out


def _least_two(rank: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two least different values of each stretch, the second all ones where there is but one."""

    def both(a: tuple, b: tuple) -> tuple:
        least = np.minimum(a[0], b[0])
        return least, np.minimum(np.where(a[0] > least, a[0], a[1]), np.where(b[0] > least, b[0], b[1]))

    level = np.frexp((end - start).astype(np.float64))[1] - 1  # two stretches of 2**level cover each
    most, n = int(level.max()), len(rank)
    table = [(rank, np.full(n, ~tc.U(0)))]
    for k in range(most):
        shifted = np.minimum(np.arange(n) + (1 << k), n - 1)
        table.append(both(table[-1], tuple(x[shifted] for x in table[-1])))
    firsts, seconds = (np.concatenate([t[i] for t in table]) for i in range(2))
    a, b = level * n + start, level * n + end - (1 << level)
    return both((firsts[a], seconds[a]), (firsts[b], seconds[b]))


def _runs(*same: np.ndarray) -> np.ndarray:
    """Starts of the runs in which all the given differences hold, cut at MOST."""
    starts = np.flatnonzero(np.append(True, ~np.logical_and.reduce(same)))
    size = np.diff(np.append(starts, len(same[0]) + 1))
    pieces = -(-size // MOST)
    before = np.cumsum(pieces) - pieces
    return np.repeat(starts, pieces) + MOST * (np.arange(pieces.sum()) - np.repeat(before, pieces))


_DEALT = "bucket int, name array<int>, uid array<long>, chk array<smallint>, start array<int>, size array<tinyint>, whole binary"
_KINDS = (pa.int32(), pa.int64(), pa.int16(), pa.int32(), pa.int8())
_SPANS = "uid long, chk smallint, start int, n int"


def _spans(uid: np.ndarray, chk: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = uid.astype(np.int64), chk.astype(np.int16), start.astype(np.int32), n.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "chk", "start", "n"])


def _rows(bucket: np.ndarray, columns: list[np.ndarray], whole: np.ndarray | None, size: np.ndarray) -> pa.RecordBatch:
    """Runs in order of bucket as one row for each bucket; whole: the fingerprints of their windows, end to end."""
    cuts = np.append(_heads(bucket), len(bucket))
    off = pa.array(cuts.astype(np.int32))
    lists = [pa.ListArray.from_arrays(off, pa.array(c.astype(k.to_pandas_dtype()))) for c, k in zip(columns, _KINDS, strict=True)]
    if whole is None:
        blobs = pa.nulls(len(cuts) - 1, pa.binary())
    else:
        ends = np.concatenate([[0], np.cumsum(size)])[cuts].astype(np.int32) * HASH_BYTES
        raw = np.ascontiguousarray(whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
        blobs = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), *lists, blobs], names=[c.split()[0] for c in _DEALT.split(", ")])


def _heads(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, key[1:] != key[:-1]))


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(uid, chk, start, n): windows start..start+n-1 of that text occur elsewhere. docs: uid, chk, text (binary)."""
    tasks = partitions(docs.sparkSession)
    dealt = dealt_windows(docs, window=window, rounds=rounds)
    return dealt.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket").mapInArrow(_compare, _SPANS)


def buckets_of(tasks: int) -> int:
    """Tasks work through their buckets one by one and hold one at a time."""
    return tasks * max(1, min(16, BUCKETS // tasks))


def common_anchors(docs: DataFrame, window: int, rounds: int, buckets: int) -> np.ndarray:
    """Names of the anchors that more than a bucket's share of all windows has, in order; fewer than there are buckets.

    They are looked for on every eighth text. One that is missed costs balance and changes no result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in tc.blocks(batch.column(0), 2 * tc.BLOCK):
                starts, ends, rows = tc.spans(data, off)
                if len(starts) >= window:
                    name, n = np.unique(anchors(tc.word_hashes(data, starts, ends), rows, window, rounds)[2], return_counts=True)
                    total, few = n.sum(), 8 * buckets * n > n.sum()  # what is rarer in this block counts for little
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(name[few].view(np.int64), 0)), pa.array(np.append(n[few], 0)), pa.array(np.append(np.zeros(few.sum(), np.int64), total))], names=["name", "n", "windows"])

    scratch = Scratch(docs.sparkSession, "repeats")
    seen = docs.where(F.pmod("uid", F.lit(LOOK)) == 0).select("text").mapInArrow(count, "name long, n long, windows long")
    seen = scratch.keep(seen.groupBy("name").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows")), "names")
    total = seen.agg(F.sum("windows")).first()[0] or 0
    often = seen.where((F.col("n") >= COMMON) & (F.col("n").cast("double") * buckets > total)).select("name").collect()
    return np.sort(np.array([r["name"] for r in often], dtype=np.int64).view(np.uint64))


def dealt_windows(docs: DataFrame, *, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """The windows of all texts in runs, by bucket. docs: uid, chk, text (binary)."""
    buckets = buckets_of(partitions(docs.sparkSession))
    common = common_anchors(docs, window, rounds, buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, chks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for row, end, data, off in tc.blocks(batch.column(2), 2 * tc.BLOCK):
                starts, ends, rows = tc.spans(data, off)
                if len(starts) < window:
                    continue
                h = tc.word_hashes(data, starts, ends)
                at, whole, name = anchors(h, rows, window, rounds)
                if not len(at):
                    continue
                if len(common):
                    hot = common[np.minimum(np.searchsorted(common, name), len(common) - 1)] == name
                    if hot.any():
                        name = np.where(hot, tc.mix(tc.grams(tc.mix(h ^ _salt(rounds + 1)), window)[at]), name)
                yield from pack(at, whole, name, rows, uids[row:end], chks[row:end])

    def pack(at, whole, name, rows, uids, chks) -> Iterator[pa.RecordBatch]:
        order = np.argsort(whole, kind="stable")
        same = (whole[order][1:] == whole[order][:-1]) & (name[order][1:] == name[order][:-1])
        later, equal = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
        later[order[1:]] = same  # not the first of its kind in this block
        equal[order[1:]] |= same
        equal[order[:-1]] |= same
        doc = np.searchsorted(rows, at, side="right") - 1
        place = at - rows[doc]
        # Found here: runs of windows that repeat within the block.
        here = np.flatnonzero(equal)
        if len(here):
            cut = _runs(np.diff(here) == 1, np.diff(doc[here]) == 0)
            lead, size = here[cut], np.diff(np.append(cut, len(here)))
            d = doc[lead]
            yield _rows(np.full(len(lead), int(uids[d[0]]) % buckets), [np.zeros(len(lead)), uids[d], chks[d], place[lead], size], None, size)
        # To compare: one of each kind, in runs that share an anchor.
        send = np.flatnonzero(~later)
        cut = _runs(np.diff(send) == 1, np.diff(doc[send]) == 0, np.diff(name[send]) == 0, np.diff(equal[send].astype(np.int8)) == 0)
        size = np.diff(np.append(cut, len(send)))
        bucket = (name[send[cut]] >> tc.U(32)) * tc.U(buckets) >> tc.U(32)
        by = np.argsort(bucket, kind="stable")
        bucket, cut, size = bucket[by].astype(np.int64), cut[by], size[by]
        lead, upto = send[cut], np.cumsum(size)
        each = send[np.repeat(cut - (upto - size), size) + np.arange(upto[-1])]
        d = doc[lead]
        yield _rows(bucket, [(name[lead] & tc.U(0xFFFFFFFF)).astype(np.uint32).view(np.int32), uids[d], chks[d], place[lead], size * 2 + equal[lead]], whole[each], size)

    return docs.select("uid", "chk", "text").mapInArrow(deal, _DEALT)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: list[pa.RecordBatch] = []

    def unknown() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.filter(batch.column(6).is_null())
            if told.num_rows:
                known.append(_spans(*(told.column(i).flatten().to_numpy() for i in (2, 3, 4, 5))))
            yield batch.filter(batch.column(6).is_valid())

    for t in tc.grouped(unknown(), ["bucket"]):
        yield from known
        known.clear()
        found = _shared(t)
        if found is not None:
            yield found
    yield from known


def _shared(t: pa.Table) -> pa.RecordBatch | None:
    """Spans of the windows of a bucket that occur in it more than once, but for those found where they were read."""
    name, uid, chk, start, size = (t.column(i).combine_chunks().flatten().to_numpy() for i in range(1, 6))
    dup, size = (size & 1).astype(bool), (size >> 1).astype(np.int64)
    # A name that occurs once, and not twice within its block, needs no look at its windows.
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    pick = dup.copy()
    pick[order[1:]] |= same
    pick[order[:-1]] |= same
    pick = np.flatnonzero(pick)
    if not len(pick):
        return None
    hashes = np.zeros((int(size.sum()), 8), dtype=np.uint8)
    hashes[:, :HASH_BYTES] = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column(6)]).reshape(-1, HASH_BYTES)
    hashes = hashes.view("<u8").ravel()
    upto, s = np.cumsum(size), size[pick]
    end = np.cumsum(s)
    run = np.repeat(np.arange(len(pick)), s)
    key, tag = hashes[((upto - size)[pick] - (end - s))[run] + np.arange(end[-1])], name[pick][run]
    order = np.lexsort((tag, key))
    same = (key[order][1:] == key[order][:-1]) & (tag[order][1:] == tag[order][:-1])
    found = np.zeros(len(key), dtype=bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    hit = np.flatnonzero(found & ~dup[pick][run])
    if not len(hit):
        return None
    cut = _runs(np.diff(hit) == 1, np.diff(run[hit]) == 0)
    lead = hit[cut]
    r = run[lead]
    return _spans(uid[pick][r], chk[pick][r], start[pick][r] + (lead - (end - s)[r]), np.diff(np.append(cut, len(hit))))


def remove_repeats(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """docs with repeated words removed from the text, and n_words, n_removed and kept_sha256.

    Kept words are joined by one space where words were removed; a text that loses nothing stays as it is.
    """
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    text = next(k for k, c in names.items() if c == text_col)
    own = [F.col(c).cast("string") for c in docs.columns if c in ("doc_id", text_col)]
    # Rows are told apart by 79 bits of id and text; rows alike in both get the same result.
    keyed = docs.select(*[F.col(c).alias(k) for k, c in names.items()], F.xxhash64(*own).alias("uid"), F.pmod(F.hash(*own), F.lit(1 << 15)).cast("smallint").alias("chk"))
    spans = repeated_spans(keyed.select("uid", "chk", F.encode(F.col(text), "UTF-8").alias("text")), window=window, rounds=rounds)
    lists = spans.groupBy("uid", "chk").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    both = keyed.join(lists, ["uid", "chk"], "left")
    rest = [k for k in names if k != text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, words_n, removed_n, sha = [], [], [], []
            texts, spans = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                raw = texts[i].as_py()
                words = (raw or b"").split()
                gone = 0
                if spans[i].is_valid and len(spans[i]):
                    a, m = (x.to_numpy().astype(np.int64) for x in spans[i].values.flatten())
                    depth = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, a + m + window - 1, -1)
                    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                    gone = len(words) - len(kept)
                    words = [words[k] for k in kept]
                joined = b" ".join(words)
                out.append(joined if gone else raw)
                words_n.append(len(words) + gone)
                removed_n.append(gone)
                sha.append(hashlib.sha256(joined).hexdigest())
            columns = [pa.array(out, pa.binary()).cast(pa.string()), *(batch.column(2 + k) for k in range(len(rest))), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[text, *rest, "n_words", "n_removed", "kept_sha256"])

    kinds = ", ".join(f"{k} {keyed.schema[k].dataType.simpleString()}" for k in rest)
    schema = ", ".join(x for x in (f"{text} string", kinds, "n_words long, n_removed long, kept_sha256 string") if x)
    done = both.select(F.encode(F.col(text), "UTF-8").alias(text), "spans", *rest).mapInArrow(cut, schema)
    made = [c for c in ("n_words", "n_removed", "kept_sha256") if c not in names.values()]
    return done.select(*[F.col(k).alias(c) for k, c in names.items()], *made)


def repeat_digest(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs.select("doc_id", "text"), **options).select("doc_id", "n_words", "n_removed", "kept_sha256")
