"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share the corpus by weight; a source stops at a cap of so many times its own size and its excess goes to the
others by weight, which is a water level over the sources. Each source gets slots of equal tokens, the last one cut to
its target. Van der Corput points (slot numbers with their bits reversed) fall on the cumulated slot counts, so that
every stretch of the schedule holds each source in proportion. Slots are ranked within their source and join, rank by
rank and round after round, the equal-token blocks of that source's shuffled documents. The mixture is written in the
order of the slots, and every document tells where in the schedule its words stand.

Nothing is gathered but two totals: shuffles and ranks use prefix sums over buckets of rows, whose number follows the
input, and the table of sources is sent around only where Spark finds it small. Only that table, one row per source,
is ever ordered in one task. Defined results: null or empty text has size 0 and is never taken; a null id is carried; repeated
rows are documents of their own, side by side on the line; an empty table gives no rows; reruns agree.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velumen.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SEED = "mix-1"
#: Rows of a bucket within which order is settled by sorting.
BUCKET = 4096


def sized(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, key): size in words, key the place in the shuffle."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # Rows without id are told apart by their texts, which spreads them over the shuffle.
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    key = F.md5(F.concat(F.lit(SEED + ":"), name))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, documents, target. Weights repeat over the sources by code point, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = per.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("full_at", F.col("most") / F.col("weight"))
    upto = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after, all_ = upto.rowsBetween(W.unboundedPreceding, -1), upto.rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(all_) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The first source, in order of its full level, that the water no longer fills sets the level of all after it.
    found = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("full_at")).withColumn("place", F.row_number().over(upto))
    final = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("place"))).over(all_)
    return found.withColumn("target", F.round(F.least("most", F.coalesce(F.col("weight") * final, F.col("most"))), 6)).select("source", "source_size", "documents", "target")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


class Mix:
    """A schedule over documents: blocks, slots, pieces and what each document gives."""

    def __init__(self, docs: DataFrame, *, block: int = 2048, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = 3.0, **columns):
        if block < 1 or cap <= 0 or share <= 0 or min(weights) <= 0:
            raise ValueError("block, cap, share and weights must be positive")
        self.spark: SparkSession = docs.sparkSession
        self.block = block
        # Ids, sources and sizes are read several times, texts once.
        scratch = Scratch(self.spark, "mixing")
        self.sizes = scratch.keep(sized(docs, **columns))
        self.sources = scratch.keep(targets(self.sizes, weights=weights, share=share, cap=cap).withColumn("take", F.round("target").cast("long")), "sources")

    def totals(self) -> tuple[int, int]:
        """Documents and slots."""
        r = self.sources.agg(F.sum("documents"), F.sum(F.ceil(F.col("take") / self.block))).first()
        return int(r[0] or 0), int(r[1] or 0)

    def lines(self, documents: int) -> DataFrame:
        """Every document with words, with its place `at` on its source's shuffled line of words."""
        digits = 1
        while 16**digits * BUCKET < documents:
            digits += 1
        placed = self.sizes.where("size > 0").withColumn("bucket", F.substring("key", 1, digits))
        sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        start = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select("source", "bucket", start.alias("start"))
        inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
        placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
        joined = placed.join(sums.alias("s"), _same(F.col("d.source"), F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
        return joined.select("d.doc_id", "d.source", "d.size", "d.key", (F.col("s.start") + F.col("d.inside")).alias("at"))

    def slots(self, n_slots: int) -> DataFrame:
        """(slot, source, source_size, take, rank): van der Corput points over the cumulated slot counts, ranked within their source."""
        want = self.sources.withColumn("n", F.ceil(F.col("take") / self.block).cast("long"))
        high = F.sum("n").over(W.orderBy(F.col("source").asc_nulls_last()))
        want = want.select("source", "source_size", "take", (high - F.col("n")).alias("low"), high.alias("high")).where("high > low")
        # Sources by the stretches of slots that they touch, so that slots find theirs by an equal key.
        want = want.withColumn("stretch", F.explode(F.sequence(F.expr(f"low div {BUCKET}"), F.expr(f"(high - 1) div {BUCKET}"))))
        bits = max(1, (max(n_slots, 1) - 1).bit_length())
        tasks = max(1, min(200_000, ceil((1 << bits) / 200_000)))
        point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
        points = self.spark.range(0, 1 << bits, 1, tasks).withColumnRenamed("id", "slot").withColumn("x", point).where(F.col("x") < n_slots)
        points = points.withColumn("stretch", F.expr(f"x div {BUCKET}"))
        drawn = points.join(want, "stretch").where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("slot", "source", "source_size", "take", (F.floor(F.col("slot") / BUCKET)).alias("chunk"))
        counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
        first = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select("source", "chunk", first.alias("first")).alias("c")
        local = drawn.withColumn("local", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1).alias("d")
        return local.join(counts, _same(F.col("d.source"), F.col("c.source")) & (F.col("d.chunk") == F.col("c.chunk"))).select("d.slot", "d.source", "d.source_size", "d.take", (F.col("c.first") + F.col("d.local")).alias("rank"))

    def pieces(self) -> DataFrame:
        """The mixture's parts: (slot, source, round, doc_id, size, key, at, start, words), places in words."""
        return self._pieces(*self.totals())

    def _pieces(self, documents: int, n_slots: int) -> DataFrame:
        # The stretch of the source's endless line that a slot reads, cut where its rounds end.
        s = self.slots(n_slots).select("slot", "source", "source_size", (F.col("rank") * self.block).alias("low"), F.least((F.col("rank") + 1) * self.block, F.col("take")).alias("high"))
        s = s.withColumn("round", F.explode(F.sequence(F.expr("low div source_size"), F.expr("(high - 1) div source_size"))))
        low = F.greatest(F.col("low") - F.col("round") * F.col("source_size"), F.lit(0))
        high = F.least(F.col("high") - F.col("round") * F.col("source_size"), F.col("source_size"))
        s = s.select("slot", "source", "round", low.alias("low"), high.alias("high"))
        s = s.withColumn("block", F.explode(F.sequence(F.expr(f"low div {self.block}"), F.expr(f"(high - 1) div {self.block}")))).alias("s")
        d = self.lines(documents)
        d = d.withColumn("block", F.explode(F.sequence(F.expr(f"at div {self.block}"), F.expr(f"(at + size - 1) div {self.block}")))).alias("l")
        low = F.greatest(F.col("s.low"), F.col("l.at"), F.col("l.block") * self.block)
        high = F.least(F.col("s.high"), F.col("l.at") + F.col("l.size"), (F.col("l.block") + 1) * self.block)
        return d.join(s, _same(F.col("l.source"), F.col("s.source")) & (F.col("l.block") == F.col("s.block"))).where(high > low).select(
            "s.slot", "s.source", "s.round", "l.doc_id", "l.size", "l.key", "l.at", (low - F.col("l.at")).alias("start"), (high - low).alias("words")
        )

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target, taken, source, first_slot, slot_words.

        first_slot: where in the schedule the document first stands (null: nowhere); slot_words: the sum of slot times
        words over all its parts.
        """
        documents, n_slots = self.totals()
        got = self._pieces(documents, n_slots).groupBy("doc_id", "source", "size", "at").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sum(F.col("slot") * F.col("words")).alias("slot_words")).alias("g")
        d = self.lines(documents).alias("d")
        same = _same(F.col("d.doc_id"), F.col("g.doc_id")) & _same(F.col("d.source"), F.col("g.source")) & (F.col("d.size") == F.col("g.size")) & (F.col("d.at") == F.col("g.at"))
        n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        some = d.join(got, same, "left").select("d.doc_id", "d.size", "d.source", n("taken"), "first_slot", n("slot_words"))
        none = self.sizes.where("size = 0").select("doc_id", "size", "source", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("slot_words"))
        rows = some.unionByName(none).alias("d")
        return rows.join(self.sources.alias("s"), _same(F.col("d.source"), F.col("s.source"))).select("d.doc_id", "d.size", "s.source_size", "s.target", "d.taken", "d.source", "d.first_slot", "d.slot_words")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, with the columns of docs, in the order of the schedule.

    A document stands once for every round that takes it, at its first slot there; the last one of a source may be cut
    to its first words. Rows alike in id, source and size stand side by side on the line, in the order of their texts.
    """
    mix = Mix(docs, **options)
    alike = ["doc_id", "source", "size"]
    got = mix.pieces().groupBy(*alike, "at", "round").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    got = got.withColumn("n", F.dense_rank().over(W.partitionBy(*alike).orderBy("at"))).alias("t")
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    own = next(k for k, c in names.items() if c == "text")
    rows = docs.select(*[F.col(c).alias(k) for k, c in names.items()], F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).where("size > 0")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy(*alike).orderBy(F.xxhash64(own)))).alias("d")
    each = rows.join(got, _same(F.col("d.doc_id"), F.col("t.doc_id")) & _same(F.col("d.source"), F.col("t.source")) & (F.col("d.size") == F.col("t.size")) & (F.col("d.n") == F.col("t.n")))
    head = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(f"({WORD})"), 1), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("t.size"), F.col(own)).otherwise(head)
    each = each.select(*[text.alias(k) if k == own else F.col(k) for k in names], "t.slot", "t.at", "t.round").orderBy("slot", "round", "at")
    return each.select(*[F.length(own).cast("long").alias(c) if c == "n_chars" else F.col(k).alias(c) for k, c in names.items()])
