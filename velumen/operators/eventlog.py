"""The event log as a store for several writers: id ranges, batches that count once, snapshots of flags.

A journal holds what writers decide. To append, a writer reserves a range of ids, one entry; writes its rows under those ids to a
folder of its own; and publishes the folder, one more entry. Readers see published folders only. A batch has a key: a second
attempt at it takes the range of the first, and of several attempts one is published.

A snapshot is the last event of every image and flag among the batches that were published up to an entry of the journal.
Batches after that entry are the tail, whatever their events' ids and times: an event that arrives late is in the
tail, and counts if its time is later than that of the snapshot's event. Flags come from the snapshot and the tail alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velumen.operators.numbering import numbered
from velumen.sources.journal import Journal

SCHEMA = "id long, event_type string, payload string, created_at timestamp_ntz"
#: Flags of an image: event types that set and that clear them.
FLAGS = {"deleted": ("imageDeleted", "imageUndeleted"), "searchable": ("setImageSearchable", "setImageNotSearchable")}
_STATE = "image_id string, flag string, event_type string, created_at timestamp_ntz, id long"


@dataclass(frozen=True)
class Range:
    """Ids from first on, n of them."""

    first: int
    n: int


def changes(log: DataFrame) -> DataFrame:
    """(image_id, flag, event_type, created_at, id) of the events that set a flag."""
    flag = F.lit(None).cast("string")
    for name, kinds in FLAGS.items():
        flag = F.when(F.col("event_type").isin(*kinds), name).otherwise(flag)
    found = log.select(F.get_json_object("payload", "$.id").alias("image_id"), flag.alias("flag"), "event_type", "created_at", "id")
    return found.where("flag is not null and image_id is not null")


def folded(changed: DataFrame) -> DataFrame:
    """The last change of each image and flag, by time, then id."""
    last = F.max_by(F.struct("event_type", "created_at", "id"), F.struct("created_at", "id")).alias("l")
    return changed.groupBy("image_id", "flag").agg(last).select("image_id", "flag", "l.event_type", "l.created_at", "l.id")


def with_flags(images: DataFrame, state: DataFrame) -> DataFrame:
    """images with flags as the state has them."""
    kinds = {name: on for name, (on, _) in FLAGS.items()}
    wide = state.groupBy("image_id").agg(*[F.max(F.when(F.col("flag") == f, F.col("event_type") == on)).alias(f"_{f}") for f, on in kinds.items()])
    joined = images.join(wide, images["id"].cast("string") == wide["image_id"], "left")
    return joined.select(*[F.coalesce(f"_{c}", images[c]).alias(c) if c in kinds else images[c] for c in images.columns])


class EventLog:
    def __init__(self, spark: SparkSession, root: str, **options):
        self.spark, self.root = spark, root.rstrip("/")
        self.journal = Journal(spark, self.root, **options)

    # State of the journal -------------------------------------------------------------------------------------

    @staticmethod
    def _batches(entries: list[dict]) -> list[dict]:
        """Published folders: path, and the entry that published it."""
        out: list[dict] = []
        for e in entries:
            if e.get("base"):
                out = [dict(b) for b in e["batches"]]
            elif e["kind"] == "publish":
                out.append({"path": e["path"], "at": e["number"]})
        return out

    @staticmethod
    def _done(entries: list[dict]) -> set[str]:
        """Keys of published batches."""
        return {k for e in entries for k in (e["keys"] if e.get("base") else [e["batch"]] if e["kind"] == "publish" else [])}

    @staticmethod
    def _ranges(entries: list[dict]) -> dict[str, Range]:
        out: dict[str, Range] = {}
        for e in entries:
            for k, first, n in e["ranges"] if e.get("base") else [(e["batch"], e["first"], e["n"])] if e["kind"] == "reserve" else []:
                out[k] = Range(first, n)
        return out

    @staticmethod
    def _next(entries: list[dict]) -> int:
        return max((e["next"] for e in entries if "next" in e), default=1)

    @staticmethod
    def _snapshot(entries: list[dict]) -> dict | None:
        found = [e["snapshot"] if e.get("base") else e for e in entries if e.get("base") or e["kind"] == "snapshot"]
        found = [s for s in found if s]
        return {"path": found[-1]["path"], "upto": found[-1]["upto"]} if found else None

    # Appending ------------------------------------------------------------------------------------------------

    def reserve(self, n: int, batch: str | None = None) -> Range:
        """n ids that nobody else has, the same ones again for the same batch."""
        batch, found = batch or uuid.uuid4().hex, {}

        def decide(entries: list[dict]) -> dict | None:
            found["range"] = self._ranges(entries).get(batch)
            if found["range"] is not None:
                return None
            first = self._next(entries)
            return {"kind": "reserve", "batch": batch, "first": first, "n": n, "next": first + n}

        entry = self.journal.commit(decide)
        got = found["range"] if entry is None else Range(entry["first"], entry["n"])
        if got.n != n:
            raise ValueError(f"batch {batch} came with {got.n} rows before, and with {n} now")
        return got

    def published(self, batch: str) -> bool:
        return batch in self._done(self.journal.entries())

    def append(self, new: DataFrame, now: Column | None = None, *, batch: str | None = None) -> bool:
        """Append (event_type, payload), at their own created_at or now; False where the batch is there already."""
        batch = batch or uuid.uuid4().hex
        if self.published(batch):
            return False
        when = F.col("created_at") if "created_at" in new.columns else now
        rows = new.select("event_type", "payload", when.cast("timestamp_ntz").alias("created_at"))
        lined = numbered(rows, "created_at", "event_type", F.md5(F.coalesce("payload", F.lit(""))))
        n = lined.count()
        if n == 0:
            return self._publish(batch, None)
        first = self.reserve(n, batch).first
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        lined.select((F.col("number") + (first - 1)).alias("id"), "event_type", "payload", "created_at").write.option("compression", "zstd").parquet(path)
        return self._publish(batch, path)

    def _publish(self, batch: str, path: str | None) -> bool:
        entry = self.journal.commit(lambda entries: None if batch in self._done(entries) else {"kind": "publish", "batch": batch, "path": path})
        if entry is None and path is not None:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            self.journal.fs.delete(at, True)
        return entry is not None

    # Reading --------------------------------------------------------------------------------------------------

    def _read(self, batches: list[dict]) -> DataFrame:
        paths = [b["path"] for b in batches if b["path"]]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        """All events."""
        return self._read(self._batches(self.journal.entries()))

    def tail(self) -> DataFrame:
        """Events of the batches that the last snapshot has not seen."""
        entries = self.journal.entries()
        upto = (self._snapshot(entries) or {"upto": 0})["upto"]
        return self._read([b for b in self._batches(entries) if b["at"] > upto])

    def state(self) -> DataFrame:
        """The last change of each image and flag, from the snapshot and the tail."""
        entries = self.journal.entries()
        seen = self._snapshot(entries)
        new = changes(self._read([b for b in self._batches(entries) if b["at"] > (seen or {"upto": 0})["upto"]]))
        if seen:
            new = self.spark.read.schema(_STATE).parquet(seen["path"]).unionByName(new)
        return folded(new)

    def images(self, images: DataFrame) -> DataFrame:
        """images with their flags as the log has them."""
        return with_flags(images, self.state())

    # Upkeep ---------------------------------------------------------------------------------------------------

    def snapshot(self) -> int:
        """Write the state; the entry up to which it counts. A snapshot of less than another one has seen is not committed."""
        entries = self.journal.entries()
        upto = entries[-1]["number"] if entries else 0
        path = f"{self.root}/snapshots/{uuid.uuid4().hex}"
        # The state of these entries, whatever is published meanwhile.
        seen = self._snapshot(entries)
        new = changes(self._read([b for b in self._batches(entries) if b["at"] > (seen or {"upto": 0})["upto"]]))
        folded(new if not seen else self.spark.read.schema(_STATE).parquet(seen["path"]).unionByName(new)).write.option("compression", "zstd").parquet(path)
        self.journal.commit(lambda now: None if (self._snapshot(now) or {"upto": -1})["upto"] >= upto else {"kind": "snapshot", "path": path, "upto": upto})
        return upto

    def compact(self) -> None:
        """Merge the batches that the last snapshot has seen into one folder in the order of ids, and let the journal begin anew."""
        entries = self.journal.entries()
        seen = self._snapshot(entries)
        old = [b for b in self._batches(entries) if seen and b["at"] <= seen["upto"] and b["path"]]
        if len(old) < 2:
            return
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        self._read(old).repartitionByRange("id").sortWithinPartitions("id").write.option("compression", "zstd").parquet(path)
        gone = {b["path"] for b in old}

        def decide(now: list[dict]) -> dict | None:
            batches = self._batches(now)
            if not gone <= {b["path"] for b in batches}:
                return None  # another writer has merged them
            left = [b for b in batches if b["path"] not in gone and b["path"]]
            done = self._done(now)
            ranges = [[k, r.first, r.n] for k, r in self._ranges(now).items() if k not in done]
            return {"base": True, "kind": "base", "batches": [{"path": path, "at": max(b["at"] for b in old)}, *left], "keys": sorted(done), "ranges": ranges, "next": self._next(now), "snapshot": self._snapshot(now)}

        self.journal.commit(decide)


def replayed(images: DataFrame, log: DataFrame) -> DataFrame:
    """images with their flags by the whole log, without a snapshot."""
    return with_flags(images, folded(changes(log)))


