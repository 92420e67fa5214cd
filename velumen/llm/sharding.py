"""Sharded corpora by size-tiered compaction, with versioned manifests.

Arrivals are appended as small immutable Parquet shards. Shards of one size tier (sizes within a factor of the tier
base) are merged, in order, into files near a target size; the merged files are new, the old ones stay as they are
until `expire`. Every change becomes visible by one atomic step: a manifest of the next number is written aside and put
in its place, which fails if that number is taken (a hard link on a local file system, a rename on HDFS; other stores
must name their own atomic step), and then the writer reads the newest manifest and tries again. A reader takes the
shards that its manifest names and nothing else, so files of failed or late tasks are never seen.

Writers mark a folder as pending before they write to it and take the mark away once its files are committed. `expire`
lists files first, marks next and the manifest last, so that whatever it lists is pending, named or left over; it never
deletes files that are about to be committed.

Manifests name files and their sizes, so they grow with the number of files, which the target size keeps small; merges
are planned on that list and read and written by Spark tasks, several files side by side.

Defined results: an append without rows commits nothing new, unless it is the first and makes an empty store; all columns and their types are kept, null and repeated
rows and very long texts too; a store without a manifest reads as an error.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce
from math import log

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumen.llm.scratch import filesystem

#: Shards below the target whose sizes differ by no more than this factor are of one tier.
TIER = 4
#: As many shards of one tier are merged.
FANIN = 4
#: Runs merged by one job, side by side.
RUNS = 64
#: Seconds after which a pending folder counts as left by a writer that is gone.
ABANDONED = 7 * 86_400


class Conflict(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 128 << 20, publish: Callable[[str, str], bool] | None = None):
        """publish(aside, place): puts a written file in its place, or tells that the place is taken, in one atomic step."""
        if target_bytes < 1:
            raise ValueError("target_bytes must be positive")
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self.fs, self._root = filesystem(spark, self.root)
        self.publish = publish or {"file": self._link, "hdfs": self._rename, "viewfs": self._rename}.get(self.fs.getScheme())
        if self.publish is None:
            raise ValueError(f"no atomic step is known for {self.fs.getScheme()}; name one as publish")

    def _link(self, aside: str, place: str) -> bool:
        nio, at = self.spark._jvm.java.nio.file, lambda p: self.spark._jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
        try:
            nio.Files.createLink(at(place), at(aside))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _rename(self, aside: str, place: str) -> bool:
        return self.fs.rename(self._path(aside), self._path(place))

    # Manifests ----------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        at = self._path("manifests")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"{self.root} has no manifest")
        version = known[-1] if version is None else version
        raw = self.fs.open(self._path(f"manifests/v{version:012d}.json"))
        try:
            return json.loads(bytes(raw.readAllBytes()).decode())
        finally:
            raw.close()

    def commit(self, based_on: int, shards: list[dict], schema: str) -> int:
        """Make `shards` the store's content, if `based_on` is still the newest version."""
        version = based_on + 1
        if (self.versions() or [0])[-1] != based_on:
            raise Conflict(f"version {based_on} is not the newest")
        aside = f"manifests/.{uuid.uuid4().hex}"
        self.fs.mkdirs(self._path("manifests"))
        out = self.fs.create(self._path(aside), False)
        out.write(bytearray(json.dumps({"version": version, "shards": shards, "schema": schema}).encode()))
        out.close()
        try:
            if not self.publish(aside, f"manifests/v{version:012d}.json"):
                raise Conflict(f"version {version} is taken")
        finally:
            self.fs.delete(self._path(aside), False)
        return version

    def _change(self, schema: str, edit) -> int:
        """Commit edit(shards), again on top of others' commits."""
        for _ in range(20):
            known = self.versions()
            now = self.manifest(known[-1]) if known else {"version": 0, "shards": [], "schema": schema}
            after = edit(now["shards"])
            if known and after == now["shards"]:
                return now["version"]
            try:
                return self.commit(now["version"], after, now["schema"])
            except Conflict:
                continue
        raise Conflict("too many writers")

    # Shards -------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, by: str | None = None) -> tuple[str, list[dict]]:
        """Write df's partitions as shards in a pending folder of their own; with a column, in folders by its values."""
        key = uuid.uuid4().hex
        folder, kept = f"data/{key}", [c for c in df.columns if c != by]
        self.fs.create(self._path(f"pending/{key}"), False).close()
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{folder}")
        found = sorted((path, size) for path, size in self._files(folder) if path.endswith(".parquet"))
        if not found:
            return key, []
        read = self.spark.read.schema(df.select(*kept).schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{folder}")
        rows = {r.name: r.n for r in read.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name")).agg(F.count("*").alias("n")).collect()}
        name = lambda path: path.rsplit("/", 1)[1]
        if len({name(p) for p, _ in found}) < len(found):  # one task wrote to several folders under one name
            rows = {(r.folder, r.name): r.n for r in read.select(F.split(F.col("_metadata.file_path"), "/").alias("p")).groupBy(F.element_at("p", -2).alias("folder"), F.element_at("p", -1).alias("name")).agg(F.count("*").alias("n")).collect()}
            count = lambda path: rows.get(tuple(path.split("/")[-2:]), 0)
        else:
            count = lambda path: rows.get(name(path), 0)
        return key, [{"file": path, "bytes": size, "rows": count(path)} for path, size in found if count(path)]

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """Paths below the root, and sizes, of all files under a folder."""
        out = []
        if self.fs.exists(self._path(folder)):
            for s in self.fs.listStatus(self._path(folder)):
                path = f"{folder}/{s.getPath().getName()}"
                out += self._files(path) if s.isDirectory() else [(path, s.getLen())]
        return out

    def _settled(self, key: str) -> None:
        self.fs.delete(self._path(f"pending/{key}"), False)

    def append(self, df: DataFrame) -> int:
        """Add an arrival; its partitions become shards."""
        key, new = self._write(df)
        version = self._change(df.schema.json(), lambda shards: shards + new)
        self._settled(key)
        return version

    def append_arrivals(self, df: DataFrame, by: str) -> int:
        """Add the arrivals that a column tells apart, one version each in order of its values, by one scan of df."""
        key, new = self._write(df, by)
        version = (self.versions() or [0])[-1]
        schema = df.drop(by).schema.json()
        arrivals: dict[str, list[dict]] = {}
        for s in new:
            arrivals.setdefault(s["file"].split("/")[-2], []).append(s)
        for _, part in sorted(arrivals.items()) or [("", [])]:
            version = self._change(schema, lambda shards, part=part: shards + part)
        self._settled(key)
        return version

    def tier(self, size: int) -> int:
        return max(0, int(log(max(size, 1), TIER)))

    def plan(self, shards: list[dict], fanin: int = FANIN) -> list[list[dict]]:
        """Runs to merge: at least `fanin` shards of one tier, in order, up to the target size each."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target * 3 // 4:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        runs = []
        for _, group in sorted(tiers.items()):
            if len(group) < fanin:
                continue
            run, size = [], 0
            for s in group:
                if run and size + s["bytes"] > self.target:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, *, fanin: int = FANIN) -> int:
        """Merge tier by tier until no tier holds enough shards, which each merge makes fewer; returns the version."""
        while True:
            now = self.manifest()
            runs = self.plan(now["shards"], fanin)
            if not runs:
                return now["version"]
            gone, merged, keys = {s["file"] for run in runs for s in run}, [], []
            for i in range(0, len(runs), RUNS):
                # Each run is one task, which streams its files into one; nothing is shuffled.
                tasks = [self.read(now, [s["file"] for s in run]).coalesce(1) for run in runs[i : i + RUNS]]
                key, new = self._write(reduce(DataFrame.union, tasks))
                keys.append(key)
                merged += new

            def edit(shards: list[dict], gone=gone, merged=merged) -> list[dict]:
                # Only if all merged inputs are still there; else another compaction was faster, and its result stands.
                have = {s["file"] for s in shards}
                return [s for s in shards if s["file"] not in gone] + merged if gone <= have else shards

            self._change(now["schema"], edit)
            for key in keys:
                self._settled(key)

    def read(self, manifest: dict | None = None, files: list[str] | None = None) -> DataFrame:
        """The rows of a version (default the newest)."""
        from pyspark.sql.types import StructType

        manifest = manifest or self.manifest()
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        files = [s["file"] for s in manifest["shards"]] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in files])

    def expire(self, *, keep: int = 1, abandoned: float = ABANDONED) -> int:
        """Delete files and manifests that none of the newest `keep` versions names; returns the number of files.

        Files of pending folders stay, unless the mark is older than `abandoned` seconds.
        """
        listed = self._files("data")
        pending, at = set(), self._path("pending")
        for s in self.fs.listStatus(at) if self.fs.exists(at) else []:
            if time.time() - s.getModificationTime() / 1000 <= abandoned:
                pending.add(s.getPath().getName())
        known = self.versions()
        named = {s["file"] for v in known[-max(1, keep) :] for s in self.manifest(v)["shards"]}
        gone = [path for path, _ in listed if path not in named and path.split("/")[1] not in pending]
        for path in gone:
            self.fs.delete(self._path(path), False)
        for v in known[: -max(1, keep)]:
            self.fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
        return len([p for p in gone if p.endswith(".parquet")])


def stored_digest(docs: DataFrame, root: str, *, batches: int = 2, target_bytes: int = 64 << 20) -> DataFrame:
    """Append docs in arrivals by id, compact, and describe every row as the newest version gives it back."""
    store = Store(docs.sparkSession, root, target_bytes=target_bytes)
    batch = next(f"batch{i}" for i in range(len(docs.columns) + 1) if f"batch{i}" not in map(str.lower, docs.columns))
    store.append_arrivals(docs.withColumn(batch, F.pmod(F.xxhash64(F.col("doc_id")), F.lit(batches))), batch)
    store.compact()
    store.expire()
    back = store.read()
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return back.select("doc_id", F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("text_sha256"), "lang", "source")
