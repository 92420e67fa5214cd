"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of one Arrow batch, of which the JVM and Python each hold one or two a task.
BATCH_BYTES = 8 << 20
_DEFAULT_BATCH = 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own: texts differ much in length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (f"{_DEFAULT_BATCH}b", str(_DEFAULT_BATCH), "-1b", "-1"):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset in a local session, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="velumen-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """A folder of Parquet tables under the shared folder; a lost executor rereads them instead of recomputing."""

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{base(spark)}/velumen/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return the written table."""
        self._n += 1
        at = self.path(f"{name}-{self._n}")
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._velumen_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that nothing will read again."""
        for df in frames:
            delete(self.spark, df._velumen_path)


def filesystem(spark: SparkSession, at: str):
    """Hadoop's file system and path objects for a location."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, at: str) -> None:
    fs, path = filesystem(spark, at)
    fs.delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
