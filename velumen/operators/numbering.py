"""Running numbers over a whole table, in an order, without a task that holds more than its share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velumen.sources import shared


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """df with numbers from 1 on in the given order; rows that are equal in it follow one another. Written to the shared folder.

    Rows are range-partitioned, numbered within their partition and shifted by the sizes of the partitions before. A last
    key by lot lets many equal rows spread over partitions.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    drawn = df.withColumn("_lot", F.rand(17))
    sorted_ = drawn.repartitionByRange(*order, F.col("_lot")).sortWithinPartitions(*order, "_lot").drop("_lot").withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            own = pa.array(np.arange(n + 1, n + 1 + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "_own"])

    lined = shared.keep(sorted_.mapInArrow(run, sorted_.withColumn("_own", F.lit(0).cast("long")).schema), "numbered")
    # One row a partition.
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = lined.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    return lined.join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))
