"""Counters of ids, kept beside the tables they number: moved by inserts, set anew after data were copied in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumen.operators.numbering import numbered
from velumen.sources.journal import Journal


class Sequences:
    """Named counters in one journal. A counter has the value it gave out last; 0 before the first."""

    def __init__(self, spark: SparkSession, root: str, **options):
        self.spark, self.journal = spark, Journal(spark, root, **options)

    @staticmethod
    def _values(entries: list[dict]) -> dict[str, int]:
        out: dict[str, int] = {}
        for e in entries:
            if e.get("base"):
                out = dict(e["last"])
            out |= e["set"] if "set" in e else {}
        return out

    def last(self, name: str) -> int:
        return self._values(self.journal.entries()).get(name, 0)

    def take(self, name: str, n: int = 1) -> int:
        """The first of n values that nobody else gets."""
        if n < 1:
            raise ValueError("at least one value is taken")
        entry = self.journal.commit(lambda now: {"kind": "take", "set": {name: self._values(now).get(name, 0) + n}})
        return entry["set"][name] - n + 1

    def resync(self, tops: dict[str, int]) -> None:
        """Set counters to the largest ids of their tables (0 for empty ones, whose next value is then 1), all in one step."""
        if any(v < 0 for v in tops.values()):
            raise ValueError("a counter cannot be negative")
        self.journal.commit(lambda now: {"kind": "resync", "set": dict(tops)})

    def resync_to(self, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, int]:
        """resync() to the tables themselves: name -> (table, id column). The tables are asked in one job for one row each."""
        asks = [df.agg(F.lit(name).alias("name"), F.coalesce(F.max(c), F.lit(0)).cast("long").alias("top")) for name, (df, c) in tables.items()]
        if not asks:
            return {}
        rows = asks[0]
        for a in asks[1:]:
            rows = rows.unionByName(a)
        tops = {r["name"]: r["top"] for r in rows.collect()}  # one row a table
        self.resync(tops)
        return tops

    def compact(self) -> None:
        """Let the journal begin anew with the values as they are."""
        self.journal.commit(lambda now: {"base": True, "kind": "base", "last": self._values(now)})

    def numbered(self, rows: DataFrame, name: str, column: str, *order: str) -> DataFrame:
        """rows with ids of their own in `column`, in the given order."""
        lined = numbered(rows, *order, name=column)
        n = lined.count()
        first = self.take(name, n) if n else 1
        return lined.withColumn(column, F.col(column) + (first - 1)).select(column, *[c for c in rows.columns if c != column])

    def insert(self, rows: DataFrame, path: str, name: str, column: str, *order: str, write: Callable[[DataFrame, str], None] | None = None) -> None:
        """Append rows to the table at a path under ids of their own. A failed insert leaves a gap, never an id twice."""
        put = write or (lambda df, at: df.write.mode("append").parquet(at))
        put(self.numbered(rows, name, column, *order), path)
