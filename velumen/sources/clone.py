"""Cloning a database as a whole: data, rules, counters, views; in one step for its readers.

A target is a name with versions. A clone makes a database of its own for the new version: tables in the order of their
references, in their layouts; keys, unique, not-null and check rules, which must hold; references last, which must hold; counters set to the
largest ids; views in the order in which they read each other; materialised views, empty. Then one entry of a journal makes
that version the target's current one. Whatever fails before leaves the old version current and whole; what was made is removed.
Readers resolve the name once and keep reading what they resolved; `vacuum` removes versions that are no longer current.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from velumen.functions.shape import quote_ident, quote_literal
from velumen.operators.sequences import Sequences
from velumen.sources import catalog, layout, rules
from velumen.sources.journal import Journal


class Target:
    """A name for databases, of which one is current."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None, **options):
        self.spark, self.name = spark, name
        warehouse = (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
        self.root, self.options = f"{warehouse}/{name}-versions", options
        self.journal = Journal(spark, self.root, **options)

    def current(self) -> str | None:
        """The database that the name stands for; None before the first clone."""
        entries = self.journal.entries()
        return entries[-1]["database"] if entries else None

    def database(self) -> str:
        found = self.current()
        if found is None:
            raise LookupError(f"{self.name} has no version")
        return found

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{quote_ident(self.database())}.{quote_ident(name)}")

    def sequences(self, database: str | None = None) -> Sequences:
        return Sequences(self.spark, f"{self.root}/{database or self.database()}", **self.options)

    # Cloning --------------------------------------------------------------------------------------------------

    def clone_of(self, source: str, *, views: dict[str, str] | None = None, materialized: dict[str, str] | None = None, step: Callable[[str], None] = lambda what: None) -> str:
        """Make a clone of a database the current version; the database that holds it.

        views, materialized: definitions by name. step is told what comes next, before it is done.
        """
        entries = self.journal.entries()
        based_on, made = (entries[-1]["number"] if entries else 0), f"{self.name}__{uuid.uuid4().hex[:12]}"
        try:
            step("database")
            self.spark.sql(f"CREATE DATABASE {quote_ident(made)}")
            order = catalog.load_order(rules.base_tables(self.spark, source), rules.edges(self.spark, source))
            kept = {t: rules.moved(rules.get(self.spark, source, t), source, made) for t in order}
            for t in order:
                step(f"data of {t}")
                self._copy(source, made, t, kept[t])
            for t in order:
                step(f"rules of {t}")
                rules.put(self.spark, made, t, kept[t])
            step("check of rules")
            rules.enforce(self.spark, made, references=False)
            for t in order:
                step(f"references of {t}")
                rules.put_references(self.spark, made, t, kept[t])
            step("check of references")
            rules.enforce(self.spark, made, references=True)
            step("counters")
            table = lambda t: self.spark.table(f"{quote_ident(made)}.{quote_ident(t)}")
            self.sequences(made).resync_to({t: (table(t), r.sequence) for t, r in kept.items() if r.sequence})
            step("views")
            catalog.copy_views(self.spark, views or {}, source, made)
            step("materialised views")
            catalog.copy_materialized(self.spark, materialized or {}, source, made)
            step("switch")
            entry = {"base": True, "kind": "switch", "database": made, "source": source}
            done = self.journal.commit(lambda now: entry if (now[-1]["number"] if now else 0) == based_on else None)
            if done is None:
                raise RuntimeError(f"another clone of {self.name} was made meanwhile")
        except BaseException:
            self._remove(made)
            raise
        return made

    def _copy(self, source: str, made: str, table: str, kept: rules.Rules) -> None:
        df = self.spark.table(f"{quote_ident(source)}.{quote_ident(table)}")
        at = f"{self.root}/{made}/data/{table}"
        if kept.layout:
            layout.write(df, at, kept.layout)
        else:
            df.write.parquet(at)
        # The table is external: its data stay under the version's own folder.
        self.spark.sql(f"CREATE TABLE {quote_ident(made)}.{quote_ident(table)} USING parquet LOCATION {quote_literal(at)}")

    def _remove(self, database: str) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {quote_ident(database)} CASCADE")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{database}")
        self.journal.fs.delete(at, True)

    def vacuum(self) -> list[str]:
        """Remove the databases of versions that are not current; what their readers still read goes with them."""
        now = self.current()
        old = [d.name for d in self.spark.catalog.listDatabases() if d.name.startswith(f"{self.name}__") and d.name != now]
        for d in old:
            self._remove(d)
        return old
