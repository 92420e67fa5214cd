"""Cloning a catalogue of tables in order of their references."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velumen.functions.shape import quote_ident, quote_literal, strip_view_tail


def tables(spark: SparkSession, database: str) -> DataFrame:
    """(name, kind) of a database's tables and views."""
    found = [(t.name, "view" if "VIEW" in t.tableType else "table") for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.createDataFrame(found, "name string, kind string")


def load_order(names: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Tables so that each comes after those it references (edges: table, referenced). A cycle is an error.

    Table names are metadata of small, fixed number, so this is settled on the driver.
    """
    left, order = sorted(names), []
    while left:
        ready = [t for t in left if not any(a == t and b in left for a, b in edges)]
        if not ready:
            raise ValueError(f"references among {left} form a cycle")
        order += ready
        left = [t for t in left if t not in ready]
    return order


def references_held(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, columns, target): references that the tables' values hold to.

    A column x_thing of one table may refer to y_thing of another where that one is unique and not null; it does
    where each of its values is found there. Each table is read once for its unique columns, once for each candidate.
    """
    named = lambda c: c.split("_", 1)[1] if "_" in c and c.endswith("key") else None
    unique: dict[str, list[tuple[str, str]]] = {}
    for t, df in tables.items():
        keys = [c for c in df.columns if named(c)]
        seen = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(c) for c in keys]).first()  # one row a table
        for c in keys:
            if seen[c] == seen.n:
                unique.setdefault(named(c), []).append((t, c))
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "relation string, columns string, target string")
    for t, df in tables.items():
        for c in df.columns:
            for parent in unique.get(named(c), []):
                if parent[0] == t:
                    continue
                lost = df.where(F.col(c).isNotNull()).join(tables[parent[0]].select(F.col(parent[1]).alias("_parent")), F.col(c) == F.col("_parent"), "left_anti")
                held = lost.limit(1).agg(F.count("*").alias("n")).where("n = 0")
                out = out.unionByName(held.select(F.lit(t).alias("relation"), F.lit(c).alias("columns"), F.lit(".".join(parent)).alias("target")))
    return out


def copy_tables(spark: SparkSession, source: str, target: str, edges: list[tuple[str, str]]) -> list[str]:
    """Copy all tables of a database, in load order, into another, which is replaced as a whole.

    All data are written aside first; a copy that fails leaves the target as it was. Then only names change: the target's
    tables are made anew on the written data.
    """
    names = [r.name for r in tables(spark, source).where("kind = 'table'").collect()]
    order = load_order(names, edges)
    src, dst = quote_ident(source), quote_ident(target)
    aside = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{target}-{uuid.uuid4().hex}"
    try:
        for t in order:
            spark.table(f"{src}.{quote_ident(t)}").write.parquet(f"{aside}/{t}")
    except Exception:
        path = spark._jvm.org.apache.hadoop.fs.Path(aside)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        raise
    spark.sql(f"DROP DATABASE IF EXISTS {dst} CASCADE")
    spark.sql(f"CREATE DATABASE {dst}")
    for t in order:
        spark.sql(f"CREATE TABLE {dst}.{quote_ident(t)} USING parquet LOCATION {quote_literal(f'{aside}/{t}')}")
    return order


def columns(spark: SparkSession, database: str) -> DataFrame:
    """(table, column, type, nullable) of a database."""
    found = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables(database) if not t.isTemporary for c in spark.catalog.listColumns(f"{quote_ident(database)}.{quote_ident(t.name)}")]
    return spark.createDataFrame(found, "table string, column string, type string, nullable boolean")


def copy_views(spark: SparkSession, definitions: dict[str, str], source: str, target: str) -> list[str]:
    """Create views from their definitions, moved from one database to another and without a closing WITH [NO] DATA.

    A view that reads another one is made after it. Returns the names in the order made.
    """
    moved = spark.createDataFrame(sorted(definitions.items()), "name string, sql string").select("name", strip_view_tail(requalified(F.col("sql"), source, target)).alias("sql"))
    left, made = {r.name: r.sql for r in moved.collect()}, []  # definitions are metadata
    while left:
        failed = {}
        for name, sql in sorted(left.items()):
            try:
                spark.sql(f"CREATE OR REPLACE VIEW {quote_ident(target)}.{quote_ident(name)} AS {sql}")
                made.append(name)
            except AnalysisException as e:
                failed[name] = e
        if len(failed) == len(left):
            raise next(iter(failed.values()))
        left = {name: left[name] for name in failed}
    return made


def copy_materialized(spark: SparkSession, definitions: dict[str, str], source: str, target: str) -> list[str]:
    """Materialised views as empty tables of their columns, to be filled by a refresh."""
    moved = spark.createDataFrame(sorted(definitions.items()), "name string, sql string").select("name", strip_view_tail(requalified(F.col("sql"), source, target)).alias("sql"))
    made = []
    for r in moved.collect():  # definitions are metadata
        spark.sql(r.sql).limit(0).write.format("parquet").mode("overwrite").saveAsTable(f"{quote_ident(target)}.{quote_ident(r.name)}")
        made.append(r.name)
    return made


def replace_dataset(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside a dataset and rename into its place, so that readers see the old or the new one whole."""
    aside, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(aside)
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(make(old), True)
    if fs.exists(make(path)) and not fs.rename(make(path), make(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(make(aside), make(path)):
        fs.rename(make(old), make(path))
        raise OSError(f"{path} cannot be replaced")
    fs.delete(make(old), True)


def next_id(df: DataFrame, column: str) -> DataFrame:
    """One row: the largest id (0 if none) and the next one to give out."""
    top = F.coalesce(F.max(column), F.lit(0)).cast("long")
    return df.agg(top.alias("max_id"), (top + 1).alias("next_id"))


def not_in(rows: DataFrame, key: str, excluded: DataFrame, excluded_key: str) -> DataFrame:
    """Rows whose key is not among the excluded ones, as NOT IN has it: a null among them excludes every row, and a null key stays only if there are none."""
    view, other = "_rows", "_excluded"
    return rows.sparkSession.sql(f"SELECT * FROM {{{view}}} WHERE {quote_ident(key)} NOT IN (SELECT {quote_ident(excluded_key)} FROM {{{other}}})", **{view: rows, other: excluded})


def mentions(text: Column, name: Column) -> Column:
    """Whether a definition names a schema's objects."""
    return F.like(text, F.concat(F.lit("%"), name, F.lit(".%")))


def requalified(text: Column, source: str, target: str) -> Column:
    """A definition moved from one schema to another."""
    return F.replace(text, F.lit(f"{source}."), F.lit(f"{target}."))


def without(names: Column, gone: Column) -> Column:
    return F.array_remove(names, gone)
