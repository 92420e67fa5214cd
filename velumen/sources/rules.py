"""Rules of tables in the catalogue: keys, unique and not-null columns, references, checks, defaults, layout and counters.

Spark's catalogue of files has no constraints of its own, so a rule is a property of its table. Properties are what a scan of
the catalogue reads back, what a clone copies, and what `enforce` checks against the data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumen.functions.shape import quote_ident, quote_literal
from velumen.sources import schema
from velumen.sources.layout import Layout

PREFIX = "velumen."
ROW = "relation string, kind string, columns string, target string"


@dataclass(frozen=True)
class Rules:
    """What holds for a table."""

    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, column)
    checks: dict[str, str] = field(default_factory=dict)  # name -> condition
    defaults: dict[str, str] = field(default_factory=dict)  # column -> SQL
    layout: Layout | None = None
    sequence: str | None = None  # column that a counter numbers

    def constraints(self) -> schema.Constraints:
        return schema.Constraints(key=self.key, unique=self.unique, not_null=self.not_null, references=self.references)


def _name(database: str, table: str) -> str:
    return f"{quote_ident(database)}.{quote_ident(table)}"


def _properties(rules: Rules) -> dict[str, object]:
    """What is stored, without references."""
    out: dict[str, object] = {}
    for kind in ("key", "unique", "not_null", "checks", "defaults", "sequence"):
        if getattr(rules, kind):
            out[kind] = getattr(rules, kind)
    if rules.layout:
        out["layout"] = [rules.layout.cluster, list(rules.layout.bloom)]
    return out


def put(spark: SparkSession, database: str, table: str, rules: Rules) -> None:
    """Store all rules of a table but its references."""
    _set(spark, database, table, _properties(rules))


def put_references(spark: SparkSession, database: str, table: str, rules: Rules) -> None:
    if rules.references:
        _set(spark, database, table, {"references": rules.references})


def _set(spark: SparkSession, database: str, table: str, properties: dict[str, object]) -> None:
    if properties:
        listed = ", ".join(f"{quote_literal(PREFIX + k)} = {quote_literal(json.dumps(v))}" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {_name(database, table)} SET TBLPROPERTIES ({listed})")


def get(spark: SparkSession, database: str, table: str) -> Rules:
    """A table's rules, from its properties in the catalogue."""
    found = {r.key[len(PREFIX) :]: json.loads(r.value) for r in spark.sql(f"SHOW TBLPROPERTIES {_name(database, table)}").collect() if r.key.startswith(PREFIX)}
    layout = found.get("layout")
    return Rules(
        key=tuple(found.get("key", ())),
        unique=tuple(map(tuple, found.get("unique", ()))),
        not_null=tuple(found.get("not_null", ())),
        references={c: tuple(t) for c, t in found.get("references", {}).items()},
        checks=found.get("checks", {}),
        defaults=found.get("defaults", {}),
        layout=Layout(layout[0], tuple(layout[1])) if layout else None,
        sequence=found.get("sequence"),
    )


def moved(rules: Rules, source: str, target: str) -> Rules:
    """Rules whose texts name another database's objects instead of the first one's."""
    swap = lambda texts: {k: v.replace(f"{source}.", f"{target}.") for k, v in texts.items()}
    return Rules(**{**rules.__dict__, "checks": swap(rules.checks), "defaults": swap(rules.defaults)})


def base_tables(spark: SparkSession, database: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary and "VIEW" not in t.tableType)


def scan(spark: SparkSession, database: str) -> DataFrame:
    """(relation, kind, columns, target) of all rules in a database, read from the catalogue."""
    rows = []
    for name in base_tables(spark, database):
        r = get(spark, database, name)
        rows += [(name, "key", ",".join(r.key), None)] if r.key else []
        rows += [(name, "unique", ",".join(u), None) for u in r.unique] + [(name, "not null", c, None) for c in r.not_null]
        rows += [(name, "references", c, ".".join(t)) for c, t in r.references.items()]
        rows += [(name, "check", c, e) for c, e in r.checks.items()] + [(name, "default", c, e) for c, e in r.defaults.items()]
        rows += [(name, "layout", r.layout.cluster, ",".join(r.layout.bloom))] if r.layout else []
        rows += [(name, "sequence", r.sequence, None)] if r.sequence else []
    return spark.createDataFrame(rows, ROW)


def edges(spark: SparkSession, database: str) -> list[tuple[str, str]]:
    """(table, referenced table), from the rules in the catalogue."""
    return sorted({(name, t) for name in base_tables(spark, database) for t, _ in get(spark, database, name).references.values()})


def broken(spark: SparkSession, database: str, *, references: bool) -> DataFrame:
    """(relation, rule, n): how often each rule of a database is broken; only references, or all others."""
    out = spark.createDataFrame([], "relation string, rule string, n long")
    tables = {t: spark.table(_name(database, t)) for t in base_tables(spark, database)}
    for name, df in tables.items():
        r = get(spark, database, name)
        if references:
            rules = schema.Constraints(references=r.references)
        else:
            rules = schema.Constraints(key=r.key, unique=r.unique, not_null=r.not_null)
        if rules != schema.Constraints():
            out = out.unionByName(schema.violations(df, rules, tables).select(F.lit(name).alias("relation"), "rule", "n"))
        if not references and r.checks:
            # A condition that is not false holds.
            counts = df.agg(*[F.count_if(~F.coalesce(F.expr(e), F.lit(True))).alias(c) for c, e in r.checks.items()])
            listed = F.inline(F.array(*[F.struct(F.lit(f"check({c})").alias("rule"), F.col(f"`{c}`").alias("n")) for c in r.checks]))
            out = out.unionByName(counts.select(listed).where("n > 0").select(F.lit(name).alias("relation"), "rule", "n"))
    return out


def enforce(spark: SparkSession, database: str, *, references: bool) -> None:
    found = broken(spark, database, references=references).collect()  # one row a rule at most
    if found:
        raise schema.ConstraintError("; ".join(f"{r.relation}: {r.rule}: {r.n}" for r in found))


def with_defaults(spark: SparkSession, database: str, table: str, df: DataFrame) -> DataFrame:
    """df in the table's columns: absent ones take their default, or null."""
    rules, have = get(spark, database, table), set(df.columns)
    fields = spark.table(_name(database, table)).schema
    value = lambda c: F.expr(rules.defaults[c]) if c in rules.defaults else F.lit(None)
    return df.select(*[(F.col(f.name) if f.name in have else value(f.name)).cast(f.dataType).alias(f.name) for f in fields])


def insert(spark: SparkSession, database: str, table: str, df: DataFrame) -> None:
    """Append rows after defaults were filled in and all rules checked with what is there; nothing is written where one is broken."""
    rows, there = with_defaults(spark, database, table, df), spark.table(_name(database, table))
    rules = get(spark, database, table)
    tables = {t: spark.table(_name(database, t)) for t in base_tables(spark, database)}
    found = schema.violations(there.unionByName(rows), rules.constraints(), tables | {table: there.unionByName(rows)}).collect() if rules.constraints() != schema.Constraints() else []
    bad = [f"{r.rule}: {r.n}" for r in found]
    bad += [f"check({c})" for c, e in rules.checks.items() if not rows.where(~F.coalesce(F.expr(e), F.lit(True))).isEmpty()]
    if bad:
        raise schema.ConstraintError("; ".join(bad))
    rows.write.insertInto(_name(database, table))
