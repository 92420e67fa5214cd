"""Every registered catalogue query against its DuckDB oracle, on the smallest tables."""

import math

import duckdb
import pytest

from velumen.operators import search
from velumen.plans import catalogue
from velumen.sources import schema

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda x: (round(x, 6) if math.isfinite(x) else str(x)) if isinstance(x, float) else x
    return sorted(repr(tuple(map(fix, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert columns == sorted(duck.sql(catalogue.ORACLES[name]).columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_a_text_finds_every_image_in_reach(spark, sf):
    """No distance is above 2: each visible image with a vector is found."""
    seen = schema.images(spark, sf).where(search.visible()).where("embedding IS NOT NULL")
    got = catalogue.QUERIES["search_by_text"](spark, sf)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in seen.collect())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() == 96
