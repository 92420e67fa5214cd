import duckdb
import pytest
from pyspark.sql import functions as F

from velumen.llm import registry

TABLES = ("documents", "labels", "embeddings", "conversations", "benchmark")


def plain(rows):
    return sorted(repr(tuple(round(x, 5) if isinstance(x, float) else x for x in r)) for r in rows)


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder.startswith('/tmp') else ''}')")
    got = registry.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    assert columns == sorted(con.sql(registry.ORACLES[name]).columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)
    return got


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_whole_tables_against_sql(spark, sf, name):
    against_sql(spark, sf, name)


def test_mixture_of_odd_rows_against_sql(spark, tmp_path):
    """Targets over several rounds of resharing, null and clashing ids, texts and sources, repeated rows, many slots."""
    docs = [(None if i % 17 == 0 else i % 400, None if i % 13 == 0 else f"w{i} " * (i * 7 % 900), (None, "a", "B", "é", "b", "c")[i % 6] if i < 590 else "tiny") for i in range(600)] + [(3, "x y z", "a")] * 4
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for t in TABLES[1:]:
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    got = against_sql(spark, str(tmp_path), "op6_low_discrepancy_mix")
    assert got.where("first_slot > 0").count() > 100 and got.agg(F.max("slot_words")).first()[0] > 0
