"""Queries against their SQL, on whole tables and on odd rows."""

import duckdb
import pytest

from prefixspark.llm import entries as E

NAMES = ["op4_decontaminate", "op8_suffix_dedup", "op10_line_dedup"]


def compare(spark, where, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS FROM '{where}/{table}.parquet{'/*.parquet' if '/testdata/' not in where else ''}'")
    df, sql = E.queries()[name](spark, where), E.oracle_sql()[name]
    columns = sorted(df.columns)
    assert columns == sorted(db.sql(sql).columns)
    want = sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == want
    return want


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", name)


@pytest.mark.parametrize("name", ["op4_decontaminate", "op8_suffix_dedup"])
def test_sql_agrees_on_odd_rows(spark, odd_docs, tmp_path, name):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = [r["text"] for r in odd_docs.where("text IS NOT NULL AND length(text) > 200").collect()]
    items = [(i, " ".join(t.split()[:n])) for i, (t, n) in enumerate((t, n) for t in texts for n in (3, 12, 60))]
    spark.createDataFrame([*items, (len(items), None), (len(items) + 1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert compare(spark, str(tmp_path), name)
