"""The queries against DuckDB over the same tables."""

import os

import pytest

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op1_topk", "op3_suffix_dedup", "op5_shards", "op8_decontamination", "op9_minhash", "op13_ranked_search"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from codeloom.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)
