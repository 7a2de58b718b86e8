"""Queries of the subpackage against their SQL in DuckDB."""

import duckdb
import pytest

from gridloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda d: sorted(map(tuple, d.itertuples(index=False)))
    assert rows(got) == rows(want)
