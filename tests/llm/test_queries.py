"""The registered queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tallyspark.llm.oracle import ORACLE
from tallyspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("key", sorted(ORACLE))
def test_equals_its_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[key])
    names = [c[0] for c in want.description]
    rows = lambda rs: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rs), key=str)
    assert rows(QUERIES[key](spark, SF).select(*names).collect()) == rows(want.fetchall())
