"""Registered queries against their SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pytest

from lakelog.llm import registry

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, np.generic):
        x = x.item()
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False, name=None)) for df in (got, want)]
    assert rows[0] == rows[1]


def test_all_are_registered():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{k}" for k in range(1, 11)}
