"""Queries run on the smallest data; those with SQL are held against it."""

import duckdb
import pytest

from gridspark.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {n.split("_")[0] for n in ORACLES} == {"op1", "op5", "op10", "op11", "op12", "op13"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted(tuple(map(repr, r)) for r in out.select(*columns).collect())
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
        assert got == sorted(tuple(map(repr, r)) for r in want)
